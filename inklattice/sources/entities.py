"""Readers: entity dumps, match tables, ASCII DXF files, text files; and discovery of input files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inklattice import schema
from inklattice.functions.text import strip
from inklattice.sources.dxf import dxf_entities, gbk_escapes

LOADED = (".dwg", ".dxf", ".pdf", ".json", ".parquet")


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = LOADED) -> DataFrame:
    """path, suffix, file_size, content_hash of the files below a folder; dot files and other suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.filter(~name.startswith(".") & suffix.isin(*suffixes)).select("path", suffix.alias("suffix"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("content_hash")).orderBy("path")


def read_entities(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """An entity dump as JSON lines or Parquet in the schema of ``schema.ENTITIES``."""
    return spark.read.schema(schema.ENTITIES).format(fmt).load(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """A UTF-8 match table with a header in the published column order; rows without cable or hash are left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = ["cable", "pdf", "path", "time", "hash", "match_type"]
    out = raw.select(*[(F.col(f"`{raw.columns[k]}`") if k < len(raw.columns) else F.lit("")).alias(n) for k, n in enumerate(names)])
    out = out.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("cable", "hash", "match_type")})
    return out.filter("cable <> '' AND hash <> ''")


def decode_mplus(c: Column) -> Column:
    """``\\M+5XXXX`` escapes as GBK characters; what does not decode stays."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else gbk_escapes(v))

    return run(c)


def eed_values(c: Column) -> Column:
    """The string values of an array of (code, value) structs."""
    return F.transform(F.filter(c, lambda v: v.value.isNotNull()), lambda v: v.value)


def read_dxf(spark: SparkSession, path: str, pattern: str = "*", full: bool = True) -> DataFrame:
    """Entities of ASCII DXF files, keyed by content hash.  A file that cannot be read gives one text of confidence 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("content")
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema.ENTITIES).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for content in batch["content"]:
                key = hashlib.sha256(content).hexdigest()
                try:
                    rows = dxf_entities(content.decode("utf-8", "replace"), key, full)
                except Exception as error:  # one bad file must not stop the job
                    rows = [{"document_hash": key, "seq": 0, "entity_id": "error", "kind": "TEXT", "text": f"<{error}>", "confidence": 0.0}]
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.mapInPandas(run, schema.ENTITIES)


def expand_blocks(inserts: DataFrame, members: DataFrame, depth: int = 8) -> DataFrame:
    """Entities of inserted blocks in drawing coordinates.

    inserts: document_hash, seq, block_name, ins_x, ins_y, rotation (degrees), scale_x, scale_y.
    members: block_name, kind, mx, my, text, child (name of a block inserted there, or null) with its own rotation,
    scale_x and scale_y (by default none), and the block's base_x, base_y.
    Nested inserts are followed ``depth`` levels down, one join each: a child's placement is composed with its parent's.
    """
    given = {"rotation": 0.0, "scale_x": 1.0, "scale_y": 1.0}
    m = members.select(*[c for c in members.columns if c not in given], *[(F.coalesce(F.col(c), F.lit(v)) if c in members.columns else F.lit(v)).alias(f"m_{c}") for c, v in given.items()])

    def matrix(prefix: str) -> list[Column]:
        r = F.radians(f"{prefix}rotation")
        sx, sy = F.col(f"{prefix}scale_x"), F.col(f"{prefix}scale_y")
        return [sx * F.cos(r), -sy * F.sin(r), sx * F.sin(r), sy * F.cos(r)]

    level = inserts.select("document_hash", "seq", "block_name", *[x.alias(n) for x, n in zip(matrix(""), "abcd", strict=True)], F.col("ins_x").alias("tx"), F.col("ins_y").alias("ty"))
    a, b, c, d = map(F.col, "abcd")
    out = None
    for _ in range(depth):
        met = level.join(m, "block_name")
        px, py = F.col("mx") - F.col("base_x"), F.col("my") - F.col("base_y")
        met = met.withColumn("x", a * px + b * py + F.col("tx")).withColumn("y", c * px + d * py + F.col("ty"))
        own = met.filter("child IS NULL").select("document_hash", "seq", "kind", "x", "y", "text")
        out = own if out is None else out.union(own)
        e, f, g, h = matrix("m_")
        level = met.filter("child IS NOT NULL").select("document_hash", "seq", F.col("child").alias("block_name"), (a * e + b * g).alias("a"), (a * f + b * h).alias("b"), (c * e + d * g).alias("c"), (c * f + d * h).alias("d"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return out


def read_drawings(spark: SparkSession, path: str) -> DataFrame:
    """Entities of the drawings below a folder, each by its suffix's reader: .dxf, .json (dumps), .parquet (entity tables).

    Files with other suffixes are left out; a file that cannot be read gives one text of confidence 0.  A folder that
    does not exist gives one such text, too, for a document named by the path.
    """
    from inklattice.sources.dump import read_dumps

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        empty = spark.createDataFrame([], schema.ENTITIES)
        row = spark.createDataFrame([(path, 0, "error", "TEXT", f"<missing: {path}>", 1, 0.0)], "document_hash string, seq long, entity_id string, kind string, text string, page int, confidence double")
        return empty.unionByName(row, allowMissingColumns=True)
    files = lambda pattern: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    tables = files("*.parquet").schema(schema.ENTITIES).format("parquet").load(path)
    return read_dxf(spark, path, "*.dxf").unionByName(read_dumps(spark, path, "*.json")).unionByName(tables)
