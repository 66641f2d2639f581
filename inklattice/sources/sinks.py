"""Writers: documents' rows replaced in partitioned Parquet, CSV exports and copy manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, buckets: int = 64, key: str = "document_hash") -> None:
    """Write tables partitioned by a bucket of the document; only buckets in ``rows`` are replaced."""
    out = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def copy_manifest(matches: DataFrame) -> DataFrame:
    """Where each distinct (path, hash) is copied: ``<stem>__<first 8 of hash><suffix>``."""
    stem, suffix = F.regexp_replace("pdf", r"(\.[^.]*)?$", ""), F.regexp_extract("pdf", r"(\.[^.]*)$", 1)
    return matches.select("path", "pdf", "hash").distinct().select("path", F.concat(stem, F.lit("__"), F.substring("hash", 1, 8), suffix).alias("target"))


def unique_targets(rows: DataFrame, name: str = "name", order: str = "path") -> DataFrame:
    """Targets without clashes: the second file of a name gets ``_1`` before its suffix, and so on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, suffix = F.regexp_replace(name, r"(\.[^.]*)?$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return rows.withColumn("target", F.when(k == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), suffix)))


def cabinet_folders(rows: DataFrame, cables: DataFrame) -> DataFrame:
    """First cable of each row that has a document: folder ``<cubicle>+<cable>``; rows without one have nulls and count as unmatched.

    rows: row, cubicle, cables (array).
    """
    each = rows.select("row", F.posexplode("cables").alias("ord", "cable")).join(cables.select("cable", "document_hash"), "cable")
    best = each.groupBy("row").agg(F.min(F.struct("ord", "cable", "document_hash")).alias("r"))
    out = rows.select("row", "cubicle").join(best, "row", "left")
    return out.select("row", F.when(F.col("r").isNotNull(), F.concat("cubicle", F.lit("+"), F.col("r.cable"))).alias("folder"), F.col("r.document_hash").alias("document_hash"), F.col("r").isNotNull().alias("matched"))


def tree_json(nodes: DataFrame) -> DataFrame:
    """Nested JSON of flat layout nodes, per document: children are collected bottom-up, level by level.

    nodes: document_hash, node_id, parent_id (null for roots), ord, type, name, and where there are group_type, x, y, w,
    h and data.  A node is {id, type, name, bbox, children, data[, group_type]}; names of any text are escaped.
    """
    n = nodes
    for c, t in (("group_type", "string"), ("x", "double"), ("y", "double"), ("w", "double"), ("h", "double"), ("data", "map<string,string>")):
        if c not in n.columns:
            n = n.withColumn(c, F.lit(None).cast(t))
    # Levels from the roots down; a layout has few.
    level, levels = n.filter("parent_id IS NULL"), []
    while not level.isEmpty():
        levels.append(level)
        up = level.select("document_hash", F.col("node_id").alias("parent_id"))
        level = n.join(up, ["document_hash", "parent_id"], "left_semi").select(*n.columns)
    below = None
    for own in reversed(levels):
        own = own.withColumn("kids", F.lit(None).cast("string")) if below is None else own.join(below, (own.document_hash == below.dh) & (own.node_id == below.pid), "left").drop("dh", "pid")
        quoted = lambda c: F.expr(f"substr(to_json(struct({c} AS v)), 6, length(to_json(struct({c} AS v))) - 6)")
        box = F.when(F.col("x").isNotNull(), F.to_json(F.array("x", "y", "w", "h"))).otherwise(F.lit("null"))
        text = F.concat(
            F.lit('{"id":'), quoted("node_id"), F.lit(',"type":'), quoted("type"), F.lit(',"name":'), quoted("coalesce(name, '')"), F.lit(',"bbox":'), box, F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit('],"data":'),
            F.coalesce(F.to_json("data"), F.lit("{}")), F.when(F.col("group_type").isNotNull(), F.concat(F.lit(',"group_type":'), quoted("group_type"))).otherwise(F.lit("")), F.lit("}"),
        )
        made = own.withColumn("json", text)
        below = made.groupBy(F.col("document_hash").alias("dh"), F.col("parent_id").alias("pid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda s: s.json), ",").alias("kids"))
    if below is None:
        return n.select("document_hash", F.lit(None).cast("string").alias("tree_json")).limit(0)
    return below.select(F.col("dh").alias("document_hash"), F.concat(F.lit("["), "kids", F.lit("]")).alias("tree_json"))


def text_files(rows: DataFrame, per_file: bool = True) -> DataFrame:
    """Texts to be written, one for each file or one of all: (target, text).  rows: path, page, rows (array of cells of each line).

    Pages of a file come after ``=== Page n ===`` lines if there are several; lines are cells joined by tabs, empty ones left out.
    """
    from inklattice.functions.text import page_text

    many = F.count("*").over(Window.partitionBy("path")) > 1
    shown = rows.withColumn("body", page_text(F.col("rows"))).withColumn("body", F.when(many, F.concat(F.lit("=== Page "), F.col("page").cast("string"), F.lit(" ===\n"), F.col("body"))).otherwise(F.col("body")))
    whole = shown.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda s: s.body), "\n").alias("text"))
    own = whole.select(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".txt")).alias("target"), "text")
    if per_file:
        return own
    return own.agg(F.lit("combined.txt").alias("target"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "text"))), lambda s: s.text), "\n").alias("text"))


def organize_manifest(files: DataFrame, target: str, output: str, root: str = "", mirror: bool = False, ignore_case: bool = False, normalize: bool = True) -> DataFrame:
    """(path, target): where the files whose text holds a target go; names that clash get ``_n``, files below the output are left out.

    files: path, text.  ``mirror`` keeps the folders below ``root``.
    """
    from inklattice.functions.text import whole_contains

    out = output.rstrip("/")
    own = files.filter(~(F.col("path").startswith(out + "/") | (F.col("path") == out)) & whole_contains(F.coalesce("text", F.lit("")), target, ignore_case, normalize))
    inner = F.expr(f"replace(path, '{root.rstrip('/')}/', '')") if mirror else F.element_at(F.split("path", "/"), -1)
    named = unique_targets(own.select("path", inner.alias("name")))
    return named.select("path", F.concat(F.lit(out + "/"), "target").alias("target"))
