"""Driver tables seen as the engine's stored tables, so that every operator runs on shared Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_doubles(sql: str, *columns: str) -> str:
    """The statement with some of its columns as doubles, which literals like 0.5 are not in SQL."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}) FROM ({sql})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven columns of cable topology from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("C-"), F.col("l_orderkey")).alias("cable_id"),
        F.when(F.col("l_linenumber") != 4, F.col("l_linenumber")).alias("conductor_no"),
        F.concat(F.col("l_returnflag"), (F.col("l_suppkey") % 9).cast("string")).alias("strip_name"),
        F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 40).cast("int")).alias("terminal_no"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("X"), (F.col("l_partkey") % 11).cast("string"))).alias("terminal_no_remote"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("CAB"), (F.col("l_suppkey") % 13).cast("string"))).alias("cabinet_name"),
        F.concat(F.lit("rem"), (F.col("l_suppkey") % 6).cast("string")).alias("cabinet_name_remote"),
        F.col("l_suppkey").cast("string").alias("document_hash"),
        F.when(F.col("l_returnflag") == "N", "strip").when(F.col("l_returnflag") == "A", "loop").otherwise("schedule").alias("source_type"),
    )


TOPOLOGY_SQL = """
topology AS (SELECT 'C-' || l_orderkey AS cable_id, CASE WHEN l_linenumber <> 4 THEN l_linenumber END AS conductor_no, l_returnflag || (l_suppkey % 9) AS strip_name,
  CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey % 40 AS INT) END AS terminal_no, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'X' || (l_partkey % 11) END AS terminal_no_remote,
  CASE WHEN l_linestatus = 'O' THEN 'CAB' || (l_suppkey % 13) END AS cabinet_name, 'rem' || (l_suppkey % 6) AS cabinet_name_remote, CAST(l_suppkey AS VARCHAR) AS document_hash,
  CASE l_returnflag WHEN 'N' THEN 'strip' WHEN 'A' THEN 'loop' ELSE 'schedule' END AS source_type FROM lineitem)"""


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their classification from labels, keyed by a string."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab.select("doc_id", "quality", "toxic"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("document_hash"),
        F.concat(F.lit("/scan/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("path"),
        F.col("n_chars").alias("file_size"),
        F.when(F.col("toxic") == 1, "protection_diagram").when(F.col("quality") == 1, "circuit_loop").when(F.col("quality") == 0, "unknown").alias("classification"),
        F.col("lang").alias("document_type"),
    )


DOCUMENTS_SQL = """
stored AS (SELECT CAST(d.doc_id AS VARCHAR) AS document_hash, '/scan/' || source || '/' || lang || '/' || d.doc_id AS path, n_chars AS file_size,
  CASE WHEN toxic = 1 THEN 'protection_diagram' WHEN quality = 1 THEN 'circuit_loop' WHEN quality = 0 THEN 'unknown' END AS classification, lang AS document_type
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text entities: one row per non-empty line."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_hash"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).filter("text <> ''")


TEXTS_SQL = "texts AS (SELECT document_hash, i - 1 AS seq, lines[i] AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS document_hash, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) WHERE lines[i] <> '')"


def points(spark: SparkSession, sf_dir: str, scale: float = 400.0) -> DataFrame:
    """Points from the first two vector components: doc, seq, x, y."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("label") % 3).alias("doc"), F.col("vec_id").alias("seq"), (F.floor(F.col("embedding")[0].cast("double") * scale * 64) / 64.0).alias("x"), (F.floor(F.col("embedding")[1].cast("double") * scale * 64) / 64.0).alias("y"))


POINTS_SQL = "points AS (SELECT label % 3 AS doc, vec_id AS seq, floor(CAST(embedding[1] AS DOUBLE) * 400.0 * 64) / 64 AS x, floor(CAST(embedding[2] AS DOUBLE) * 400.0 * 64) / 64 AS y FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around all points: doc, box, b_x, b_y, b_w, b_h."""
    p = points(spark, sf_dir)
    return p.select("doc", F.col("seq").alias("box"), (F.col("x") - 15).alias("b_x"), (F.col("y") - 10).alias("b_y"), (F.lit(30.0) + F.col("seq") % 7).alias("b_w"), (F.lit(20.0) + F.col("seq") % 5).alias("b_h"))


BOXES_SQL = "boxes AS (SELECT doc, seq AS box, x - 15 AS b_x, y - 10 AS b_y, 30.0 + seq % 7 AS b_w, 20.0 + seq % 5 AS b_h FROM points)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positions along an axis: grp, seq, at, size."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("grp"), F.col("event_id").alias("seq"), (F.pmod(F.col("event_id") * 37, F.lit(1000)) + (F.col("event_id") % 8) * F.lit(0.125)).alias("pos"), (F.floor(F.abs(F.col("value")) * 4) / 4.0).alias("size"), "event_type")


READINGS_SQL = "readings AS (SELECT user_id % 50 AS grp, event_id AS seq, (event_id * 37) % 1000 + (event_id % 8) * CAST(0.125 AS DOUBLE) AS pos, floor(abs(value) * 4) / 4 AS size, event_type FROM events)"
