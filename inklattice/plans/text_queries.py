"""Text search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_entities(docs: DataFrame) -> DataFrame:
    """One row for each line of each document, with its place."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def search_lines(docs: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Lines that hold a query, in any case; ``%`` and ``_`` in it are wildcards, a blank query finds nothing.  A top-k report."""
    if not query.strip():
        return text_entities(docs).select("doc_id", "pos", "line", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")).limit(0)
    pattern = "%" + query.lower().replace("\\", "\\\\") + "%"
    # Whole texts are tested before they are cut into lines.
    held = docs.filter(F.lower("text").like(pattern)).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return held.filter(F.lower("line").like(pattern)).select("doc_id", "pos", "line", "lang", "source").orderBy("doc_id", "pos").limit(limit)


def search_text(spark: SparkSession, sf_dir: str, query: str = "the of", limit: int = 200) -> DataFrame:
    return search_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), query, limit)


def search_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_text(spark, sf_dir, "TH_ % or", 100)


def search_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_text(spark, sf_dir, "  ")


QUERIES = {f.__name__: f for f in (search_text, search_wildcards, search_blank)}

_LINES = "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lines[i] AS line, lang, source FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)"
ORACLE_SQL = {
    "search_text": f"{_LINES} WHERE contains(lower(lines[i]), 'the of') ORDER BY doc_id, pos LIMIT 200",
    "search_wildcards": f"{_LINES} WHERE lower(lines[i]) LIKE '%th_ % or%' ORDER BY doc_id, pos LIMIT 100",
    "search_blank": f"{_LINES} WHERE false",
}
