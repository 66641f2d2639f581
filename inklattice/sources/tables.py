"""Readers of row tables for the rule language: every row an array of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_cells(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows as ``cells`` (array of strings in column order), beside key columns."""
    return rows.select(*keys, F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns if c not in keys]).alias("cells"))


def read_rows(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, list[str]]:
    """(row, cells) of a table with a header, and the header; rows are numbered from 2, as in a sheet.

    Files of one folder are numbered one after the other in the order in which they are read.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if fmt == "csv" else spark.read
    rows = reader.format(fmt).load(path)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return as_cells(numbered, "_row").withColumnRenamed("_row", "row"), rows.columns


def header_index(header: list[str]) -> dict[str, int]:
    """Place of each column, from 1; of equal names the first counts."""
    out: dict[str, int] = {}
    for k, name in enumerate(header):
        out.setdefault(name.strip(), k + 1)
    return out
