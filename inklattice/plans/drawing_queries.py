"""Counts, extents, classes and the whole scan of drawings made from the driver's points and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inklattice import schema
from inklattice.operators import classify, rows, scan
from inklattice.plans import stand_ins as S


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as closed polylines and points as short texts, one document per label group."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = S.boxes(spark, d)
    x, y, x2, y2 = F.col("b_x"), F.col("b_y"), F.col("b_x") + F.col("b_w"), F.col("b_y") + F.col("b_h")
    lines = b.select(F.col("doc").cast("string").alias("document_hash"), (F.col("box") + 1_000_000_000).alias("seq"), F.lit("LINE").alias("kind"), F.array(point(x, y), point(x2, y), point(x2, y2), point(x, y2), point(x, y)).alias("points"), F.when(F.col("box") % 40 == 0, F.lit("DASHED")).alias("ltype"))
    frame = b.groupBy("doc").agg(F.min("b_x").alias("x"), F.min("b_y").alias("y"), F.max("b_x").alias("x2"), F.max("b_y").alias("y2"))
    top = F.greatest(F.col("y2"), F.col("y") + 1.6 * (F.col("x2") - F.col("x")))
    sides = frame.select(F.col("doc").cast("string").alias("document_hash"), F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("x").alias("at")), F.struct(F.lit(2).alias("k"), F.col("x2").alias("at")))).alias("s"), "y", top.alias("top"))
    sides = sides.select("document_hash", F.col("s.k").cast("long").alias("seq"), F.lit("LINE").alias("kind"), F.array(point(F.col("s.at"), F.col("y")), point(F.col("s.at"), F.col("top"))).alias("points"))
    t = S.points(spark, d).filter("seq % 50 <> 0").select(F.col("doc").cast("string").alias("document_hash"), (F.col("seq") + 10).alias("seq"), F.lit("TEXT").alias("kind"), "x", "y", F.when(F.col("seq") % 28 == 0, F.concat(F.lit("GY-"), F.col("seq").cast("string"))).otherwise(F.concat((F.col("seq") % 12).cast("string"), F.when(F.col("seq") % 8 == 0, F.lit("F")).otherwise(F.lit("D")))).alias("text"))
    serials = S.points(spark, d).filter("seq % 50 = 0").select(F.col("doc").cast("string").alias("document_hash"), (F.col("seq") + 500_000_000).alias("seq"), F.lit("ATTRIB").alias("kind"), F.lit("WireSerial").alias("tag"), "x", "y", F.concat(F.lit("ZL-"), F.col("seq"), F.lit("(1)")).alias("text"))
    empty = spark.createDataFrame([], schema.ENTITIES)
    return empty.unionByName(lines, allowMissingColumns=True).unionByName(sides, allowMissingColumns=True).unionByName(t, allowMissingColumns=True).unionByName(serials, allowMissingColumns=True)


def geometry_signature(spark: SparkSession, d: str) -> DataFrame:
    return classify.geometry_scores(classify.entity_counts(entities(spark, d)))


def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return classify.entity_counts(entities(spark, d))


def entity_extents(spark: SparkSession, d: str) -> DataFrame:
    return rows.entity_extents(entities(spark, d))


def scan_tables(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain on all drawings: what it finds of each document."""
    return scan.scan_summary(scan.scan(entities(spark, d)))


QUERIES = {f.__name__: f for f in (geometry_signature, entity_counts, entity_extents, scan_tables)}

#: Boxes are five-point lines, frames two uprights; texts and serials share the points.
_E = f"""WITH {S.POINTS_SQL}, {S.BOXES_SQL}, f AS (SELECT doc, min(b_x) AS x, min(b_y) AS y, max(b_x) AS x2, max(b_y) AS y2 FROM boxes GROUP BY doc),
  e AS (SELECT doc, count(*) + 2 AS lines FROM boxes GROUP BY doc), t AS (SELECT doc, count(*) FILTER (seq % 50 <> 0) AS text, count(*) FILTER (seq % 50 = 0) AS attr FROM points GROUP BY doc)"""
_C = "c AS (SELECT CAST(e.doc AS VARCHAR) AS document_hash, CAST(lines + text + attr AS DOUBLE) AS total, CAST(text AS DOUBLE) AS text, CAST(attr AS DOUBLE) AS attr, 0.0 AS block, 0.0 AS circ, 0.0 AS arc, CAST(lines AS DOUBLE) AS line, 0.0 AS h, 2.0 AS v, 0.0 AS eed FROM e JOIN t ON t.doc = e.doc)"
ORACLE_SQL: dict[str, str] = {
    "entity_counts": S.as_doubles(f"{_E}, {_C} SELECT * FROM c", "block", "circ", "arc", "h", "v", "eed"),
    "entity_extents": f"{_E}, b AS (SELECT boxes.doc, min(b_x) AS x, min(b_y) AS y, max(b_x + b_w) AS x2, greatest(max(b_y + b_h), any_value(greatest(f.y2, f.y + 1.6 * (f.x2 - f.x)))) AS y2 FROM boxes JOIN f ON f.doc = boxes.doc GROUP BY boxes.doc) SELECT CAST(doc AS VARCHAR) AS doc, x, y, x2 - x AS w, y2 - y AS h FROM b",
    "geometry_signature": S.as_doubles(
        f"""{_E}, {_C}, r AS (SELECT document_hash, total, text, attr, line, attr / line AS pa, line / total AS pl, text / total AS pt FROM c)
      SELECT document_hash, 0.0 AS circuit_loop, 0.0 AS terminal_strip, CASE WHEN total >= 20 AND pt > 0.85 AND pl < 0.05 THEN pt ELSE 0.0 END AS cable_schedule, 0.0 AS protection_diagram, 0.0 AS panel_layout, 0.0 AS panel_position, 0.0 AS monitoring_system,
      CASE WHEN total < 30 AND text > 5 THEN 0.5 + 0.5 * (1 - least(total / 30, 1.0)) ELSE 0.0 END AS unknown FROM r""",
        "circuit_loop", "terminal_strip", "cable_schedule", "protection_diagram", "panel_layout", "panel_position", "monitoring_system", "unknown",
    ),
}
