"""Spatial joins and axis operators on points, boxes and readings, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inklattice.operators import rows, spatial
from inklattice.plans import stand_ins as S


def _right(spark: SparkSession, d: str, every: int = 3) -> DataFrame:
    """The points that are targets; all others ask for them, so that every point takes part."""
    return S.points(spark, d).filter(F.col("seq") % every == 0).select("doc", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("seq").alias("rseq"))


def point_in_bbox(spark: SparkSession, d: str) -> DataFrame:
    return spatial.points_in_boxes(S.points(spark, d), S.boxes(spark, d)).select("doc", "seq", "box")


def smallest_bbox(spark: SparkSession, d: str) -> DataFrame:
    return spatial.smallest_box(S.points(spark, d), S.boxes(spark, d))


def radius_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_radius(S.points(spark, d).filter("seq % 3 <> 0"), _right(spark, d), 12.0).select("doc", "seq", "rseq", F.round("dist", 6).alias("dist"))


def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(S.points(spark, d).filter("seq % 3 <> 0"), _right(spark, d), 30.0).withColumn("dist", F.round("dist", 6))


def nearest_wire_type(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(S.points(spark, d).filter("seq % 5 <> 0"), _right(spark, d, 5), 25.0, metric="manhattan").withColumn("dist", F.round("dist", 6))


def nearest_same_row(spark: SparkSession, d: str) -> DataFrame:
    return spatial.same_row(S.points(spark, d).filter("seq % 3 <> 0"), _right(spark, d), 3.0, 60.0)


def nearest_above(spark: SparkSession, d: str) -> DataFrame:
    return spatial.above(S.points(spark, d).filter("seq % 3 <> 0"), _right(spark, d), 10.0, 40.0)


def close_point_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.close_pairs(S.points(spark, d), 4.0).withColumn("dist", F.round("dist", 6))


def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.clusters(S.points(spark, d), 4.0)


def sibling_relations(spark: SparkSession, d: str) -> DataFrame:
    return spatial.sibling_relations(S.boxes(spark, d))


def contains_relations(spark: SparkSession, d: str) -> DataFrame:
    b = S.boxes(spark, d)
    wide = b.select("doc", (F.col("box") + 1000000).alias("box"), (F.col("b_x") - 20).alias("b_x"), (F.col("b_y") - 20).alias("b_y"), (F.col("b_w") + 60).alias("b_w"), (F.col("b_h") + 60).alias("b_h"))
    return spatial.contains_pairs(b.union(wide))


def gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rows.gap_statistics(S.readings(spark, d)).withColumn("dev", F.round("dev", 6)).withColumn("least", F.round("least", 6))


def gap_groups(spark: SparkSession, d: str) -> DataFrame:
    return rows.split_groups(S.readings(spark, d)).select("grp", "seq", "part")


def y_bucket_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows.bucket_rows(S.readings(spark, d), 5.0)


def x_clusters(spark: SparkSession, d: str) -> DataFrame:
    return rows.gap_clusters(S.readings(spark, d), 20.0)


def divider_bands(spark: SparkSession, d: str) -> DataFrame:
    return rows.bands(S.readings(spark, d))


def spine_device_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows.device_rows(S.readings(spark, d))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Readings as rectangles: widths from the place, heights from the size."""
    return S.readings(spark, d).select("grp", "seq", (F.col("pos") / 8).alias("w"), (F.col("size") / 4).alias("h"))


def dominant_cell(spark: SparkSession, d: str) -> DataFrame:
    return rows.dominant_size(_sized(spark, d))


def cells_of_size(spark: SparkSession, d: str) -> DataFrame:
    return rows.cells_of_size(_sized(spark, d)).select("grp", "seq")


def union_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = S.readings(spark, d).select("grp", "seq", F.col("size").alias("y"), F.col("pos").alias("x1"), (F.col("pos") + F.col("seq") % 90).alias("x2"))
    return rows.merged_lines(lines)


def core_order(spark: SparkSession, d: str) -> DataFrame:
    return rows.ordered_within(S.readings(spark, d), ["grp", "event_type"], [F.col("pos").desc(), F.col("seq")]).select("seq", "ord")


def texts_below(spark: SparkSession, d: str) -> DataFrame:
    p = S.points(spark, d)
    a = p.filter("seq % 10 = 0").select("doc", F.col("seq").alias("anchor"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return rows.two_below(a, p.filter("seq % 10 <> 0"), 30.0)


def drawing_extents(spark: SparkSession, d: str) -> DataFrame:
    return rows.extents(S.points(spark, d)).withColumn("w", F.round("w", 6)).withColumn("h", F.round("h", 6))


QUERIES = {f.__name__: f for f in (
    point_in_bbox, smallest_bbox, radius_join, nearest_join, nearest_wire_type, nearest_same_row, nearest_above, close_point_pairs, dbscan_clusters, sibling_relations, contains_relations,
    gap_statistics, gap_groups, y_bucket_rows, x_clusters, divider_bands, spine_device_rows, dominant_cell, cells_of_size, union_lines, core_order, texts_below, drawing_extents,
)}

_P, _B, _R = S.POINTS_SQL, f"{S.POINTS_SQL}, {S.BOXES_SQL}", S.READINGS_SQL
_NEAR = "SELECT doc, seq, rseq, round(dist, 6) AS dist FROM (SELECT l.doc, l.seq, r.seq AS rseq, {d} AS dist, row_number() OVER (PARTITION BY l.doc, l.seq ORDER BY {d}, r.seq) AS k FROM points l JOIN points r ON r.doc = l.doc AND l.seq % {n} <> 0 AND r.seq % {n} = 0 AND {d} <= {m}) WHERE k = 1"
_E, _M = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))", "(abs(l.x - r.x) + abs(l.y - r.y))"

_SIZES = "k AS (SELECT grp, seq, round_even(pos / 8, 0) AS w, round_even(size / 4, 0) AS h FROM readings), p AS (SELECT grp, w, h, count(*) AS n, min(seq) AS first FROM k GROUP BY 1, 2, 3), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, first) AS r FROM p) WHERE r = 1)"

ORACLE_SQL = {
    "point_in_bbox": f"WITH {_B} SELECT p.doc, seq, box FROM points p JOIN boxes b ON p.doc = b.doc AND x BETWEEN b_x AND b_x + b_w AND y BETWEEN b_y AND b_y + b_h",
    "smallest_bbox": f"WITH {_B} SELECT doc, seq, box FROM (SELECT p.doc, seq, box, row_number() OVER (PARTITION BY p.doc, seq ORDER BY b_w * b_h, box) AS r FROM points p JOIN boxes b ON p.doc = b.doc AND x BETWEEN b_x AND b_x + b_w AND y BETWEEN b_y AND b_y + b_h) WHERE r = 1",
    "radius_join": f"WITH {_P} SELECT l.doc, l.seq, r.seq AS rseq, round({_E}, 6) AS dist FROM points l JOIN points r ON l.doc = r.doc AND l.seq % 3 <> 0 AND r.seq % 3 = 0 AND {_E} <= 12.0",
    "nearest_join": f"WITH {_P} " + _NEAR.format(d=_E, n=3, m=30.0),
    "nearest_wire_type": f"WITH {_P} " + _NEAR.format(d=_M, n=5, m=25.0),
    "nearest_same_row": f"WITH {_P} SELECT doc, seq, rseq FROM (SELECT l.doc, l.seq, r.seq AS rseq, row_number() OVER (PARTITION BY l.doc, l.seq ORDER BY abs(l.y - r.y), abs(l.x - r.x), r.seq) AS k FROM points l JOIN points r ON l.doc = r.doc AND l.seq % 3 <> 0 AND r.seq % 3 = 0 AND abs(l.y - r.y) <= 3 AND abs(l.x - r.x) <= 60) WHERE k = 1",
    "nearest_above": f"WITH {_P} SELECT doc, seq, rseq FROM (SELECT l.doc, l.seq, r.seq AS rseq, row_number() OVER (PARTITION BY l.doc, l.seq ORDER BY abs(l.x - r.x), r.y - l.y, r.seq) AS k FROM points l JOIN points r ON l.doc = r.doc AND l.seq % 3 <> 0 AND r.seq % 3 = 0 AND r.y > l.y AND r.y - l.y <= 40 AND abs(l.x - r.x) <= 10) WHERE k = 1",
    "close_point_pairs": f"WITH {_P} SELECT l.doc, l.seq, r.seq AS rseq, round({_E}, 6) AS dist FROM points l JOIN points r ON l.doc = r.doc AND l.seq < r.seq AND {_E} <= 4.0",
    "dbscan_clusters": f"WITH RECURSIVE {_P}, e AS (SELECT l.doc, l.seq AS a, r.seq AS b FROM points l JOIN points r ON l.doc = r.doc AND l.seq <> r.seq AND {_E} <= 4.0), reach AS (SELECT doc, a, a AS b FROM e UNION SELECT reach.doc, reach.a, e.b FROM reach JOIN e ON e.doc = reach.doc AND e.a = reach.b) SELECT doc, a AS seq, min(b) AS cluster FROM reach GROUP BY 1, 2",
    "sibling_relations": f"WITH {_B}, c AS (SELECT doc, box AS seq, b_x + b_w / 2 AS x, b_y + b_h / 2 AS y FROM boxes) SELECT l.doc, l.seq, r.seq AS rseq, CASE WHEN abs(l.x - r.x) <= 8 THEN 'ALIGNED_VERT' WHEN abs(l.y - r.y) <= 8 THEN 'ALIGNED_HORZ' ELSE 'NEAR' END AS relation, round({_E}, 1) AS distance FROM c l JOIN c r ON l.doc = r.doc AND l.seq < r.seq AND {_E} <= 40",
    "contains_relations": f"WITH {_B}, a AS (SELECT * FROM boxes UNION ALL SELECT doc, box + 1000000, b_x - 20, b_y - 20, b_w + 60, b_h + 60 FROM boxes) SELECT o.doc, o.box AS outer, i.box AS inner FROM a o JOIN a i ON o.doc = i.doc AND o.box <> i.box AND i.b_x >= o.b_x AND i.b_y >= o.b_y AND i.b_x + i.b_w <= o.b_x + o.b_w AND i.b_y + i.b_h <= o.b_y + o.b_h AND (i.b_x + i.b_w - i.b_x < o.b_w OR i.b_y + i.b_h - i.b_y < o.b_h)",
    "gap_statistics": f"WITH {_R}, g AS (SELECT grp, pos - lag(pos) OVER (PARTITION BY grp ORDER BY pos, seq) AS gap FROM readings) SELECT grp, count(*) AS gaps, round(min(gap), 6) AS least, round(stddev_samp(gap), 6) AS dev, min(gap) > 2 AND (count(*) < 2 OR stddev_samp(gap) <= 5) AS regular FROM g WHERE gap IS NOT NULL GROUP BY grp",
    "gap_groups": f"WITH {_R}, g AS (SELECT grp, seq, pos, pos - lag(pos) OVER (PARTITION BY grp ORDER BY pos, seq) AS gap FROM readings), m AS (SELECT grp, list_sort(list(gap))[count(*) // 2 + 1] AS median FROM g WHERE gap IS NOT NULL GROUP BY grp) SELECT g.grp, seq, CAST(sum(CASE WHEN gap > 1.5 * median THEN 1 ELSE 0 END) OVER (PARTITION BY g.grp ORDER BY pos, seq) AS BIGINT) AS part FROM g LEFT JOIN m ON m.grp = g.grp",
    "y_bucket_rows": f"WITH {_R}, k AS (SELECT grp, seq, size, round_even(pos / 5.0, 0) * 5.0 AS row FROM readings), r AS (SELECT grp, row, string_agg(CAST(seq AS VARCHAR), ' ' ORDER BY size, seq) AS cells, count(*) AS n FROM k GROUP BY 1, 2) SELECT * FROM r WHERE grp IN (SELECT grp FROM r GROUP BY grp HAVING count(*) >= 2)",
    "x_clusters": f"WITH {_R}, f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY grp ORDER BY pos, seq) > 20 THEN 1 ELSE 0 END AS new FROM readings), u AS (SELECT *, CAST(sum(new) OVER (PARTITION BY grp ORDER BY pos, seq) AS BIGINT) AS run FROM f), p AS (SELECT grp, run, count(*) AS n, max(size) - min(size) AS span, min(pos) AS low, max(pos) AS high FROM u GROUP BY 1, 2) SELECT grp, run, n, low, high FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, span, run) AS r FROM p) WHERE r = 1",
    "divider_bands": f"WITH {_R}, p AS (SELECT DISTINCT grp, pos FROM readings), w AS (SELECT grp, pos, lead(pos) OVER (PARTITION BY grp ORDER BY pos) AS top, CAST(row_number() OVER (PARTITION BY grp ORDER BY pos) - 1 AS INT) AS ix FROM p) SELECT * FROM w WHERE top - pos >= 30",
    "spine_device_rows": f"WITH {_R}, w AS (SELECT grp, seq, pos, lead(pos) OVER (PARTITION BY grp ORDER BY pos, seq) AS next FROM readings) SELECT * FROM w WHERE next - pos >= 5 AND next - pos <= 100",
    "dominant_cell": f"WITH {_R}, {_SIZES} SELECT grp, w, h, n FROM top",
    "cells_of_size": f"WITH {_R}, {_SIZES} SELECT r.grp, r.seq FROM readings r JOIN top ON top.grp = r.grp WHERE abs(pos / 8 - w) <= 3 AND abs(size / 4 - h) <= 3",
    "union_lines": f"WITH {_R}, k AS (SELECT *, round_even(size * 2, 0) / 2 AS row, pos + seq % 90 AS x2, seq % 90 AS long FROM readings) SELECT grp, row, min(pos) AS x1, max(x2) AS x2, CAST(max(long) AS DOUBLE) AS longest, arg_max(seq, (long, -seq)) AS seq FROM k GROUP BY 1, 2",
    "core_order": f"WITH {_R} SELECT seq, CAST(row_number() OVER (PARTITION BY grp, event_type ORDER BY pos DESC, seq) AS INT) AS ord FROM readings",
    "texts_below": f"WITH {_P} SELECT doc, anchor, CAST(rank AS INT) AS rank, seq FROM (SELECT a.doc, a.seq AS anchor, t.seq, row_number() OVER (PARTITION BY a.doc, a.seq ORDER BY a.y - t.y, t.seq) AS rank FROM points a JOIN points t ON a.doc = t.doc AND a.seq % 10 = 0 AND t.seq % 10 <> 0 AND abs(t.x - a.x) <= 30 AND t.y < a.y) WHERE rank <= 2",
    "drawing_extents": f"WITH {_P} SELECT doc, min(x) AS x, min(y) AS y, round(max(x) - min(x), 6) AS w, round(max(y) - min(y), 6) AS h FROM points GROUP BY doc",
}
