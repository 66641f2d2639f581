"""Rows, gaps, bands and groups along an axis, as window expressions."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from heapq import merge
from itertools import chain, islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inklattice.operators.grouped import per_document


def gap_statistics(items: DataFrame) -> DataFrame:
    """Per grp: gaps between neighbours in order of ``pos``: count, least, sample deviation, regular or not.

    Regular: all gaps over 2 and, with two gaps or more, a deviation of 5 at most.
    """
    w = Window.partitionBy("grp").orderBy("pos", "seq")
    gaps = items.withColumn("gap", F.col("pos") - F.lag("pos").over(w)).filter("gap IS NOT NULL")
    out = gaps.groupBy("grp").agg(F.count("*").alias("gaps"), F.min("gap").alias("least"), F.stddev_samp("gap").alias("dev"))
    return out.withColumn("regular", (F.col("least") > 2) & ((F.col("gaps") < 2) | (F.col("dev") <= 5)))


def split_groups(items: DataFrame, factor: float = 1.5) -> DataFrame:
    """Group numbers per grp: a gap over ``factor`` times the upper median gap begins a new group."""
    w = Window.partitionBy("grp").orderBy("pos", "seq")
    gaps = items.withColumn("gap", F.col("pos") - F.lag("pos").over(w))
    mid = gaps.filter("gap IS NOT NULL").groupBy("grp").agg(F.array_sort(F.collect_list("gap")).alias("g")).select("grp", F.element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int")).alias("median"))
    flag = F.when(F.col("gap") > factor * F.col("median"), 1).otherwise(0)
    return gaps.join(mid, "grp", "left").withColumn("part", F.sum(flag).over(w)).drop("gap", "median")


def bucket_rows(items: DataFrame, tol: float) -> DataFrame:
    """Row keys round(pos / tol) * tol, half to even; groups with fewer than two rows give none."""
    rows = items.withColumn("row", F.bround(F.col("pos") / tol) * tol).groupBy("grp", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("size", "seq"))), lambda s: s.seq.cast("string")), " ").alias("cells"), F.count("*").alias("n"))
    many = rows.groupBy("grp").agg(F.count("*").alias("k")).filter("k >= 2").select("grp")
    return rows.join(many, "grp", "left_semi")


def gap_clusters(items: DataFrame, gap: float) -> DataFrame:
    """Runs without a gap over ``gap``; the largest run of each grp (ties: the smaller span of size)."""
    w = Window.partitionBy("grp").orderBy("pos", "seq")
    runs = items.withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) > gap, 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    per = runs.groupBy("grp", "run").agg(F.count("*").alias("n"), (F.max("size") - F.min("size")).alias("span"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    best = per.groupBy("grp").agg(F.max_by(F.struct("run", "n", "low", "high"), F.struct(F.col("n"), -F.col("span"), -F.col("run"))).alias("r"))
    return best.select("grp", "r.*")


def bands(items: DataFrame, least: float = 30.0) -> DataFrame:
    """Bands between neighbouring distinct positions that are ``least`` high or more, with their index among all."""
    w = Window.partitionBy("grp").orderBy("pos")
    pos = items.select("grp", "pos").distinct()
    return pos.withColumn("top", F.lead("pos").over(w)).withColumn("ix", F.row_number().over(w) - 1).filter(F.col("top") - F.col("pos") >= least)


def device_rows(items: DataFrame, low: float = 5.0, high: float = 100.0) -> DataFrame:
    """Consecutive positions whose distance lies in [low, high]."""
    w = Window.partitionBy("grp").orderBy("pos", "seq")
    out = items.withColumn("next", F.lead("pos").over(w))
    return out.filter((F.col("next") - F.col("pos") >= low) & (F.col("next") - F.col("pos") <= high)).select("grp", "seq", "pos", "next")


def dominant_size(items: DataFrame) -> DataFrame:
    """The most common (rounded w, rounded h) per grp; ties to the first inserted.  items: grp, seq, w, h."""
    keyed = items.select("grp", "seq", F.bround("w").alias("w"), F.bround("h").alias("h"))
    per = keyed.groupBy("grp", "w", "h").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return per.groupBy("grp").agg(F.max_by(F.struct("w", "h", "n"), F.struct(F.col("n"), -F.col("first"))).alias("r")).select("grp", "r.*")


def cells_of_size(items: DataFrame, within: float = 3.0) -> DataFrame:
    """The items whose width and height lie within 3 of the dominant ones of their grp."""
    held = items.join(dominant_size(items).select("grp", F.col("w").alias("dw"), F.col("h").alias("dh")), "grp")
    return held.filter((F.abs(F.col("w") - F.col("dw")) <= within) & (F.abs(F.col("h") - F.col("dh")) <= within)).drop("dw", "dh")


def merged_lines(items: DataFrame) -> DataFrame:
    """Horizontal lines by half-unit rows of y: union span, longest segment and its seq.  items: grp, seq, y, x1, x2."""
    long = F.col("x2") - F.col("x1")
    keyed = items.withColumn("row", F.bround(F.col("y") * 2) / 2).withColumn("long", long)
    return keyed.groupBy("grp", "row").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.max("long").alias("longest"), F.max_by("seq", F.struct(F.col("long"), -F.col("seq"))).alias("seq"))


def ordered_within(items: DataFrame, by: list, order: list) -> DataFrame:
    return items.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def two_below(anchors: DataFrame, texts: DataFrame, reach: float = 300.0, take: int = 2) -> DataFrame:
    """The first ``take`` texts below each anchor within ``reach`` in x, nearest first.  The band of x is the key."""
    a = anchors.withColumn("band", F.floor(F.col("ax") / reach))
    t = texts.withColumn("band", F.explode(F.sequence(F.floor((F.col("x") - reach) / reach), F.floor((F.col("x") + reach) / reach))))
    met = a.join(t, ["doc", "band"]).filter((F.abs(F.col("x") - F.col("ax")) <= reach) & (F.col("y") < F.col("ay")))
    rank = F.row_number().over(Window.partitionBy("doc", "anchor").orderBy(F.col("ay") - F.col("y"), "seq"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= take).select("doc", "anchor", "rank", "seq")


def extents(points: DataFrame) -> DataFrame:
    """Bounding box per document; (0, 0, 1, 1) where nothing has coordinates."""
    out = points.groupBy("doc").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return out.select("doc", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("w", F.lit(1.0)).alias("w"), F.coalesce("h", F.lit(1.0)).alias("h"))


def entity_extents(entities: DataFrame) -> DataFrame:
    """Bounding box per document over its lines, circles and arcs; (0, 0, 1, 1) without any."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    r = F.coalesce("radius", F.lit(0.0))
    round_ = F.array(point(F.col("cx") - r, F.col("cy") - r), point(F.col("cx") + r, F.col("cy") + r))
    own = F.when(F.col("kind") == "LINE", F.col("points")).when(F.col("kind").isin("CIRCLE", "ARC") & F.col("cx").isNotNull(), round_)
    every = entities.select(F.col("document_hash").alias("doc"), F.explode_outer(own).alias("p"))
    return extents(every.select("doc", "p.x", "p.y"))


# A cross-section in a cable's model.
CROSS_SECTION = r"(\d+)[×x*](\d+(?:\.\d+)?)"


#: White space, as (?U) has it in Java.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Below:
    """A drawing's texts in bands of x of the reach's width, each from above; walked downwards from a height."""

    def __init__(self, texts: list[tuple[float, int, float, str]], reach: float):
        """texts: (-y, seq, x, text)."""
        self.reach, self.bands = reach, {}
        for t in sorted(texts, key=lambda t: t[:2]):
            self.bands.setdefault(math.floor(t[2] / reach), []).append(t)

    def first(self, x: float, y: float, seq: int, label: str, take: int = 2) -> list[str]:
        """The first texts strictly below a label within the reach, without the label itself and other texts like it."""
        band, found = math.floor(x / self.reach), []
        near = [self.bands[b] for b in (band - 1, band, band + 1) if b in self.bands]
        walks = [islice(own, bisect_right(own, -y, key=lambda t: t[0]), None) for own in near]
        for _, at, tx, text in merge(*walks, key=lambda t: t[:2]) if len(walks) > 1 else chain(*walks):
            if abs(tx - x) < self.reach and at != seq and text != label:
                found.append(text)
                if len(found) == take:
                    break
        return found


def _placed(x: float | None, y: float | None) -> bool:
    return x is not None and y is not None and math.isfinite(x) and math.isfinite(y)


def models_of(rows: list[dict], reach: float = 300.0) -> list[dict]:
    """Models of one document's cables (rows with a ``cable_id``) from its texts (the others)."""
    cables = {r["cable_id"] for r in rows if r["cable_id"] is not None}
    if not cables:
        return []
    texts = [(r["seq"], (r["text"] or "").strip(WHITE), r["x"], r["y"]) for r in rows if r["cable_id"] is None and r["text"] is not None]
    anchors: dict[str, tuple] = {}
    for seq, text, x, y in texts:
        bare = text[:at].rstrip(WHITE) if (at := text.find("(")) > 0 else text
        for rank, name in ((0, text),) if bare == text else ((0, text), (1, bare)):
            if name in cables and (name not in anchors or (rank, seq) < anchors[name][:2]):
                anchors[name] = (rank, seq, x, y)
    below = Below([(-y, seq, x, text) for seq, text, x, y in texts if text and _placed(x, y)], reach)
    out = []
    for cable, (_, seq, x, y) in anchors.items():
        two = below.first(x, y, seq, cable) if _placed(x, y) else []
        if two:
            section = next((m[2] for t in two if (m := re.search(CROSS_SECTION, t, re.ASCII))), "")
            out.append({"cable_id": cable, "model": " ".join(two), "cross_section": section})
    return out


def cable_models(cables: DataFrame, texts: DataFrame, reach: float = 300.0) -> DataFrame:
    """(cable_id, document_hash, model, cross_section): the two texts below a cable's label, and the first section in them.

    The label is the first text that is the id, else the first that is the id before a parenthesis.  Texts below it
    within ``reach`` in x count from above, without empty ones and the id itself.  cables: cable_id, document_hash;
    texts: document_hash, seq, text, x, y.  One pass over each document: tables that are dealt by document are not
    shuffled, and nothing is written.
    """
    none = lambda c: F.lit(None).cast(texts.schema[c].dataType).alias(c)
    asked = cables.select("document_hash", none("seq"), none("text"), none("x"), none("y"), "cable_id")
    every = texts.select("document_hash", "seq", "text", "x", "y", F.lit(None).cast("string").alias("cable_id")).unionByName(asked.filter("cable_id IS NOT NULL"))
    found = per_document(every, lambda rows: models_of(rows, reach), "cable_id string, document_hash string, model string, cross_section string, error string")
    return found.drop("error")
