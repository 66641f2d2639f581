"""MinHash near-dedup with HyperMinHash sketches (operator 8).

A document's set holds its distinct five-word shingles (A-Z folded; the whole sequence if it has fewer
words).  Steps:

1. Sketch: each shingle hash falls into one of ``rows * bands`` buckets; a bucket keeps the smallest value as
   its count of leading zeros (6 bits) and the ten bits after them (mantissa).  Empty buckets borrow from
   others (optimal densification), so that short texts can be banded too.
2. Documents with the same set are one class; the rest of the work is on one representative each, so a large
   group of copies costs one row.
3. Bands of compressed registers give buckets of candidates.  Each member is compared with the bucket's
   leader only: the collision-corrected estimate first, then the full sets.
4. Where a bucket still holds several components after that, a further leader is tried, and finally every pair
   of members from different components that an odd sketch allows and that was not compared yet; the members of a
   large bucket are dealt to parts of ``PART_ROWS`` for that.  The sketch
   holds, for each of 1024 bins, whether an odd number of shingles fell into it; two sketches differ in at most
   as many bins as the sets differ in shingles, so no pair that it rules out can be a link.  No bucket is capped.
5. Components of the confirmed links name the groups.

Nulls and texts without words have no shingles: n_shingles 0, linked with nothing, kept.  Rows with a null id are
linked with nothing: component_id null, kept.  Repeated rows with the same id and text give one row each with the same
group; rows of one id with different texts are different documents of one name.  Ties go to the smallest id.  Ids are integers.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inklattice.llm.common import discard, materialize, mix64, ngram_hashes, word_hashes
from inklattice.llm.components import components

SHINGLE = 5
ROWS = 6
#: Chance that a pair of exactly the threshold's similarity shares no band.
MISS = 1e-6
MANTISSA_BITS = 10
PROBES = 64
ODD_BITS = 1024
#: Rounds in which unsettled buckets get further leaders before all pairs left are compared.
LEADER_ROUNDS = 1
#: Members of a bucket that one task pairs with the others.
PART_ROWS = 4096


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return ceil(log(miss) / log(1 - threshold**rows))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(column)
    for at, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = words[at:stop]
        yield np.unique(ngram_hashes(own, min(SHINGLE, max(len(own), 1))))


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """HyperMinHash registers (one row of m 16-bit values for each set; an empty set has zeros)."""
    least = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    for row, s in zip(least, sets, strict=True):
        if len(s):
            h = mix64(s ^ np.uint64(0x51ED270B7F1F5D35))
            bucket = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(row, bucket.astype(np.int64), mix64(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(1))
    empty = least == np.iinfo(np.uint64).max
    value = np.maximum(least, np.uint64(1))
    zeros = 62 - np.floor(np.log2(np.minimum(value, np.uint64(1 << 62)).astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 62 - MANTISSA_BITS)
    mantissa = (value >> (62 - zeros - MANTISSA_BITS).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    out[empty] = 0
    return _densified(out, empty)


def _densified(out: np.ndarray, empty: np.ndarray) -> np.ndarray:
    m = out.shape[1]
    held = ~empty
    row, col = np.nonzero(empty & held.any(axis=1)[:, None])
    filled = out.copy()
    for probe in range(1, PROBES + 1):
        if not len(row):
            return filled
        to = (mix64(col.astype(np.uint64) * np.uint64(PROBES + 1) + np.uint64(probe)) % np.uint64(m)).astype(np.int64)
        got = held[row, to]
        filled[row[got], col[got]] = out[row[got], to[got]]
        row, col = row[~got], col[~got]
    for r, c in zip(row.tolist(), col.tolist(), strict=True):  # rare: sets of few shingles, next bucket that holds one
        at = np.flatnonzero(held[r])
        filled[r, c] = out[r, at[np.searchsorted(at, c) % len(at)]]
    return filled


def expected_collisions(m: int) -> float:
    """How many registers of unrelated sets agree by chance: their leading zeros and mantissas must both."""
    return m * 2.0**-MANTISSA_BITS / 3


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for chance collisions."""
    m = a.shape[1]
    chance = expected_collisions(m)
    return np.clip(((a == b).sum(axis=1) - chance) / (m - chance), 0, 1)


def sketch(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, set_hi, set_lo (digest of the set), registers and band keys of each document."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix64(np.arange(1, m + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            digests = _digests(sets)
            regs = registers(sets, m)
            keys = mix64((mix64(regs.reshape(-1, bands, rows).astype(np.uint64) * weights)).sum(axis=2) + np.arange(bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "set_hi", "set_lo", "registers", "bands", "odd"],
            )

    return docs.select("id", "text").mapInArrow(run, "id long, n_shingles long, set_hi long, set_lo long, registers binary, bands array<long>, odd array<long>")


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate, within six standard errors, allows the threshold."""
    side = lambda name: sketches.select(F.col("id").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("registers").alias(f"r{name}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in ("ra", "rb"))
            n = np.minimum(np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()), a.shape[1])
            near = estimate(a, b) >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / n)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets], np.int64).reshape(-1, 2)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The full shingle sets (id: of the node).  nodes: id, rep, set_hi, set_lo; rep has a document with that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            # A document of the same id may have another text.
            own = pa.array((_digests(sets) == np.stack([batch.column(k).to_numpy() for k in (2, 3)], axis=1)).all(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(own), pa.array([s.tobytes() for s in sets], pa.binary()).filter(own)], ["id", "shingles"])

    named = docs.select(F.col("id").alias("rep"), "text").join(nodes, "rep")
    return named.select("id", "text", "set_hi", "set_lo").mapInArrow(run, "id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum()) if len(t) else 0
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    side = lambda a: sets.select(F.col("id").alias(a), F.col("shingles").alias(f"s{a}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """ODD_BITS parities of shingle counts by bin, in 64-bit integers."""
    bins = (mix64(shingles ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(ODD_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=ODD_BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _allowed(l: str, r: str, percent: int) -> Column:
    """False only if the sets of two rows (structs or aliases with n and odd) surely differ too much for a link."""
    differ = F.lit(0)
    for k in range(ODD_BITS // 64):
        differ = differ + F.bit_count(F.col(f"{l}.odd")[k].bitwiseXOR(F.col(f"{r}.odd")[k]))
    return differ * (100 + percent) <= (100 - percent) * (F.col(f"{l}.n") + F.col(f"{r}.n"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept.

    Links: 100 * intersection >= percent * union of the sets.
    """
    threshold = percent / 100
    bands = bands_for(threshold, rows)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(sketch(docs, bands, rows), "sketch")
    linked = sketches.filter("n_shingles > 0 and id is not null")
    classes = linked.groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep"))
    # A class is named by its smallest id, or by its digest if that id has several texts.
    twice = F.count("*").over(Window.partitionBy("rep")) > 1
    classes = materialize(classes.withColumn("node", F.when(twice, F.xxhash64("set_hi", "set_lo")).otherwise(F.col("rep"))), "classes")
    first = classes.withColumnRenamed("rep", "id")
    reps = linked.join(first, ["id", "set_hi", "set_lo"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "n_shingles", "registers", "bands", "odd")
    reps = materialize(reps, "reps")
    spread = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1").select("key", "leader")
    members = materialize(spread.join(shared, "key").select("key", "id", F.col("n_shingles").alias("n"), "leader"), "members")

    tried = materialize(members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    near = materialize(_estimated(tried, reps, threshold), "near")
    nodes = classes.withColumnRenamed("node", "id").join(members.select("id").distinct(), "id", "left_semi")
    sets = materialize(full_sets(docs.filter("id is not null"), nodes).dropDuplicates(["id"]), "sets") if not members.isEmpty() else None
    comps = None
    if sets is not None:
        links = materialize(_confirmed(near, sets, percent), "confirmed")
        bounded = None
        for step in range(LEADER_ROUNDS + 2):
            comps = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "comps")
            if step == LEADER_ROUNDS + 1:
                break
            placed = (members if bounded is None else bounded).drop("leader", "comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
            open_ = placed.join(mixed, "key", "left_semi")
            if bounded is None:
                open_ = open_.join(reps.select("id", "odd"), "id")
            bounded = open_ = materialize(open_, "open")
            if open_.isEmpty():
                break
            if step < LEADER_ROUNDS:
                # In each bucket, members outside the largest component meet one of its members.
                heads = open_.groupBy("key", "comp").agg(F.min_by(F.struct("id", "n", "odd"), F.xxhash64("id", "key", F.lit(step))).alias("head"), F.count("*").alias("size"))
                best = heads.groupBy("key").agg(F.max_by(F.struct("comp", "head"), F.struct("size", "comp")).alias("top")).select("key", F.col("top.comp").alias("top"), "top.head")
                pairs = open_.alias("l").join(best.alias("r"), "key").filter((F.col("comp") != F.col("top")) & _allowed("l", "head", percent)).select(F.col("head.id").alias("a"), F.col("id").alias("b"))
            else:
                parts = open_.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
                dealt = open_.join(parts, "key")
                left = dealt.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
                right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                may = (F.col("l.comp") < F.col("r.comp")) & _allowed("l", "r", percent)
                pairs = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part")) & may).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
            tried = tried.union(pairs)
            links = links.union(materialize(_confirmed(_estimated(pairs, reps, threshold), sets, percent), "confirmed"))
        discard(sets)
    named = classes
    if comps is not None:
        placed = classes.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = placed.groupBy("comp").agg(F.min("rep").alias("rep"))
        named = placed.drop("rep").join(least, "comp")
    slim = sketches.select("id", "n_shingles", "set_hi", "set_lo")
    out = slim.join(named.select("set_hi", "set_lo", "rep"), ["set_hi", "set_lo"], "left")
    group = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents without those near to a kept one; all columns stay as they are.

    Rows with a null id stay, and all rows of an id that has a kept one.
    """
    judged = near_groups(docs, id_col, text_col, percent).filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_gone_id")).agg(F.max("kept").alias("kept"))
    gone = judged.filter("not kept").select("_gone_id")
    return docs.join(gone, docs[id_col] == F.col("_gone_id"), "left_anti")
