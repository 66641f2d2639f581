"""Match tiers and set operations on match tables (cable, hash, match_type, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inklattice.functions import text as T
from inklattice.operators.grouped import arrow_schema


#: Characters of a key by which texts are looked up.
GRAM = 4


def _grams(text: Column, n: Column) -> Column:
    """Distinct runs of ``n`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n)))


#: Keys that are sent to every task; more are joined with the texts' runs.
KEYS = 100_000


def _held_by(keys: list[str], kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k, doc) of batches of (doc, text): keys whose last characters are among a text's runs are tested as a whole."""
    made_as = arrow_schema(f"k string, doc {kind}")
    ends: dict[int, dict[str, list[str]]] = {}
    for k in keys:
        ends.setdefault(min(len(k), GRAM), {}).setdefault(k[-GRAM:], []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found = b.column(0).to_pylist(), []
            for doc, text in zip(docs, b.column(1).to_pylist(), strict=True):
                for n, own in ends.items():
                    runs = {text[i : i + n] for i in range(len(text) - n + 1)}
                    found += [(k, doc) for gram in (own.keys() & runs) for k in own[gram] if k in text]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], made_as[i].type) for i in (0, 1)], schema=made_as)

    return run


def containing(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, doc): texts that hold a key anywhere.  keys: k; texts: doc, text.

    A key is looked up by its last ``GRAM`` characters (all, if it has fewer) among those of the texts; then the whole
    key is tested.  Up to ``KEYS`` keys go to the texts' tasks; with more, runs that some key ends with are joined with the keys.
    """
    given = keys.filter("k <> ''").select("k").distinct()
    few = [r.k for r in given.limit(KEYS + 1).collect()]
    if len(few) <= KEYS:
        kind = texts.schema["doc"].dataType.simpleString()
        return texts.filter("text <> ''").select("doc", "text").mapInArrow(_held_by(few, kind), f"k string, doc {kind}").distinct()
    return containing_joined(given, texts)


def containing_joined(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for any number of keys, by an equi-join on the last characters; only runs that some key ends with leave a text."""
    size = F.least(F.length("k"), F.lit(GRAM))
    ends = keys.filter("k <> ''").select("k").distinct().select("k", size.alias("n"), F.expr(f"right(k, {GRAM})").alias("gram"))
    sizes = [r.n for r in ends.select("n").distinct().collect()]  # GRAM at most
    if not sizes:
        return keys.select("k").limit(0).withColumn("doc", F.lit(None).cast(texts.schema["doc"].dataType))
    every = texts.filter("text <> ''").select("doc", F.explode(F.array(*map(F.lit, sizes))).alias("n"), "text").select("doc", F.explode(_grams(F.col("text"), F.col("n"))).alias("gram"))
    # Runs and pairs are many times what their tables' sizes let expect, so neither side of a join is broadcast.
    met = every.join(ends.hint("merge"), "gram").select("doc", "k")
    return met.join(texts.select("doc", "text").hint("merge"), "doc").filter(F.col("text").contains(F.col("k"))).select("k", "doc").distinct()


def tiered(targets: DataFrame, texts: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(target, doc, match_type): best tier at which a target occurs in a document's text.

    targets: target; texts: doc, text.  The first three tiers are substring tests: of the target, of both sides
    normalised, and of the target's variants with one confused character.  The fourth (``fuzzy``) compares tokens.
    """
    t = targets.select("target").distinct()
    tier = lambda found, name: found.select("target", "doc", F.lit(name).alias("match_type"))
    exact = tier(containing(t.withColumnRenamed("target", "k"), texts).withColumnRenamed("k", "target"), "exact")
    nt = t.select("target", T.normalized(F.col("target")).alias("k"))
    normal = tier(containing(nt, texts.select("doc", T.normalized(F.col("text")).alias("text"))).join(nt.hint("merge"), "k"), "normalized")
    variants = t.select("target", F.explode(T.confusion_variants(F.col("target"))).alias("k")).filter("k <> ''")
    confused = tier(containing(variants, texts).join(variants.hint("merge"), "k"), "confusion")
    every = exact.union(normal).union(confused)
    if fuzzy:
        token = texts.select("doc", F.explode(F.array_distinct(F.split(F.col("text"), r"\s+"))).alias("token")).filter("token <> ''")

        # Strings at distance one agree on a copy with one character deleted (or are equal): an equi-join on those.
        def deletions(df: DataFrame, c: str) -> DataFrame:
            cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))
            return df.withColumn("k", F.explode(F.array_distinct(F.concat(F.array(F.col(c)), cuts))))

        near = deletions(token, "token").join(deletions(t, "target").hint("merge"), "k").filter(F.levenshtein("token", "target") <= 1)
        every = every.union(tier(near, "levenshtein"))
    return every.groupBy("target", "doc").agg(F.min_by("match_type", T.tier_rank(F.col("match_type"))).alias("match_type"))


def ids_in_json(dumps: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, document_hash): the least document whose raw JSON has a text that is the id, without what follows a parenthesis.

    dumps: document_hash, content; ids: id.
    """
    t = dumps.select("document_hash", F.explode(F.regexp_extract_all("content", F.lit(r'"text"\s*:\s*"([^"]*)"'), F.lit(1))).alias("t"))
    bare = t.select("document_hash", T.strip(F.substring_index("t", "(", 1)).alias("id"))
    return bare.join(ids.select("id").distinct(), "id").groupBy("id").agg(F.min("document_hash").alias("document_hash"))


def best_of_stages(stages: list[DataFrame], keys: list[str], tier: str = "match_type", order: str = "row_ix") -> DataFrame:
    """Union of stages; per key the row of the best tier, ties to the earliest stage and row.  Adds ``stage``."""
    every = None
    for k, s in enumerate(stages):
        own = s.withColumn("stage", F.lit(k + 1))
        every = own if every is None else every.unionByName(own)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(T.tier_rank(F.col(tier)), "stage", order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def run_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both runs with a side: both, only_a, only_b.  One shuffle by key."""
    x, y = a.select(*keys).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)), b.select(*keys).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    both = x.union(y).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return both.select(*keys, F.when(F.col("_a") + F.col("_b") == 2, "both").when(F.col("_a") == 1, "only_a").otherwise("only_b").alias("side"))


def multi_hit(matches: DataFrame, key: str, of: str) -> DataFrame:
    return matches.groupBy(key).agg(F.countDistinct(of).alias("n")).filter("n > 1")


def merge_summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy("stage", "match_type").agg(F.count("*").alias("n"), F.countDistinct("cable").alias("cables"), F.countDistinct("hash").alias("hashes"))


def stage_filter(spec: str, count: int) -> list[int]:
    """``all``, ``1-4`` or ``1,3,5`` as stage numbers; out of bounds is an error."""
    if spec == "all":
        return list(range(1, count + 1))
    out: list[int] = []
    for part in spec.split(","):
        low, _, high = part.partition("-")
        if not low.isdigit() or (high and not high.isdigit()):
            raise ValueError(f"bad stage filter: {spec}")
        for k in range(int(low), int(high or low) + 1):
            if not 1 <= k <= count:
                raise ValueError(f"no stage {k}")
            if k not in out:
                out.append(k)
    return out
