"""Benchmark decontamination by a positional inverted index (operator 10), in DataFrame functions only.

1. Count in all documents the words that benchmark windows use.
2. Each window takes its two rarest words as anchors.  The index holds, for each document and anchor word, the
   list of positions; it is written to the shared folder.
3. Search: the positions of a window's rarest word meet those of its second in the same document; both lists become
   window starts by subtracting the anchors' offsets and are intersected.  Equal starts are candidates for exact
   phrases; starts that differ by 1 to ``slack`` are candidates for proximity matches.
4. Candidates are compared with the document's own words: exact ones by a 64-bit hash of the whole window, near ones
   by the share of the window's distinct words that stand within ``slack`` words of its place (``NEAR_SHARE`` or more).

No step gathers more in one row than one document's starts of the windows that it may hold.  A document is named by a
64-bit hash of its id and text; agreements by chance fall to the comparison with its own words.

Words: A-Z folded, then runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  A window is
``size`` consecutive words of an item; a shorter item is one window, an item without words has none.

Nulls: a null text has no words; a null item id is left out; rows with a null document id are judged like others.
Repeated document rows each get their own row, also those of one id with different texts; repeated items count once.
Ties between anchors go to the smaller word, then the smaller offset.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inklattice.llm.common import materialize

WINDOW = 10
SLACK = 2
#: Rows up to which a table is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text up to which the table of windows is.
BROADCAST_BYTES = 16 << 20
#: Share of a window's distinct words that a proximity match holds.
NEAR_SHARE = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is: texts of ASCII alone take the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), BREAKS), "")


def _small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: words, win (hash), len, items (sorted ids as strings)."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.col("item").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("win", F.xxhash64("words")).withColumn("len", F.size("words"))


def anchors(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """term, off: the rarest word of each window and its offset; term2, off2: the second rarest."""
    at = wins.select("win", F.posexplode("words").alias("off", "term")).join(counts, "term", "left")
    least = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off")
    ranked = at.groupBy("win").agg(F.slice(F.array_sort(F.collect_list(least)), 1, 2).alias("r"))
    second = F.element_at("r", -1)
    return ranked.select("win", F.col("r")[0].term.alias("term"), F.col("r")[0].off.alias("off"), second.term.alias("term2"), second.off.alias("off2"))


def build_index(docs: DataFrame, uses: DataFrame) -> DataFrame:
    """Postings (key, term, positions) of all anchors, written to the shared folder."""
    terms = uses.select("term").union(uses.select("term2")).distinct()
    at = docs.select("key", F.posexplode("words").alias("pos", "term")).join(_small(terms, terms.count()), "term")
    return materialize(at.groupBy("key", "term").agg(F.sort_array(F.collect_set("pos")).alias("positions")), "postings")


def search(index: DataFrame, uses: DataFrame, rows: int, slack: int = SLACK) -> DataFrame:
    """(key, win, exact, near): starts that both anchors give, and starts of the rarest word near to one of the second."""
    rarest = index.join(_small(uses, rows), "term").select("key", "win", "off", F.col("term2").alias("term"), "off2", F.col("positions").alias("first"))
    met = rarest.join(index, ["key", "term"])
    starts = met.select("key", "win", F.transform("first", lambda p: p - F.col("off")).alias("a"), F.transform("positions", lambda p: p - F.col("off2")).alias("b"))
    beside = F.flatten(F.transform("b", lambda p: F.array(*[p + d for d in range(-slack, slack + 1) if d]))) if slack else F.array().cast("array<int>")
    both = starts.select("key", "win", F.array_intersect("a", "b").alias("exact"), F.array_except(F.array_intersect("a", beside), "b").alias("near"))
    return both.withColumn("exact", F.filter("exact", lambda p: p >= 0)).filter((F.size("exact") > 0) | (F.size("near") > 0))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def verified(docs: DataFrame, found: DataFrame, wins: DataFrame, n_bytes: int, slack: int = SLACK) -> DataFrame:
    """(key, hits, near): arrays of (start, len, items), by start, of documents that hold any.  docs: id, key, text."""
    listed = found.join(_small(wins, n_bytes, BROADCAST_BYTES), "win").groupBy("key").agg(F.collect_list(F.struct("win", "len", "items", "words", "exact", "near")).alias("c"))
    asked = found.select("key").distinct()
    own = docs.join(_small(asked, asked.count()), "key", "left_semi").dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("own"))

    def at(c: Column, p: Column) -> Column:
        return F.struct(p.alias("start"), c["len"].alias("len"), c["items"].alias("items"))

    def stands(c: Column, p: Column) -> Column:
        return F.xxhash64(F.slice("own", p + 1, c["len"])) == c.win

    def nearly(c: Column, p: Column) -> Column:
        around = F.slice("own", F.greatest(p - slack, F.lit(0)) + 1, c["len"] + 2 * slack)
        return F.size(F.array_intersect(c.words, around)) >= NEAR_SHARE * F.size(F.array_distinct(c.words))

    pick = lambda which, test: F.array_sort(F.flatten(F.transform("c", lambda c: F.transform(F.filter(c[which], lambda p: test(c, p)), lambda p: at(c, p)))))
    return listed.join(own, "key").select("key", pick("exact", stands).alias("hits"), pick("near", nearly).alias("near")).filter((F.size("hits") > 0) | (F.size("near") > 0))


def _matches(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, size: int, slack: int) -> DataFrame:
    """``verified`` of all documents.  docs: id, key, text."""
    words = docs.select("key", words_of(F.col("text")).alias("words"))
    wins = materialize(windows(items, item_col, item_text, size), "windows")
    texts = F.length(F.array_join("words", " ")) + F.length(F.array_join("items", " "))
    n_wins, n_bytes = wins.agg(F.count("*"), F.coalesce(F.sum(texts), F.lit(0))).first()
    terms = wins.select(F.explode("words").alias("term")).distinct()
    counts = words.select(F.explode("words").alias("term")).join(_small(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("n"))
    uses = materialize(anchors(wins, counts), "anchors")
    found = materialize(search(build_index(words, uses), uses, n_wins, slack), "found")
    return materialize(verified(docs, found, wins, n_bytes, slack), "hits")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, hits, near.

    hits: exact matches, near: proximity matches, both as (start, len, items).
    """
    keyed = _keyed(docs, id_col, text_col)
    matches = _matches(keyed, items, item_col, item_text, size, slack)
    slim = keyed.select("id", "key", F.size(words_of(F.col("text"))).alias("n_words"))
    none = F.array().cast(matches.schema["hits"].dataType)
    hits = slim.join(matches, "key", "left").withColumn("hits", F.coalesce("hits", none)).withColumn("near", F.coalesce("near", none))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(F.greatest(acc.end, s.start + s.len).alias("end"), (acc.n + F.greatest(F.lit(0), s.start + s.len - F.greatest(acc.end, s.start))).alias("n")),
        lambda acc: acc.n,
    )
    met = hits.withColumn("met", F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda s: s["items"])))))
    return met.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("met").cast("long").alias("n_items"),
        F.sha2(F.array_join("met", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "hits",
        "near",
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark window; all columns stay."""
    bad = _matches(_keyed(docs, id_col, text_col), items, "item_id", "text", WINDOW, SLACK).filter(F.size("hits") > 0).select(F.col("key").alias("_bad"))
    return docs.join(bad, F.xxhash64(docs[id_col], docs[text_col]) == F.col("_bad"), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, row_number() OVER () AS r FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase FROM g),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT r, s, pos.n, item FROM pos JOIN win ON win.n = pos.n AND win.phrase = array_to_string(w[s:s + pos.n - 1], ' ')),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON cov.r = d.r LEFT JOIN it ON it.r = d.r
"""
