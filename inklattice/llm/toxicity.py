"""Toxicity by compression distance (operator 9).

Two zstandard dictionaries are trained, one on ordinary text and one on those pieces of toxic text that set
it apart (few segments of words that cover what recurs in toxic training texts and is far rarer in ordinary
ones).  A text is cut into windows of about 48 bytes.  Each window is compressed with the ordinary dictionary
alone and with the toxic one before it; the bytes saved by the second say how toxic the window is.  A logistic
curve fitted on other labelled texts turns the savings of a document's windows into a score from 0 to 1.
(Dictionaries trained apart on whole toxic and whole ordinary texts differ by chance more than by toxic words: see the README.)

Fitting reads a bounded sample of whole labelled texts: ``FIT_TOXIC`` and ``FIT_ORDINARY`` for the dictionaries,
``CURVE_TOXIC`` and ``CURVE_ORDINARY`` for the curve, by a hash of their ids, of each of the four as many as have
``SAMPLE_BYTES`` together.  Scoring reads every window of every text.

Nulls: a null text is an empty text; empty texts get the curve's value for no savings.  Without labelled
texts of both classes every score is 0.0.  Null labels are not learnt from.  Repeated rows are scored alike;
rows with a null id are scored too, as held out, and never learnt from.  Of an id with several texts one is learnt from
(the least by hash).  Bytes that are not UTF-8 are read as they are.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIT_TOXIC, FIT_ORDINARY = 1000, 2000
CURVE_TOXIC, CURVE_ORDINARY = 600, 1200
SAMPLE_BYTES = 16_000_000
FOLDS, HELD_OUT, CURVE_FOLD = 5, 0, 4
GRAM = 5
#: A gram sets toxic text apart if contexts as many as this share of the toxic texts hold it, at this many times the ordinary rate.
SUPPORT, ODDS = 0.02, 10
WINDOW = 48
TOXIC_BYTES, ORDINARY_BYTES = 1024, 8192


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def normal(text: str | bytes | None) -> bytes:
    """A-Z folded, white space as single spaces, one at either end."""
    data = text.encode() if isinstance(text, str) else text or b""
    return b" " + b" ".join(data.lower().split()) + b" "


def windows(data: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """Consecutive windows of at most about ``size`` bytes that end at a space where there is one."""
    at, end = 0, len(data) - 1
    while at < end:
        stop = min(at + size, end)
        if stop < end:
            space = data.rfind(b" ", at + 1, stop)
            stop = space if space > at else stop
        yield data[at : stop + 1]
        at = stop


def _gram_counts(texts: list[bytes]) -> tuple[Counter, Counter]:
    """How many different words come before each word, so that copies of a text count once; sums of that over grams."""
    ids: dict[bytes, int] = {b"": 0}
    pairs = [np.empty(0, np.uint64)]
    for text in texts:  # as numbers, since the pairs are many
        own = np.array([0, *(ids.setdefault(w, len(ids)) for w in text.split())], np.uint64)
        pairs.append(np.unique(own[:-1] << np.uint64(32) | own[1:]))
    followers = np.unique(np.concatenate(pairs)) & np.uint64(0xFFFFFFFF)
    times = np.bincount(followers.astype(np.int64), minlength=len(ids)).tolist()
    words = Counter({w: times[k] for w, k in ids.items() if times[k]})
    grams: Counter = Counter()
    for word, n in words.items():
        shown = b" " + word + b" "
        for g in {shown[i : i + GRAM] for i in range(len(shown) - GRAM + 1)}:
            grams[g] += n
    return words, grams


def _segments(words: Counter, apart: set[bytes], support: int) -> list[bytes]:
    """Few segments that cover the marked words: again and again the gram in most uncovered words (weighed by texts),
    widened while over half of that weight has the same next byte."""
    left = {b" " + w + b" ": n for w, n in words.items()}
    holders: dict[bytes, set[bytes]] = {g: set() for g in apart}
    for shown in left:
        for i in range(len(shown) - GRAM + 1):
            if (g := shown[i : i + GRAM]) in holders:
                holders[g].add(shown)
    out = []
    while holders:
        best = max(holders, key=lambda g: (sum(left[w] for w in holders[g]), g))
        own = holders[best]
        total = sum(left[w] for w in own)
        if total < support:
            break
        segment = best
        for before in (True, False):
            while True:
                wider: Counter = Counter()
                for w in own:
                    i = w.find(segment)
                    j = i - 1 if before else i + len(segment)
                    if i >= 0 and 0 <= j < len(w):
                        wider[w[j : j + 1] + segment if before else segment + w[j : j + 1]] += left[w]
                top = max(wider.items(), key=lambda x: (x[1], x[0]), default=(b"", 0))
                if 2 * top[1] <= total:
                    break
                segment = top[0]
        out.append(segment)
        own = set(own)
        holders = {g: rest for g, ws in holders.items() if (rest := ws - own)}
    return out


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """The contents of a trained dictionary; of the samples themselves where they are too few to train on."""
    try:
        made = zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
        return made[len(made) // 3 :]  # tables come first
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    words, seen = _gram_counts(toxic)
    _, usual = _gram_counts(ordinary)
    t, o = max(len(toxic), 1), max(len(ordinary), 1)
    support = max(2, round(SUPPORT * t))
    apart = {g for g, n in seen.items() if n >= support and n / t >= ODDS * (usual[g] + 0.5) / o}
    segments = _segments(words, apart, support)
    samples = [b"".join(x for x in segments for _ in range(text.count(x))) for text in toxic]
    samples = [s for s in samples if len(s) >= 8]
    return _trained(samples, TOXIC_BYTES, 16), _trained([text[i : i + 4000] for text in ordinary for i in range(0, len(text), 4000)], ORDINARY_BYTES, 64)


class Scorer:
    """Savings of windows and the score of a document."""

    def __init__(self, toxic: bytes, ordinary: bytes, curve: list[float], centre: list[float], spread: list[float]):
        self.parts = (toxic, ordinary, curve, centre, spread)
        self.plain = self._compressor(ordinary)
        self.marked = self._compressor(toxic + ordinary)
        self.curve, self.centre, self.spread = (np.array(x, float) for x in (curve, centre, spread))

    def __reduce__(self):
        return (Scorer, self.parts)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters.from_level(
            3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
            min_match=4, strategy=zstandard.STRATEGY_LAZY2, window_log=15, hash_log=13, chain_log=14, search_log=6,
        )
        made = zstandard.ZstdCompressionDict(content.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=made, compression_params=how)

    def features(self, text: str | bytes | None) -> list[float]:
        plain, marked = self.plain.compress, self.marked.compress
        saved = np.array([len(plain(w)) - len(marked(w)) for w in windows(normal(text))], float)
        if not len(saved):
            saved = np.zeros(1)
        top = np.sort(saved)[-3:]
        return [saved.mean(), np.log1p(max(saved.sum(), 0)), saved.max(), (saved >= 2).mean(), top.mean(), np.log(len(saved)), np.sqrt(max(saved.mean(), 0))]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.centre) / self.spread, -8, 8) @ self.curve[1:] + self.curve[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(rows: np.ndarray, labels: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression by Newton steps with a small ridge."""
    centre, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = np.column_stack([np.ones(len(rows)), np.clip((rows - centre) / spread, -8, 8)])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.5] * rows.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist(), centre.tolist(), spread.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer | None:
    """Learn from labelled rows outside the held-out fold; None without both classes."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    parts = marked.withColumn("fold", fold("id")).filter(F.col("fold") != HELD_OUT).withColumn("curve", F.col("fold") == CURVE_FOLD)
    chosen = None
    for curve, y, most in ((False, 1, FIT_TOXIC), (False, 0, FIT_ORDINARY), (True, 1, CURVE_TOXIC), (True, 0, CURVE_ORDINARY)):
        part = parts.filter((F.col("curve") == curve) & (F.col("y") == y)).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").withColumn("key", F.xxhash64("text"))
    # At most the sum of the four bounds: first the texts' sizes, then those that fit together.
    sizes = own.select("id", "key", F.octet_length("text").cast("long").alias("size")).join(F.broadcast(chosen), "id")
    sizes = sizes.groupBy("id", "curve", "y").agg(F.min(F.struct("key", "size")).alias("t")).select("id", "curve", "y", "t.key", "t.size")
    so_far = F.sum("size").over(Window.partitionBy("curve", "y").orderBy(F.xxhash64("id"), "id"))
    fitting = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES).select("id", "key", "curve", "y")
    texts = own.join(F.broadcast(fitting), ["id", "key"]).select("id", "curve", "y", F.col("text").cast("binary").alias("text"))
    sample = sorted({(r.id, r.curve, r.y, bytes(r.text)) for r in texts.collect()})
    toxic = [normal(t) for _, curve, y, t in sample if not curve and y == 1]
    ordinary = [normal(t) for _, curve, y, t in sample if not curve and y == 0]
    if not toxic or not ordinary:
        return None
    content = train_dictionaries(toxic, ordinary)
    scorer = Scorer(*content, [0.0], [0.0], [1.0])
    held = [(y, t) for _, curve, y, t in sample if curve]
    if len({y for y, _ in held}) < 2:
        held = [(y, t) for _, _, y, t in sample]
    rows, labels_ = np.array([scorer.features(t) for _, t in held]), np.array([y for y, _ in held], float)
    return Scorer(*content, *fit_curve(rows, labels_))


def score(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted (1 from 0.5 on) of every text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if scorer is None:
                values = np.zeros(batch.num_rows)
            else:
                rows = [scorer.features(t.as_py()) for t in batch.column(1).cast(pa.binary())]
                values = scorer.scores(np.array(rows).reshape(len(rows), -1)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype("int32"))], [id_col, "held_out", "score", "predicted"])

    ready = docs.select(id_col, text_col, F.coalesce(fold(id_col) == HELD_OUT, F.lit(True)).alias("held_out"))
    return ready.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic; all columns stay.  Works row by row, without a shuffle of texts."""
    scorer = train(docs, labels, id_col, text_col)
    if scorer is None:
        return docs

    @F.pandas_udf("boolean")
    def ordinary(texts):
        rows = np.array([scorer.features(t) for t in texts]).reshape(len(texts), -1)
        return pd.Series(scorer.scores(rows) < 0.5) if len(texts) else pd.Series([], dtype=bool)

    return docs.filter(ordinary(F.col(text_col).cast("binary")))
