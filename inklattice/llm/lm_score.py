"""LM scoring by a hashed maximum-entropy model (operator 2).

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z folded, then one end token per text.

Base: add-one unigrams over the training tokens, exact for every word.  The counts of the most frequent words
(``KNOWN_WORDS`` at most) go to all executors (a bounded table); rarer words of each text are looked up by a shuffle join.

Model: P(word | history) = P(class | history) * P(word | class, history).  The ``CLASSES - 1`` first classes hold
``PER_CLASS`` words each (the most frequent ones, by frequency).  The last class holds all other words, split again
and again into two classes, ``LEAST_DEPTH`` times or more (once more with each fourfold vocabulary; words are dealt by
hash): P(word | last class, history) = product of P(half | node, history) * P(word | leaf), where the words of a
leaf and one unseen word a leaf share its mass by add-one counts.  All softmaxes are maximum-entropy models with
weights in hashed tables, which grow with the square root of the vocabulary: the word before, the one two before
(skip), and the pair of both, each by its own hash, whatever its frequency.  Weights start at the unigram distribution.
No task holds more than these tables, the leaves' masses and the ``KNOWN_WORDS`` counts.

Training: distributed gradient updates on all training tokens.  Texts are dealt by their id's hash to shards whose
number depends on the corpus alone and are read in order of their ids, so scores do not depend on the table's
partitions (but for the order of sums).  In each of ``ROUNDS`` rounds every shard runs mini-batches of adaptive gradient steps over its
share; a weight's change is the mean over the shards that changed it.

Training texts: crc32(id as text) mod 7 is not 2.  Nulls: a null text is empty (one end token); rows with a null
id are scored as held out.  Repeated rows are learnt and scored as often as they occur.  Empty tables give empty
results; without training tokens N = V = 0 and every probability of the base is 1.  Other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inklattice.llm.common import materialize, mix64, slices, word_hashes

FOLDS, HELD_OUT = 7, 2
KNOWN_WORDS = 262_144
CLASSES, PER_CLASS = 32, 31
#: Least rows of the hashed weight tables of the class and the word model, least weights of the splits, and least tokens of a shard; all double with each fourfold vocabulary from ``LEAST_WORDS`` on.
CLASS_ROWS, WORD_ROWS, SPLIT_WEIGHTS, SHARD_TOKENS = 1 << 12, 1 << 12, 1 << 17, 2_000_000
LEAST_WORDS, LEAST_DEPTH = 1 << 18, 10
ROUNDS = 2
BATCH = 16_384
RATE, SPLIT_RATE = 0.15, 0.03
BLOCK = 8192
END = 0x0E0D0E0D0E0D0E0D
FEATURES = 3
#: Distinct hashes that a counting task holds before it passes them on.
HELD_COUNTS = 2_000_000


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch with an end after each text, and where each text's tokens begin."""
    words, bounds = word_hashes(column)
    ends = bounds[1:]
    tokens = np.insert(words, ends, np.uint64(END))
    return tokens, bounds + np.arange(len(bounds))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, c): training tokens by hash; pre-aggregated in each task.  docs: id, text, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        pending: list[np.ndarray] = []
        size = 0

        def merged():
            h, n = np.unique(np.concatenate(pending), return_counts=True)
            both, inverse = np.unique(np.concatenate([kept, h]), return_inverse=True)
            return both, np.bincount(inverse, np.concatenate([counts, n]), len(both)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(counts)], ["h", "c"])

        for batch in (part for whole in batches for part in slices(whole, 0)):
            tokens, _ = tokens_of(batch.column(0))
            pending.append(tokens)
            size += len(tokens)
            if size >= HELD_COUNTS:
                kept, counts = merged()
                pending, size = [], 0
                if len(kept) >= HELD_COUNTS:
                    yield out()
                    kept, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        if pending:
            kept, counts = merged()
        if len(kept):
            yield out()

    return docs.filter("not held").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def tail_slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(2)).astype(np.int64) + (CLASSES - 1) * PER_CLASS


def leaf_of(slots: np.ndarray, leaves: int) -> np.ndarray:
    """The leaf that each slot beyond the heads falls on; leaves are a power of two."""
    return (mix64(slots.astype(np.uint64)) & np.uint64(leaves - 1)).astype(np.int64)


def leaf_masses(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Mass of each leaf: add-one counts of all words beyond the heads and of one unseen word a leaf."""
    heads, leaves = vocab.hashes[vocab.head < (CLASSES - 1) * PER_CLASS], vocab.leaves

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(leaves)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            tail = ~np.isin(h, heads)
            mass += np.bincount(leaf_of(tail_slots(h[tail]), leaves), batch.column(1).to_numpy()[tail] + 1, leaves)
        held = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(mass[held].astype(np.int64))], ["leaf", "mass"])

    out = np.ones(leaves)
    for r in counts.select("h", "c").mapInArrow(deal, "leaf long, mass long").groupBy("leaf").agg(F.sum("mass").alias("mass")).collect():
        out[r.leaf] += r.mass
    return out


def doublings(distinct: int) -> int:
    """How often the tables double for a vocabulary: once with each fourfold number of words."""
    return max(0, (max(distinct, 1) // LEAST_WORDS).bit_length() - 1) // 2


class Vocabulary:
    """The most frequent words with their counts, and which of them have places in the classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.tokens, self.distinct = tokens, distinct
        self.small = None
        self.floor = tokens + distinct + 1
        rank = np.empty(len(order), np.int64)
        rank[:] = order  # hashes came by falling frequency, so the place in that list is the rank
        heads = (CLASSES - 1) * PER_CLASS
        self.head = np.where(rank < heads, rank, heads)
        self.n_head = min(len(hashes), heads)
        top = np.argsort(rank)[: self.n_head]
        self.head_counts = np.zeros(heads)
        self.head_counts[: self.n_head] = self.counts[top]
        self.leaves = 1 << LEAST_DEPTH + doublings(distinct)
        #: Mass of the last class: add-one counts of all words outside the heads and of the unseen one.
        self.tail_mass = float(self.floor - (self.head_counts[: self.n_head] + 1).sum())

    def slots(self, tokens: np.ndarray) -> np.ndarray:
        """The head's place of each token or, beyond the heads, the word's hash: by a small open table."""
        if self.small is None:
            heads = np.flatnonzero(self.head < (CLASSES - 1) * PER_CLASS)
            self.small = (np.full(1 << 16, np.uint64(0)), np.full(1 << 16, -1, np.int64))
            self.crowded = []
            for k in heads.tolist():
                at = int(self.hashes[k]) >> 48
                if self.small[1][at] < 0:
                    self.small[0][at], self.small[1][at] = self.hashes[k], self.head[k]
                else:
                    self.crowded.append((self.hashes[k], self.head[k]))
        at = (tokens >> np.uint64(48)).astype(np.int64)
        out = np.where((self.small[0][at] == tokens) & (self.small[1][at] >= 0), self.small[1][at], tail_slots(tokens))
        for h, place in self.crowded:
            out[tokens == h] = place
        return out

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, count) of each token; the slot is a head's place or, beyond the heads, the word's hash; count -1 for words that are not among the frequent ones."""
        heads = (CLASSES - 1) * PER_CLASS
        others = tail_slots(tokens)
        if not len(self.hashes):
            return others, np.full(len(tokens), -1, np.int64)
        at = np.searchsorted(self.hashes, tokens)
        at[at == len(self.hashes)] = 0
        found = self.hashes[at] == tokens
        return np.where(found & (self.head[at] < heads), self.head[at], others), np.where(found, self.counts[at], -1)


def features(slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of each token's history: the slot before, the one before that (skip), the pair of both."""
    none = np.uint64(CLASSES * PER_CLASS + 2)
    one, two = np.empty(len(slots), np.uint64), np.empty(len(slots), np.uint64)
    one[1:], two[2:] = slots[:-1], slots[:-2]
    first, second = starts[:-1], starts[:-1] + 1
    one[first] = two[first] = none
    two[second[second < starts[1:]]] = none
    raw = [one * np.uint64(4), two * np.uint64(4) + np.uint64(1), (mix64(one) + two) * np.uint64(4) + np.uint64(3)]
    return np.stack([mix64(f + np.uint64(0x632BE59BD9B4E019)) for f in raw])


def _centred(mass: np.ndarray) -> np.ndarray:
    """Log masses less their largest, by row; -1e4 for none, so that its exponential is 0; rows without any are even."""
    out = np.log(np.maximum(mass, 1e-300))
    out = np.where(mass > 0, out - out.max(axis=1, keepdims=True), -1e4)
    return np.where(mass.any(axis=1, keepdims=True), out, 0).astype(np.float32)


class Model:
    def __init__(self, vocab: Vocabulary, masses: np.ndarray | None = None):
        """masses: of the leaves; by default each leaf has the same."""
        self.vocab = vocab
        self.set_masses(np.full(vocab.leaves, max(vocab.tail_mass, 1e-12) / vocab.leaves) if masses is None else masses)
        heads = (vocab.head_counts + 1).reshape(CLASSES - 1, PER_CLASS)
        live = (np.arange((CLASSES - 1) * PER_CLASS) < vocab.n_head).reshape(CLASSES - 1, PER_CLASS)
        mass = np.append((heads * live).sum(axis=1), max(vocab.tail_mass, 1e-12))
        self.class_bias = _centred(mass[None])[0]
        self.word_bias = _centred(heads * live)
        more = doublings(vocab.distinct)
        self.class_weights = np.zeros((CLASS_ROWS << more, CLASSES), np.float32)
        self.word_weights = np.zeros((WORD_ROWS << more, PER_CLASS), np.float32)
        self.split_weights = np.zeros(SPLIT_WEIGHTS << more, np.float32)

    def set_masses(self, masses: np.ndarray) -> None:
        """Log masses of the leaves, and of each node of the halving the log odds of its second half."""
        self.last = np.log(np.maximum(masses, 1e-12)).astype(np.float32)
        odds, level = [], masses.astype(np.float64)
        while len(level) > 1:
            odds.insert(0, np.log(level[1::2] / level[::2]))
            level = level[::2] + level[1::2]
        self.odds = np.concatenate([[0.0], *odds]).astype(np.float32)

    def splits(self, f: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of slots beyond the heads: log odds and side (a column a level), and the indexes of the weights that take part, by feature."""
        depth = len(self.last).bit_length() - 1
        path = (leaf_of(slots, len(self.last)) + len(self.last))[:, None] >> np.arange(depth, -1, -1)
        nodes, side = path[:, :-1], path[:, 1:] & 1
        z, parts = self.odds[nodes], []
        salted = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shift = np.uint64(65 - len(self.split_weights).bit_length())
        for k in range(FEATURES):
            at = (((salted ^ f[k][:, None]) * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)
            z += self.split_weights[at]
            parts.append(at)
        return z, side, parts

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        """In place; the biases' largest is 0 and weights are small, so exponentials stay in range."""
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def class_part(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = (f & np.uint64(len(self.class_weights) - 1)).astype(np.int64)
        z = self.class_weights[rows[0]]
        for r in rows[1:]:
            z += self.class_weights[r]
        z += self.class_bias
        return rows, self._softmax(z)

    def word_part(self, f: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = (mix64(f + classes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) & np.uint64(len(self.word_weights) - 1)).astype(np.int64)
        z = self.word_weights[rows[0]]
        for r in rows[1:]:
            z += self.word_weights[r]
        z += self.word_bias[classes]
        return rows, self._softmax(z)

    def fresh_squares(self) -> list[np.ndarray]:
        """Sums of squared gradients before the first step, for each table."""
        return [np.full(len(t), 0.1, np.float32) for t in self.tables()]

    def tables(self) -> list[np.ndarray]:
        return [self.class_weights, self.word_weights, self.split_weights]

    def learn(self, f: np.ndarray, slots: np.ndarray, squares: list[np.ndarray], turn: int = 0) -> None:
        """One gradient step (adaptive rates) on a mini-batch, for the weights of one kind of feature: the kinds take turns."""
        heads, k = (CLASSES - 1) * PER_CLASS, turn % FEATURES
        classes = np.where(slots < heads, slots // PER_CLASS, CLASSES - 1)
        rows, p = self.class_part(f)
        self._step(self.class_weights, squares[0], rows[k], p, classes)
        inner = np.flatnonzero(slots < heads)
        if len(inner):
            rows, p = self.word_part(f[:, inner], classes[inner])
            self._step(self.word_weights, squares[1], rows[k], p, slots[inner] % PER_CLASS)
        outer = np.flatnonzero(slots >= heads)
        if len(outer):
            z, side, parts = self.splits(f[:, outer], slots[outer])
            g, at = (1 / (1 + np.exp(-z)) - side).ravel().astype(np.float32), parts[k].ravel()
            np.add.at(squares[2], at, g * g)
            np.add.at(self.split_weights, at, -SPLIT_RATE * g / np.sqrt(squares[2][at]))

    @staticmethod
    def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, p: np.ndarray, targets: np.ndarray) -> None:
        p[np.arange(len(p)), targets] -= 1
        order = np.argsort(rows.astype(np.uint16) if len(weights) <= 1 << 16 else rows, kind="stable")
        held = rows[order]
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        touched = held[first]
        g = np.add.reduceat(p[order], first, axis=0)
        g /= np.sqrt(np.diff(np.append(first, len(rows))))[:, None]
        squares[touched] += (g * g).mean(axis=1)
        weights[touched] -= (RATE / np.sqrt(squares[touched] + 1e-3))[:, None] * g

    def log10(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of the model's probability of each token; of its leaf only for tokens outside the heads."""
        f, heads = features(slots, starts), (CLASSES - 1) * PER_CLASS
        classes = np.where(slots < heads, slots // PER_CLASS, CLASSES - 1)
        out = np.empty(len(slots))
        for at in range(0, len(slots), BATCH):
            part = slice(at, at + BATCH)
            c = classes[part]
            _, p = self.class_part(f[:, part])
            got = p[np.arange(len(c)), c]
            inner = np.flatnonzero(c < CLASSES - 1)
            if len(inner):
                _, q = self.word_part(f[:, part][:, inner], c[inner])
                got[inner] *= q[np.arange(len(inner)), slots[part][inner] % PER_CLASS]
            out[part] = np.log10(np.maximum(got, 1e-30))
            outer = np.flatnonzero(c == CLASSES - 1)
            if len(outer):
                z, side, _ = self.splits(f[:, part][:, outer], slots[part][outer])
                out[at + outer] -= np.log1p(np.exp(np.clip(np.where(side, -z, z), -60, 60))).sum(axis=1) / np.log(10)
        return out


def _train_round(dealt: DataFrame, shared, round_: int) -> dict[int, np.ndarray]:
    """Mean changes of all weights in one round, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model, squares, turn = None, None, None, 0

        def changes() -> Iterator[pa.RecordBatch]:
            change = np.concatenate([(new - old).ravel() for new, old in zip(model.tables(), shared.value.tables(), strict=True)]).astype(np.float16)
            for k in range(0, len(change), BLOCK):
                if change[k : k + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK]), pa.array([change[k : k + BLOCK].tobytes()], pa.binary())], ["block", "change"])

        for batch in (part for whole in batches for part in slices(whole, 0)):
            shards = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if shards[a] != shard:
                    if model is not None:
                        yield from changes()
                    shard, model = shards[a], copy.copy(shared.value)
                    model.class_weights, model.word_weights, model.split_weights = (t.copy() for t in shared.value.tables())
                    squares, turn = model.fresh_squares(), 0
                tokens, starts = tokens_of(batch.column(0).slice(a, b - a))
                slots = model.vocab.slots(tokens)
                f = features(slots, starts)
                for at in range(0, len(slots), BATCH):
                    model.learn(f[:, at : at + BATCH], slots[at : at + BATCH], squares, turn)
                    turn += 1
        if model is not None:
            yield from changes()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = np.frombuffer(blob, np.float16).astype(np.float64)
                sums[b], n[b] = sums.get(b, 0) + value, n.get(b, 0) + (value != 0)
        for b, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([(value / np.maximum(n[b], 1)).astype(np.float32).tobytes()], pa.binary())], ["block", "change"])

    schema = "block long, change binary"
    rows = dealt.filter(F.col("round") == round_).select("text", "shard").mapInArrow(run, schema).repartition(96, "block").mapInArrow(add, schema).collect()  # the size of the weight tables
    return {r.block: np.frombuffer(r.change, np.float32) for r in rows}


def deal(docs: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """text, shard, round of the training texts, one shard a task, by id."""
    shards = max(1, -(-tokens // (SHARD_TOKENS << doublings(distinct))))
    own = docs.filter("not held").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("id", F.lit("round")), F.lit(ROUNDS)).cast("int").alias("round"))
    return own.repartitionById(shards, "shard").sortWithinPartitions("shard", "id", F.xxhash64("text")).select("text", "shard", "round")


def _level() -> Column:
    """Sixteen classes of counts to each doubling."""
    return F.floor(F.log2("c") * 16)


def train(docs: DataFrame) -> Model:
    """docs: id, text, held."""
    spark = docs.sparkSession
    counts = materialize(count_tokens(docs), "counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The most frequent words by classes of like counts: as many whole classes as fit, so that no task sorts them all.
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    known, least = 0, None
    for level, n in sizes:
        if known + n > KNOWN_WORDS:
            break
        known, least = known + n, level
    top = counts.filter(_level() >= least if least is not None else F.lit(False)).toPandas().sort_values(["c", "h"], ascending=[False, True])
    vocab = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), int(totals[0]), int(totals[1]))
    model = Model(vocab, leaf_masses(counts, vocab))
    model.counts, model.least = None, least
    dealt = materialize(deal(docs, vocab.tokens, vocab.distinct), "shards")
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # the weight tables and the counts of KNOWN_WORDS words
        change = _train_round(dealt, shared, round_)
        shared.destroy()
        sizes = [t.size for t in model.tables()]
        flat = np.concatenate([t.ravel() for t in model.tables()])
        for b, value in change.items():
            flat[b * BLOCK : b * BLOCK + len(value)] += value
        a, b, c = np.split(flat, np.cumsum(sizes)[:-1])
        model.class_weights, model.word_weights, model.split_weights = a.reshape(-1, CLASSES), b.reshape(-1, PER_CLASS), c
    model.counts = counts
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of whole texts)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    model = train(docs)
    counts, model.counts = model.counts, None
    shared = spark.sparkContext.broadcast(model)
    vocab = model.vocab
    floor = float(vocab.floor)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            tokens, starts = tokens_of(batch.column(1))
            slots, c = own.vocab.look_up(tokens)
            logs = own.log10(slots, starts)
            known = c >= 0
            base = np.where(known, np.log10(np.maximum(c + 1, 1) / floor), 0.0)
            outer = np.flatnonzero(slots >= (CLASSES - 1) * PER_CLASS)
            logs[outer] += np.log10(np.maximum(c[outer], 0) + 1) - own.last[leaf_of(slots[outer], len(own.last))] / np.log(10)
            sums = lambda x: np.add.reduceat(x, starts[:-1]) if len(starts) > 1 else np.zeros(0)
            rare, n_rare = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                h, n = np.unique(tokens[a:b][~known[a:b]], return_counts=True)
                rare.append(h.view(np.int64))
                n_rare.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(np.diff(starts)), pa.array(sums(known.astype(np.int64)).astype(np.int64)), pa.array(sums(base), pa.float64()), pa.array(sums(logs), pa.float64()),
                    pa.array(rare, pa.list_(pa.int64())), pa.array(n_rare, pa.list_(pa.int64())),
                ],
                ["id", "held", "n_tokens", "n_known", "base", "score", "rare", "n_rare"],
            )

    first = docs.mapInArrow(run, f"id {id_type}, held boolean, n_tokens long, n_known long, base double, score double, rare array<long>, n_rare array<long>")
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    if vocab.distinct > len(vocab.hashes):
        # Rare words: their exact counts by a shuffle join; a word not in the table was never seen in training.
        rest = counts if model.least is None else counts.filter(_level() < model.least)
        spread = first.select("row", F.explode(F.arrays_zip(F.col("rare").alias("h"), F.col("n_rare").alias("n"))).alias("w")).select("row", F.col("w.h").alias("h"), F.col("w.n").alias("n"))
        joined = spread.join(rest, "h", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    else:
        joined = first.select("row", F.explode("n_rare").alias("n")).withColumn("c", F.lit(0))
    logs = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(floor))).alias("b"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("s"),
    )
    return first.drop("rare", "n_rare").join(logs, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
