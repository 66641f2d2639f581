import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inklattice.llm import lm_score


def brute(rows):
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


@pytest.mark.parametrize("known", [lm_score.KNOWN_WORDS, 40])
def test_base_is_exact(spark, prose, monkeypatch, known):
    monkeypatch.setattr(lm_score, "KNOWN_WORDS", known)
    rows = [(k, prose(k % 30, 50) + f" THE the é É {k}") for k in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, "w " * 3000)]
    got = lm_score.score_documents(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_learns_order_and_is_a_distribution():
    r = np.random.default_rng(1)
    names = r.integers(0, 2**63, 300).astype(np.uint64)
    follow = r.permutation(300)
    walk, at = [], 0
    for _ in range(120_000):
        at = int(follow[at]) if r.random() < 0.8 else int(r.integers(300))
        walk.append(at)
    tokens = names[np.array(walk)]
    h, c = np.unique(tokens, return_counts=True)
    order = np.argsort(-c, kind="stable")
    vocab = lm_score.Vocabulary(h[order], c[order], len(tokens), len(h))
    model = lm_score.Model(vocab)
    slots, _ = vocab.look_up(tokens)
    starts = np.array([0, len(slots)])
    before = model.log10(slots, starts).mean()
    f = lm_score.features(slots, starts)
    squares = model.fresh_squares()
    for k in range(0, len(slots), 2048):
        model.learn(f[:, k : k + 2048], slots[k : k + 2048], squares, k // 2048)
    assert model.log10(slots, starts).mean() > before + 0.3
    one = f[:, 500:501]
    _, p = model.class_part(one)
    total = p[0, -1] + sum(p[0, c] * model.word_part(one, np.array([c]))[1].sum() for c in range(lm_score.CLASSES - 1))
    assert abs(total - 1) < 1e-4


def test_learns_the_order_of_words_outside_the_heads():
    r = np.random.default_rng(2)
    n, heads = 1500, (lm_score.CLASSES - 1) * lm_score.PER_CLASS
    names = r.integers(0, 2**63, heads + n).astype(np.uint64)
    follow = r.permutation(n)
    walk, at = [], 0
    for _ in range(120_000):
        at = int(follow[at]) if r.random() < 0.9 else int(r.integers(n))
        walk.append(heads + at)
    tokens = names[np.array(walk)]
    counts = np.concatenate([np.full(heads, 1000), np.bincount(np.array(walk) - heads, minlength=n)])
    vocab = lm_score.Vocabulary(names, counts, int(counts.sum()), len(names))
    slots, c = vocab.look_up(tokens)
    assert (slots >= heads).all() and (c >= 0).all()
    masses = np.bincount(lm_score.leaf_of(lm_score.tail_slots(names[heads:]), vocab.leaves), counts[heads:] + 1, vocab.leaves) + 1
    model = lm_score.Model(vocab, masses)
    starts = np.array([0, len(slots)])
    before = model.log10(slots, starts).mean()
    f = lm_score.features(slots, starts)
    squares = model.fresh_squares()
    for k in range(0, len(slots), 2048):
        model.learn(f[:, k : k + 2048], slots[k : k + 2048], squares, k // 2048)
    assert model.log10(slots, starts).mean() > before + 0.5
    # Over all leaves, the probabilities of one history sum to one.
    leaves = len(model.last)
    every, left = np.empty(leaves, np.int64), np.arange(heads, heads + 60 * leaves)
    every[lm_score.leaf_of(left, leaves)] = left
    z, side, _ = model.splits(np.repeat(f[:, 500:501], leaves, axis=1), every)
    assert abs(np.exp(-np.logaddexp(0, np.where(side, -z, z)).sum(axis=1)).sum() - 1) < 1e-3


def test_leaf_masses_hold_every_word_beyond_the_heads(spark):
    r = np.random.default_rng(3)
    names, c = r.integers(0, 2**63, 5000).astype(np.uint64), np.sort(r.integers(1, 99, 5000))[::-1].copy()
    vocab = lm_score.Vocabulary(names[:2000], c[:2000], int(c.sum()), 5000)
    frame = spark.createDataFrame(list(zip(names.view(np.int64).tolist(), c.tolist(), strict=True)), "h long, c long")
    got = lm_score.leaf_masses(frame, vocab)
    heads = (lm_score.CLASSES - 1) * lm_score.PER_CLASS
    assert len(got) == vocab.leaves == 1024 and got.sum() == (c[heads:] + 1).sum() + len(got)


def test_brute_force_score_and_partitions(spark, prose, monkeypatch):
    """Scores of the query equal the model applied alone, and do not depend on how the table is cut."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 4000)
    rows = [(k, prose(k % 50, 60)) for k in range(300)] + [(3, prose(999, 5)), (7, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted((r.doc_id, r.n_tokens, r.score) for r in lm_score.score_documents(frame.repartition(2)).collect())
    two = sorted((r.doc_id, r.n_tokens, r.score) for r in lm_score.score_documents(frame.repartition(13)).collect())
    assert len(one) == len(two) == len(rows)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-3) for a, b in zip(one, two, strict=True))
    docs = frame.selectExpr("doc_id AS id", "text", "false AS held")
    model = lm_score.train(docs)
    tokens, starts = lm_score.tokens_of(pa.array([rows[0][1]]))
    f = lm_score.features(model.vocab.look_up(tokens)[0], starts)
    want, (h, counts) = 0.0, np.unique(np.concatenate([lm_score.tokens_of(pa.array([t]))[0] for _, t in rows]), return_counts=True)
    counts = dict(zip(h.tolist(), counts.tolist(), strict=True))
    slots, _ = model.vocab.look_up(tokens)
    for k, (token, slot) in enumerate(zip(tokens.tolist(), slots.tolist(), strict=True)):  # one token at a time, by plain sums
        own = f[:, k : k + 1]
        n = min(slot // lm_score.PER_CLASS, lm_score.CLASSES - 1)
        z = model.class_bias.astype(float) + sum(model.class_weights[int(x) % len(model.class_weights)] for x in own[:, 0])
        want += math.log10(np.exp(z[n]) / np.exp(z).sum())
        if n < lm_score.CLASSES - 1:
            salt = np.array([n], np.uint64) * np.uint64(0xA24BAED4963EE407)
            z = model.word_bias[n].astype(float) + sum(model.word_weights[int(lm_score.mix64(own[j] + salt)[0]) % len(model.word_weights)] for j in range(lm_score.FEATURES))
            want += math.log10(np.exp(z[slot % lm_score.PER_CLASS]) / np.exp(z).sum())
        else:
            z, side, _ = model.splits(own, np.array([slot]))
            want += sum(math.log10(1 / (1 + math.exp(-x if s else x))) for x, s in zip(z[0], side[0], strict=True))
            leaf = lm_score.leaf_of(np.array([slot]), len(model.last))[0]
            want += math.log10(counts[token] + 1) - model.last[leaf] / math.log(10)
    shared = lm_score.score_documents(frame)
    assert shared.columns[-1] == "score"
    got = model.log10(slots, starts)
    outer = slots >= (lm_score.CLASSES - 1) * lm_score.PER_CLASS
    got[outer] += [math.log10(counts[t] + 1) for t in tokens[outer].tolist()] - model.last[lm_score.leaf_of(slots[outer], len(model.last))] / math.log(10)
    assert math.isclose(got.sum(), want, rel_tol=1e-4)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (4, None)]
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r.held_out for r in got if r.doc_id is None} == {True}
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and [r.n_tokens for r in got if r.doc_id == 4] == [1]


def test_empty_table(spark):
    assert lm_score.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm_score.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
