import random
import zlib

import numpy as np

from inklattice.llm import toxicity


def tables(spark, prose, n=900):
    r, rows, labels = random.Random(2), [], []
    for k in range(n):
        words, bad = prose(k, r.choice([20, 80, 200])).split(), int(r.random() < 0.3)
        if bad:
            for _ in range(max(2, len(words) // 15)):
                words[r.randrange(len(words))] = r.choice(["zounder", "blimbag", "quorx", "smeltpig"])
        rows.append((k, " ".join(words), 1))
        labels.append((k, bad, bad))
    rows += [(10_000, None, 1), (10_001, "", 1), (10_001, "", 1), (10_002, "x" * 30_000, 1), (None, "zounder", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame([*labels, (10_000, 0, None)], "doc_id long, quality int, toxic int"), dict((k, b) for k, _, b in labels)


def test_held_out_accuracy(spark, prose):
    docs, labels, truth = tables(spark, prose)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    kept = {r.doc_id for r in toxicity.keep_ordinary(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_without_labels(spark, prose):
    docs, labels, _ = tables(spark, prose, 20)
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.keep_ordinary(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).collect() == []


def test_windows_cover_the_text():
    for text in ("", "a", "one two " * 50, "x" * 500, "é" * 99):
        data = toxicity.normal(text)
        parts = list(toxicity.windows(data))
        assert b"".join(p[:-1] for p in parts) + data[-1:] == data


def test_scores_equal_the_scorer_alone(spark, prose):
    """Each row's score is that of its windows compressed one by one; one id with two texts has a score for each."""
    docs, labels, _ = tables(spark, prose, 300)
    scorer = toxicity.train(docs, labels)
    extra = spark.createDataFrame([(5, "zounder quorx smeltpig blimbag " * 5, 1), (None, "zounder", 1)], docs.schema)
    for r, text in ((r, t) for t in ("zounder quorx smeltpig blimbag " * 5,) for r in toxicity.score(extra, scorer).collect() if r.doc_id == 5):
        saved = [len(scorer.plain.compress(w)) - len(scorer.marked.compress(w)) for w in toxicity.windows(toxicity.normal(text))]
        assert scorer.features(text)[0] == sum(saved) / len(saved) > 0 and scorer.features(text)[2] == max(saved)
        assert abs(r.score - scorer.scores(np.array([scorer.features(text)]))[0]) < 1e-12
    assert {r.held_out for r in toxicity.score(extra, scorer).collect() if r.doc_id is None} == {True}
    both = docs.unionByName(extra)
    assert sorted(r.score for r in toxicity.score(both, scorer).collect() if r.doc_id == 5)[1] == max(r.score for r in toxicity.score(extra, scorer).collect() if r.doc_id == 5)


def test_sample_is_bounded_in_bytes(spark, prose, monkeypatch):
    docs, labels, _ = tables(spark, prose)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1)
    assert toxicity.train(docs, labels) is None
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60_000)
    assert toxicity.train(docs, labels) is not None


def test_bytes_that_are_not_utf8(spark, prose):
    docs, labels, _ = tables(spark, prose, 200)
    odd = spark.range(1).selectExpr("77 AS doc_id", "CAST(X'61FF62' AS STRING) AS text", "1 AS score")
    scorer = toxicity.train(docs.unionByName(odd.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", "score")), labels)
    (r,) = toxicity.score(odd, scorer).collect()
    assert 0 <= r.score <= 1
