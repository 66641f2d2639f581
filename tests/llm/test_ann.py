import numpy as np

from inklattice.llm import ann


def brute(rows, k=10):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    return {q: sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in good if i != q and len(x) == len(v))[:k] for q, v in good if q % 100 == 0}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 32))
    x = (centres[r.integers(12, size=3000)] + 0.4 * r.normal(size=(3000, 32))).astype(np.float32)
    x[1000:2000] = x[1000]
    rows = [(i, x[i].tolist()) for i in range(3000)]
    got = answers(ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=800))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert got[1500] == want[1500] and all(len(got[q]) == 10 for q in got)


def test_rows_without_part_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (200, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (300, [float("inf"), 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "b") for i, v in rows], "vec_id long, embedding array<float>, block string")
    assert answers(ann.neighbours(df)) == {q: v for q, v in brute(list(dict.fromkeys((i, tuple(v) if v is not None else None) for i, v in rows))).items() if v}
    assert ann.neighbours(df.limit(0)).collect() == []


def test_offset_and_huge_vectors(spark):
    r = np.random.default_rng(8)
    for offset, scale in ((1e5, 1.0), (0.0, 1e25), (3e18, 1e13)):
        x = (offset + scale * r.normal(size=(500, 16))).astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got, want = answers(ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))), brute_exact(rows)
        assert all(len(got[q]) == 10 for q in want)
        found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert found / (10 * len(want)) >= 0.95
        assert all(abs(a - b) <= 1e-9 * b for q in want for (a, i), (b, j) in zip(got[q], want[q], strict=True) if i == j)


def test_far_queries_and_doubles(spark):
    r = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 8)))] + [(1000, [1e30] * 8), (2000, [1e200, -1e200] * 4), (3000, [1e-200] * 8)]
    got, want = answers(ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute_exact(rows, np.float64)
    assert set(got) == set(want) and all(len(v) == 10 and all(np.isfinite(d) for d, _ in v) for v in got.values())


def test_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    r = np.random.default_rng(10)
    rows = [(i * 100, v.tolist()) for i, v in enumerate(r.normal(size=(40, 8)).astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(ann.neighbours(frame, shard_rows=15)) == brute(rows)


def brute_exact(rows, kind=np.float32, k=10):
    x = [(i, np.array(v, kind).astype(np.longdouble)) for i, v in rows]
    return {q: sorted((float(np.sqrt(((v - y) ** 2).sum())), i) for i, y in x if i != q)[:k] for q, v in x if q % 100 == 0}
