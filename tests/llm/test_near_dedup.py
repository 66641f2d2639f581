import random

from inklattice.llm import near_dedup


def brute(rows, percent):
    sets = {}
    for i, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        n = min(5, max(len(words), 1))
        sets[i] = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(prose):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "É é É é"), (8, "é é É é")]
    at = 10
    for base in range(12):
        words = prose(base, r.choice([3, 6, 8, 12, 30, 120, 600])).split()
        for _ in range(r.choice([1, 3, 12])):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
            rows.append((at, " ".join(copy)))
            at += 1
    rows.append((at, prose(99, 4000)))
    rows.append((at + 1, prose(99, 4000) + " more"))
    return rows


def test_groups_equal_brute_force(spark, prose):
    rows = corpus(prose)
    for percent in (80, 85):
        docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, id int, bands int")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, percent=percent).collect()}
        assert got == brute(rows, percent)


def test_all_pairs_left_are_compared(spark, prose, monkeypatch):
    """A chain whose ends are unlike: no leader sees all of it."""
    words = prose(7, 200).split()
    rows = []
    for k in range(24):
        words[k * 3] = f"step{k}"
        rows.append((k, " ".join(words)))
    for rounds in (0, 2):
        monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", rounds)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
        assert got == brute(rows, 85)


def test_empty_and_repeated(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = near_dedup.near_groups(rows).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (3, 3), (9, 3)]
    assert [(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id is None] == [(None, True, 2)]
    assert sorted(str(r.doc_id) for r in near_dedup.keep_one(rows).collect()) == ["3", "3", "None"]


def test_one_id_with_two_texts_joins_nothing(spark, prose):
    a, b = prose(1, 60), prose(2, 60)
    rows = spark.createDataFrame([(1, a), (1, b), (5, a + " end"), (6, b + " end"), (9, prose(3, 60))], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_groups(rows).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (6, 1), (9, 9)]
    assert sorted(r.doc_id for r in near_dedup.keep_one(rows).collect()) == [1, 1, 9]
    # The two texts' groups are two: without the first text its copies name themselves.
    alone = spark.createDataFrame([(3, a), (3, b), (2, a + " end")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_groups(alone).collect()) == [(2, 2), (3, 2), (3, 3)]


def test_large_bucket_in_parts(spark, prose, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_ROWS", 3)
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", 0)
    test_all_pairs_left_are_compared(spark, prose, monkeypatch)


def test_odd_sketch_never_exceeds_the_difference():
    import numpy as np

    r = np.random.default_rng(4)
    for size in (0, 3, 200, 5000):
        a = r.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[size // 10 :], r.integers(0, 2**63, size // 7).astype(np.uint64)])
        x = near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)
        assert sum(int(v).bit_count() if v >= 0 else int(v & (2**64 - 1)).bit_count() for v in x.tolist()) <= len(np.setxor1d(a, b))
