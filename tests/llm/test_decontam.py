import hashlib
import re

from inklattice.llm import decontam


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            for window in [p[k : k + 10] for k in range(max(1, len(p) - 9))] if p else []:
                for s in range(len(w) - len(window) + 1):
                    if w[s : s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        met.add(str(item))
        out[i] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))
    return out


def test_equals_brute_force(spark, prose):
    items = [(k, prose(500 + k, 25)) for k in range(12)] + [(20, "short item"), (21, "x"), (22, None), (23, "..."), (24, "a a a a a a a a a a a"), (3, prose(503, 25)), (30, prose(503, 25))]
    docs = [(k, prose(k, 60)) for k in range(20)]
    docs += [(100 + k, prose(k, 30) + "\n" + items[k][1].upper() + ", " + prose(k, 9)) for k in range(12)]
    docs += [(200, None), (201, ""), (202, "this SHORT-item here; short item"), (203, "x"), (204, "a " * 40), (205, " ".join(t for _, t in items if t)), (206, " ".join(items[2][1].split()[3:13])), (207, " ".join(items[2][1].split()[3:12]))]
    docs += [(208, (items[4][1] + " ") * 200), (205, " ".join(t for _, t in items if t))]
    got = decontam.decontaminate(spark.createDataFrame([(i, t, "y", 1) for i, t in docs], "doc_id long, text string, words string, len int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    want = brute(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    words_ = items[5][1].split()
    near = spark.createDataFrame([(1, " ".join([*words_[:6], "inserted", *words_[6:]]))], "doc_id long, text string")
    row = decontam.decontaminate(near, spark.createDataFrame([items[5]], "item_id long, text string")).first()
    assert row.near and all(m["items"] == ["5"] and m.len == 10 for m in row.near)
    assert row.n_hit == 19 and {m.start for m in row.hits} == set(range(7, 17))  # the windows behind the inserted word


def test_null_and_shared_ids(spark, prose):
    items = [(1, prose(500, 12))]
    docs = [(None, prose(500, 12)), (None, prose(3, 30)), (7, prose(500, 12)), (7, prose(4, 30)), (8, "x " * 30 + prose(500, 12))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_hit) for r in decontam.decontaminate(frame, bench).collect())
    assert got == [("7", 0), ("7", 12), ("8", 12), ("None", 0), ("None", 12)]
    assert sorted(str(r.doc_id) for r in decontam.keep_clean(frame, bench).collect()) == ["7", "None"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (None, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.n_words, r.contaminated) for r in decontam.decontaminate(docs.filter("doc_id = 1"), items).collect()] == [(1, 2, False)]
    assert decontam.decontaminate(docs.limit(0), items).collect() == []
    assert decontam.keep_clean(docs, items).count() == 2
