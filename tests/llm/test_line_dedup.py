from inklattice.llm import line_dedup


def test_exact_and_masked_lines(spark, prose):
    shared = prose(1, 60)
    rows = [(1, f"{prose(2, 9)}\n{shared}\npage 12 of 40"), (2, f"{shared}\n\n{prose(3, 9)}\npage 3 of 40"), (3, f"  {shared.replace(' ', '  ')}\t"), (4, None), (5, ""), (6, "x"), (None, shared), (7, "page x of 40"), (7, "page x of 40"), (8, "w" * 50_000)]
    docs = spark.createDataFrame([(i, t, "l", 5) for i, t in rows], "doc_id long, text string, leaf string, n_chars long")
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped, r.leaf) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[(1, rows[0][1])][:2] == (3, 0)
    assert got[(2, f"\n{prose(3, 9)}")][:2] == (4, 2)
    assert got[(3, "")][:2] == (1, 1)
    assert (None, shared) in got and got[(4, None)][:2] == (0, 0) and got[(5, "")][1] == 0
    assert (7, "page x of 40") in got and (8, "w" * 50_000) in got and all(v[2] == "l" for v in got.values())
    kept = line_dedup.keep_new_lines(docs)
    assert kept.columns == docs.columns
    sizes = {r.doc_id: r.n_chars for r in kept.collect()}
    assert 3 not in sizes and sizes[1] == 5 and sizes[2] == len(f"\n{prose(3, 9)}") and {4, 5, 6, 7, 8} <= set(sizes)


def test_variable_fields(spark, prose):
    words = prose(9, 20).split()
    rows = []
    for k in range(6):
        own = list(words)
        own[10] = f"name{'abcdef'[k]}"
        rows.append((k, " ".join(own)))
    other = [*words[:4], *prose(77, 16).split()]
    rows.append((50, " ".join(other)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[50] == rows[-1][1]
    assert all(got[k] == "" for k in range(1, 6))
    many = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=7).collect()}
    assert all(many[k] == rows[k][1] for k in range(6))


def test_several_templates_of_a_leaf(spark, prose):
    """Two templates with a variable word below one leaf; each word stands in one document."""
    lead = prose(5, 4)
    one, two = f"{lead} {prose(6, 4)} {{}} {prose(7, 4)}", f"{lead} {prose(8, 2)} {{}} {prose(9, 6)}"
    rows = [(k, one.format(f"x{'abcde'[k]}") + "\n" + two.format(f"y{'vwxyz'[k]}") + f"\nonly {'fghij'[k]} here") for k in range(5)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (0, rows[0][1]) and all(got[k] == (2, f"only {'fghij'[k]} here") for k in range(1, 5))


def brute(rows):
    """(id, dropped lines) by comparing all pairs of lines."""
    lines = []
    for i, text in rows:
        for line in (text or "").split("\n"):
            tokens = ["<*>" if any(c in "0123456789" for c in t) else t for t in line.split()]
            if tokens:
                lines.append((i, line, tokens))

    def same(a, b):
        if len(a) != len(b) or a[:4] != b[:4]:
            return False
        n, differ = len(a), [k for k in range(len(a)) if a[k] != b[k]]
        width = max(1, n // 10)
        return not differ or (n >= 8 and len({(k - 4) // width for k in differ}) == 1)

    return {(i, line) for i, line, t in lines if any(j < i and same(t, u) for j, _, u in lines)}


def test_equals_brute_force(spark, prose):
    import random

    r = random.Random(3)
    base = [prose(k, n).split() for k, n in enumerate([3, 7, 8, 9, 12, 19, 20, 31, 60])]
    rows = []
    for i in range(40):
        own = []
        for _ in range(r.randint(0, 5)):
            words = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2])):
                words[r.randrange(len(words))] = r.choice(["alpha", "beta", "7", "gamma9"])
            own.append(" ".join(words))
        rows.append((i, "\n".join(own)))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute(rows)
    for i, text in rows:
        kept = [line for line in text.split("\n") if (i, line) not in gone]
        assert got[i].text == "\n".join(kept) and got[i].n_dropped == len(text.split("\n")) - len(kept)


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
