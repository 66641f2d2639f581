"""The stages on planted cases: toxic texts, repeated passages, copies, benchmark windows, clean texts."""

import random

import corpus_pipeline
from inklattice.llm import near_dedup


def planted(prose):
    r, docs, labels, item = random.Random(1), [], [], prose(900_000, 30)
    passage = prose(900_001, 70)
    clean = {k: "\n".join(prose(100 * k + j, 40) for j in range(4)) for k in range(300)}
    for k, text in clean.items():
        docs.append((k, text))
        labels.append((k, 1, 0))
    for k in range(1000, 1150):
        words = prose(950_000 + k, 60).split()
        for _ in range(8):
            words[r.randrange(60)] = r.choice(["zounder", "blimbag", "quorx", "smeltpig"])
        docs.append((k, " ".join(words)))
        labels.append((k, 0, 1))
    copies = [(2000 + k, clean[5]) for k in range(20)]
    near = []
    for k in range(6):
        words = prose(940_000, 150).split()
        words[30 + k] = f"edit{k}"
        near.append((3000 + k, " ".join(words)))
    repeated = [(4000 + k, f"{prose(910_000 + k, 50)}\n{passage}\n{prose(920_000 + k, 50)}") for k in range(8)]
    leaked = [(6000, f"{prose(930_000, 40)} {item.upper()} {prose(930_001, 40)}")]
    return [*docs, *copies, *near, *repeated, *leaked, (7000, None), (7001, "")], labels, item, passage, clean


def test_stages(spark, prose, tmp_path):
    docs, labels, item, passage, clean = planted(prose)
    d = str(tmp_path)
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    kept, frames = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, d)
        kept.write.parquet(f"{d}/out-{name}")
        kept = spark.read.parquet(f"{d}/out-{name}")
        frames.append({r.doc_id: r for r in kept.collect()})
        if name != "byte_bpe":
            assert kept.dtypes == table.dtypes
    toxic, lines, near, leaks, tokens = frames
    assert sum(k in toxic for k in range(1000, 1150)) <= 8 and sum(k in toxic for k in clean) >= 0.97 * len(clean)
    holders = [k for k, row in lines.items() if passage in (row.text or "")]
    assert holders == [4000] and sum(4000 <= k < 4008 for k in lines) == 8
    assert not any(k in lines for k in range(2000, 2020)) and lines[5].text == clean[5]
    assert all(row.n_chars == len(row.text or "") for row in lines.values())
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.read.parquet(f"{d}/out-line_dedup"), percent=80).collect()}
    assert set(near) == {k for k, c in groups.items() if k == c}
    assert sum(3000 <= k < 3006 for k in near) == 1
    assert 6000 in near and 6000 not in leaks and set(near) - set(leaks) == {6000}
    assert set(tokens) == set(leaks) and all(r.n_tokens >= 0 for r in tokens.values())
    assert {k for k in toxic if k in clean} <= set(leaks) | {k for k in clean if k not in toxic}


def test_run_and_empty_table(spark, prose, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
