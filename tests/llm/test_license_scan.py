import re

from inklattice.llm import license_scan


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(text):
    w, at, labels = words(text), [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for s in range(len(w) - len(p) + 1):
            if w[s : s + len(p)] == p:
                at.append(s)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def brute_labels(text):
    """Labels by looking at every place of the text for every template."""
    w, labels = words(text), set(filter(None, brute(text)[4].split(",")))
    for label, passage, key in license_scan.TEMPLATES:
        p = words(passage)
        k = words(key) if key else p
        before = next(i for i in range(len(p)) if p[i : i + len(k)] == k)
        for s in range(len(w) - len(k) + 1):
            if w[s : s + len(k)] == k:
                same = sum(0 <= s - before + j < len(w) and w[s - before + j] == x for j, x in enumerate(p))
                if same / len(p) >= license_scan.SHARE:
                    labels.add(label)
    return ",".join(sorted(labels))


def test_base_and_templates(spark, prose):
    mit, bsd = license_scan.TEMPLATES[0][1], next(t for label, t, _ in license_scan.TEMPLATES if label == "bsd")
    texts = {
        1: None, 2: "", 3: "MIT License. mit-license", 4: prose(1, 40), 5: "This work is licensed under the GNU General Public License, version 3.",
        6: f"{prose(2, 30)}\nLicensed under CC BY-NC 4.0.\n{prose(3, 30)}", 7: "cc by cc by cc", 8: f"{prose(4, 9)} " + mit + " and more",
        9: " ".join(sorted(mit.split())), 10: "apache license " * 3000, 11: "É mit É license", 12: bsd.upper(),
        13: "// SPDX-License-Identifier: BSD-3-Clause", 14: "as published by the GNU Affero General Public License as published by the Free Software Foundation",
        15: "Boost Software License - Version 1.0 - August 17th, 2003", 16: "Permission is hereby granted free of charge " + prose(6, 300) + " " + " ".join(mit.split()[8:]),
        17: prose(7, 3000) + " " + bsd + " " + prose(8, 3000), 18: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    }
    rows = [(k, t, "w") for k, t in texts.items()] + [(3, texts[3], "w"), (None, bsd, "w"), (3, bsd, "w")]
    rows += [(100 + k, text, "w") for k, (_, text, _) in enumerate(license_scan.TEMPLATES)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got))) == sorted(map(str, ((i, *brute(t), brute_labels(t)) for i, t, _ in rows)))
    labels = {r.doc_id: r.labels for r in got if r.doc_id != 3}
    assert labels[4] == "" and labels[9] == "" and labels[8] == "mit" and labels[12] == labels[17] == labels[None] == "bsd"
    assert labels[6] == "cc-by,cc-by-nc-4.0" and labels[5] == "gpl,gpl-3.0" and labels[13] == "bsd-3-clause" and labels[14] == "agpl" and labels[15] == "bsl-1.0"
    assert labels[16] == "" and labels[18] == ""
    assert all(0 <= r.score <= 1 for r in got) and {r.doc_id: r.score for r in got}[4] == 0
    assert all(label in labels[100 + k].split(",") for k, (label, _, _) in enumerate(license_scan.TEMPLATES))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).collect() == []
    assert license_scan.scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"), templates=[]).first().labels == "mit"
