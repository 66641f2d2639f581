"""License scans by a positional rare-token index (operator 6), in DataFrame functions only.

Words: A-Z folded, then runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  Templates: the base phrases,
SPDX identifier lines, and passages of licence texts and notices, each with a mandatory key phrase.

1. Words of templates get inverse document frequencies from all documents.
2. The index holds, for the ``RARE`` rarest words of each key phrase, which templates use them and where.
3. Each such word in a text is looked up; its postings say where the key phrase would begin.  The postings of a
   template's words are intersected by that place.
4. At each place left the whole key phrase must stand.  A base phrase is then found; a licence template is found if
   ``share`` of its passage's words stand at their places around the key phrase, too.  Its label is added to the base labels.

All of that happens inside a row, so there is no shuffle but that of the words' counts, and no group of rows.

score: 1 with a base label, else the largest share of a found template, else 0.

Nulls: a null text is empty (no words); rows with a null id are scanned like others.  Repeated rows give repeated
rows.  Rarest words at equal frequencies: the earlier in the phrase.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inklattice.llm.decontam import words_of

RARE = 3
SHARE = 0.5
#: A place and a template as one number: place * TEMPLATES_AT + template.
TEMPLATES_AT = 4096

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Identifiers in lines of the form SPDX-License-Identifier: <id>; the label is the identifier in lower case.
SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "NCSA", "X11", "PostgreSQL", "Python-2.0", "PHP-3.01", "Ruby",
    "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CDDL-1.0", "CPL-1.0", "Artistic-1.0", "Artistic-2.0", "MS-PL", "OFL-1.1",
    "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
]

#: Passages of licences and notices as they are published: label, passage, key phrase inside it (None: all of it).
PASSAGES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", None),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "licensed under the apache license version 2 0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache license version 2 0 january 2004"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", None),
    ("gpl-2.0", "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful", "either version 2 of the license or at your option any later version this program"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", None),
    ("gpl-3.0", "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful", "either version 3 of the license or at your option any later version this program"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the GNU Library General Public License as published by the Free Software Foundation", "gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", None),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", None),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", None),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", "gnu affero general public license version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY", "in the documentation and or other materials provided with the distribution this software is provided by"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement", None),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS", "for any purpose with or without fee is hereby granted the software is provided as is"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "boost software license version 1 0"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", None),
    ("ncsa", "University of Illinois/NCSA Open Source License", "illinois ncsa open source license"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "for any purpose without fee and without a written agreement is hereby granted"),
    ("python-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2", None),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1", "subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    ("mpl-2.0", "Mozilla Public License Version 2.0", None),
    ("epl-1.0", "Eclipse Public License - v 1.0", None),
    ("epl-2.0", "Eclipse Public License - v 2.0", None),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", "eclipse public license 2 0"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2", None),
    ("cddl-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", None),
    ("cpl-1.0", "Common Public License Version 1.0", None),
    ("artistic-2.0", "The Artistic License 2.0", "artistic license 2 0"),
    ("ms-pl", "Microsoft Public License (Ms-PL)", "microsoft public license"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "sil open font license version 1 1"),
    ("cc0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", "cc0 1 0 universal"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0 international"),
    ("cc-by-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", "creative commons attribution 3 0 unported"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons attribution noderivatives 4 0 international"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4 0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
]

TEMPLATES = PASSAGES + [(i.lower(), f"SPDX-License-Identifier: {i}", None) for i in SPDX]


def plain_words(text: str) -> list[str]:
    """The same words in Python, for templates and phrases."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    spaced = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in low)
    return [w for w in spaced.split(" ") if w]


def inverse_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """ln((N + 1) / (df + 1)) of the templates' words over all rows of ``words`` (a fixed, small vocabulary)."""
    met = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    total = words.count()
    df = {r.w: r.df for r in met.collect()}
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def find(words: Column, passages: list[list[str]], keys: list[tuple[int, list[str]]], idf: dict[str, float], rare: int = RARE) -> Column:
    """Sorted (place of the key phrase, template) numbers of all key phrases in ``words``.

    keys: where in its passage each key phrase begins, and its words.
    """
    uses: dict[str, list[tuple[int, int, int]]] = {}
    for t, (_, phrase) in enumerate(keys):
        chosen = sorted(range(len(phrase)), key=lambda p: (-idf[phrase[p]], p))[:rare]
        for rank in range(rare):  # a phrase of fewer words names its last one again
            p = chosen[min(rank, len(chosen) - 1)]
            uses.setdefault(phrase[p], []).append((t, p, rank))
    index = F.create_map(*[x for w, own in uses.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(r).alias("r")) for t, p, r in own]))])
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(uses)), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    posted = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h.w), lambda u: F.struct(u.r.alias("r"), ((h.i - u.p).cast("long") * TEMPLATES_AT + u.t).alias("at")))))
    by_rank = lambda all_, r: F.transform(F.filter(all_, lambda x: x.r == r), lambda x: x["at"])

    def meet(all_: Column) -> Column:
        out = by_rank(all_, 0)
        for r in range(1, rare):
            out = F.array_intersect(out, by_rank(all_, r))
        return out

    size, text = F.array(*[F.lit(len(p)) for _, p in keys]), F.array(*[F.lit(" ".join(p)) for _, p in keys])

    def stands(c: Column) -> Column:
        t = F.pmod(c, F.lit(TEMPLATES_AT)).cast("int")
        place = F.floor(c / TEMPLATES_AT).cast("int")
        return (c >= 0) & (F.array_join(F.slice(words, F.greatest(place, F.lit(0)) + 1, F.element_at(size, t + 1)), " ") == F.element_at(text, t + 1))

    # The postings are named once, so that they are made once for a row.
    return F.array_sort(F.flatten(F.transform(F.array(posted), lambda all_: F.filter(meet(all_), stands))))


def shares(words: Column, found: Column, passages: list[list[str]], keys: list[tuple[int, list[str]]]) -> Column:
    """(template, share of the passage's words that stand at their places around the key phrase) of each found place."""
    whole = F.array(*[F.array(*map(F.lit, p)) for p in passages])
    before = F.array(*[F.lit(at) for at, _ in keys])

    def share(c: Column) -> Column:
        t = F.pmod(c, F.lit(TEMPLATES_AT)).cast("int")
        start = F.floor(c / TEMPLATES_AT).cast("int") - F.element_at(before, t + 1)
        own = F.element_at(whole, t + 1)
        skip = F.greatest(-start, F.lit(0))  # words of the passage before the text's first
        same = F.zip_with(F.slice(own, skip + 1, F.size(own)), F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(own) - skip), lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.struct(t.alias("t"), (F.size(F.filter(same, lambda x: x)) / F.size(own)).alias("share"))

    return F.transform(found, share)


def located(base: dict[str, str], templates) -> tuple[list[str], list[list[str]], list[tuple[int, list[str]]]]:
    """Labels, passages, and key phrases with their places in them; base phrases first."""
    names = [*base.values(), *(label for label, _, _ in templates)]
    passages = [plain_words(x) for x in [*base, *(text for _, text, _ in templates)]]
    keys = []
    for words, key in zip(passages, [*[None] * len(base), *(key for _, _, key in templates)], strict=True):
        phrase = plain_words(key) if key else words
        at = next((k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase), None)
        if at is None or not phrase:
            raise ValueError(f"key phrase {key!r} does not stand in its passage")
        keys.append((at, phrase))
    if len(names) >= TEMPLATES_AT:
        raise ValueError(f"{TEMPLATES_AT - 1} templates at most")
    return names, passages, keys


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates=None, rare: int = RARE, share: float = SHARE) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    names, passages, keys = located(base, templates)
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    if names:
        idf = inverse_frequencies(words, sorted({w for _, p in keys for w in p}))
        found = find(F.col("words"), passages, keys, idf, rare)
    else:
        found = F.array().cast("array<bigint>")
    placed = words.withColumn("found", found)
    n, at = len(base), lambda c: F.pmod(c, F.lit(TEMPLATES_AT))
    placed = placed.select("id", "words", F.size("words").cast("long").alias("n_words"), F.filter("found", lambda c: at(c) < n).alias("based"), F.filter("found", lambda c: at(c) >= n).alias("more"))
    label = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    if templates:
        placed = placed.withColumn("more", F.filter(shares(F.col("words"), F.col("more"), passages, keys), lambda m: m.share >= share))
        extra, best = F.transform("more", lambda m: F.element_at(label, m.t + 1)), F.array_max(F.transform("more", lambda m: m.share))
    else:
        extra, best = F.array().cast("array<string>"), F.lit(None).cast("double")
    places = F.transform("based", lambda c: F.floor(c / TEMPLATES_AT))
    out = placed.withColumn("own", F.array_sort(F.array_distinct(F.transform("based", lambda c: F.element_at(label, at(c).cast("int") + 1)))) if base else F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("based").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", extra))), ",").alias("labels"),
        F.when(F.size("own") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def oracle_sql(base: dict[str, str] = BASE, templates=TEMPLATES, share: float = SHARE) -> str:
    """DuckDB statement with the rows of ``scan``: every place of each key phrase's first word is compared with the template."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    rows = ",\n".join(
        f"({t}, {quoted(name)}, {str(t < len(base)).lower()}, {quoted(key[0])}, {len(key)}, {quoted(' '.join(key))}, {at}, [{', '.join(map(quoted, passage))}])"
        for t, (name, passage, (at, key)) in enumerate(zip(*located(base, templates), strict=True))
    )
    return rf"""
WITH t(t, label, based, first, size, phrase, before, passage) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
m AS (SELECT p.r, i, t.t FROM p JOIN t ON t.first = p.x),
h AS (SELECT m.r, m.i, t.*, d.w FROM m JOIN d ON d.r = m.r JOIN t ON t.t = m.t WHERE array_to_string(d.w[m.i:m.i + t.size - 1], ' ') = t.phrase),
s AS (SELECT r, i, label, based, len(list_filter(generate_series(1, len(passage)), lambda k: i - before + k - 1 >= 1 AND coalesce(w[i - before + k - 1] = passage[k], false))) / len(passage) AS share FROM h),
g AS (SELECT r, count(*) FILTER (based) AS n_base, min(i - 1) FILTER (based) AS first_word, max(i - 1) FILTER (based) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (based) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) FILTER (NOT based) AS best FROM s WHERE based OR share >= {share} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN base_labels IS NOT NULL THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN g ON g.r = d.r
"""
