import itertools
import math

from inklattice.llm import html_extract as H


def test_held_out_pages():
    model = H.train()
    exact = total = kept_words = all_words = 0
    for source, kept in H.labelled_pages(150, seed=2024):
        got = {m.lower() for m in H._MARK.findall(H.extract(model, source))}
        total += 1
        exact += got == kept
        kept_words += len(got & kept)
        all_words += len(kept)
    assert exact / total >= 0.85 and kept_words / all_words >= 0.97


LONG = "The river rose in the night and by the morning it had reached the lower steps of the mill, where the miller stood with his lamp."
MORE = "Nobody in the village could remember such a flood, and the oldest of them spoke of signs that they had seen in the spring."
LAST = "When the water fell, a week later, the bridge had gone and the road lay under a foot of mud."
NAV = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li><li><a href=/d>Contact</a></li></ul>"

#: Forms that no maker of training pages writes: (page, the text of its article).
FORMS = [
    (f'<html><body><div class="prose"><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></div></body></html>', f"The flood\n{LONG}\n{MORE}\n{LAST}"),
    (f"<html><body><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></body></html>", f"{LONG}\n{MORE}\n{LAST}"),
    (f"<html><body><nav>{NAV}</nav><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p><footer>&copy; 2020 The Mill</footer></body></html>", f"The flood\n{LONG}\n{MORE}"),
    (f'<body><div id="mw-navigation">{NAV}</div><div id="bodyContent"><div class="mw-parser-output"><h1>The flood</h1><p>{LONG} <a href=/x>{MORE}</a></p><h2>After</h2><ul><li>{LAST}</li></ul></div></div></body>', f"The flood\n{LONG} {MORE}\nAfter\n{LAST}"),
    (f'<body class="flex min-h-screen"><header class="sticky top-0"><a href=/>Mill</a> <a href=/n>News</a> <a href=/s>Sport</a></header><div class="max-w-prose mx-auto px-4"><h1 class="text-4xl">The flood</h1><p class="mt-4">{LONG}</p><p class="mt-4">{MORE}</p></div></body>', f"The flood\n{LONG}\n{MORE}"),
    (f'<div class="rte"><h1>The flood</h1><p>{LONG}</p><blockquote>{MORE}</blockquote><p>{LAST}</p></div><div class="comments"><div class="comment"><b>Ann</b><p>I saw it too, it was as high as our door and took the hens.</p></div></div>', f"The flood\n{LONG}\n{MORE}\n{LAST}"),
    (f'<body><main><h1>The flood</h1><p>{LONG}</p><p>It rose <math><mi>x</mi><mo>=</mo><mn>3</mn></math> feet.</p><noscript><p>{LAST}</p></noscript></main><aside>{NAV}</aside></body>', f"The flood\n{LONG}\nIt rose x=3 feet.\n{LAST}"),
    (f"<body><article><h1>The flood</h1>{LONG}<br><br>{MORE}<pre>mud\n  mud</pre></article><div class=ad>Buy lamps now</div></body>", f"The flood\n{LONG} {MORE}\nmud mud"),
]


def test_forms_never_seen():
    model = H.train()
    got = [H.extract(model, page) for page, _ in FORMS]
    assert got == [text for _, text in FORMS]


def article_text(source):
    """The text of a page's only article element by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.silent, self.out = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.silent += tag in ("script", "style")
            self.out.append(" " if tag == "br" else "\n" if tag in H.BLOCKS else "")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.silent -= tag in ("script", "style")
            self.out.append("\n" if tag in H.BLOCKS else "")

        def handle_data(self, data):
            if self.depth and not self.silent:
                self.out.append(" ".join(data.split("\n")) if "\n" in data else data)

    reader = Reader()
    reader.feed(source)
    return "\n".join(b for b in (" ".join(x.split()) for x in "".join(reader.out).split("\n")) if b)


def test_given_pages(spark):
    import os

    import pytest

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    pages = spark.read.parquet(path)
    got = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    want = {r.page_id: article_text(r.html) for r in pages.collect() if r.html and r.html.count("<article") == 1}
    assert len(want) >= 50 and sum(got[k] == t for k, t in want.items()) / len(want) >= 0.99


def test_messages_equal_enumeration():
    model = H.train(H.labelled_pages(40))
    page = H.Page("<div class=menu><a href=/>x</a></div><article><h1>T</h1><p>one two <b>three</b></p></article><footer>f</footer>")
    n = len(page.tags)
    unary = [model.bias + sum(model.weights.get(f, 0.0) for f in row) for row in page.features()]
    mass, total = [0.0] * n, 0.0
    for y in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(u for u, v in zip(unary, y, strict=True) if v) + sum(model.link[y[page.parents[e]]][y[e]] for e in range(1, n)))
        total += p
        for e in range(n):
            mass[e] += p * y[e]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(page), mass, strict=True))


def test_text_of_blocks():
    model = H.train()
    wrap = lambda x: H.extract(model, f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{x}</article></body></html>")
    assert wrap("<h1>A &amp;  B</h1><p>one\n two&nbsp;three<br>four <i>five</i><p>six &#233;<script>var a='<p>x</p>';</script></p>") == "A & B\none two three four five\nsix é"
    assert wrap("<p><b>bold<br><p>next</p> tail 3 < 4 and 5 > 2") == "bold\nnext\ntail 3 < 4 and 5 > 2"
    assert wrap("<p>a<!-- <p>no</p> --></p><p>b <span") == "a\nb"
    assert wrap("<p>" + "long " * 20_000 + "</p>") == ("long " * 20_000).strip()


def test_late_names_count():
    utilities = "flex grid block hidden rounded shadow border italic underline truncate static relative"
    (row,) = [r for r in H.Page(f'<div class="{utilities} sidebar sidebar">x</div>').features() if "t:div" in r]
    assert row.count("n:sidebar") == 1 and row.count("n:flex") == 1


def test_rows(spark):
    rows = [(1, "u", "<article><p>x y z</p></article>", "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", "<<<>>><p", "t"), (1, "u", "<article><p>x y z</p></article>", "t")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got if r.page_id is not None) == [("1", "x y z", 5), ("1", "x y z", 5), ("2", "", 0), ("3", "", 0)]
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).collect() == []


def test_deep_nesting():
    model = H.train(H.labelled_pages(20))
    assert isinstance(H.extract(model, "<div>" * 20_000 + "x" + "</div>" * 20_000), str)
