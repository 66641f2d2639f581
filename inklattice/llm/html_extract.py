"""HTML extraction with a tree-structured graphical model (operator 7).

A page becomes a tree of elements.  Each element has a binary variable, article or not, with a potential from its
own features (tag, parent's tag, words of class, id and role, link density, amounts of text and of paragraphs, share of
the page's text, headings, what comes before) and one with its parent's variable.  Sum-product message passing, upward then downward, gives every element's marginal; the text
directly inside elements of marginal 0.5 or more is the article.

The potentials are trained on ``LABELLED_PAGES`` pages made by ``labelled_pages`` from a seed: pages whose parts
are known, with articles of many forms (in article elements, in containers of telling, made-up or no names, or straight in the body)
among menus, headers, footers, sidebars, notices, adverts, forms, related links and reader comments, with telling or made-up names too.
Scripts, styles, templates, frames, the head and form controls never hold text; all other elements may.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by a newline; empty blocks vanish.  ``br`` is white space inside its block.

Nulls: a null or empty html gives an empty text of 0 characters; a null url stays null.  Bytes that are not UTF-8 become U+FFFD.  Unclosed and stray tags
are tolerated; an unclosed comment or raw element ends with the page.  Repeated rows are extracted alike.  Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LABELLED_PAGES = 1500
SEED = 11

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never part of a page's text.
SILENT = frozenset("head script style title iframe template textarea select option button datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Starting one of these ends an open p.
ENDS_P = BLOCKS - frozenset("body caption html legend dd dt li td th tr tbody thead tfoot summary title".split()) | frozenset(["li", "dd", "dt"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("html body article aside main section div header footer nav form table td th ul ol dl blockquote figure fieldset details dialog".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


#: A marked word of a made page.
_MARK = re.compile(r"[qQ]z\d+")


class Page:
    """Elements in document order: tag, parent, names, and text runs (element, text or None for a block's edge)."""

    __slots__ = ("names", "parents", "runs", "tags")

    def __init__(self, source: str):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.names: list[list[str]] = [[]]
        self.runs: list[tuple[int, str | None]] = []
        self._parse(source)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append([w for _, v in ATTRIBUTE.findall(attributes) for w in NAME.findall(CAMEL.sub(r"\1 \2", v).lower())] if attributes else [])
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        tags, runs, stack, at, size = self.tags, self.runs, [0], 0, len(source)
        silent = 0

        def text(part: str) -> None:
            if part and not silent:
                runs.append((stack[-1], html_lib.unescape(part) if "&" in part else part))

        def pop_to(k: int) -> None:
            nonlocal silent
            while len(stack) > k:
                t = tags[stack.pop()]
                silent -= t in SILENT
                if t in BLOCKS:
                    runs.append((stack[-1], None))

        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                text(source[at:])
                break
            text(source[at:lt])
            nxt = source[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                end = source.find("-->", lt + 4) + 3 if source.startswith("<!--", lt) else source.find(">", lt) + 1
                at = end if end > 2 or (end > 0 and nxt == "?") else size
                if end in (0, 2):
                    at = size
                continue
            m = TAG.match(source, lt) or PLAIN_TAG.match(source, lt)
            if m is None:
                if nxt.isalpha() or (nxt == "/" and source[lt + 2 : lt + 3].isalpha()):
                    break  # a tag that the page's end cuts off
                text("<")
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    own = tags[stack[k]]
                    if own == tag:
                        pop_to(k)
                        break
                    if own in SCOPES and tag not in SCOPES:
                        break
                continue
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    own = tags[stack[k]]
                    if own == "p":
                        pop_to(k)
                        break
                    if own in SCOPES:
                        break
            if tag in SIBLINGS:
                last = 0
                for k in range(len(stack) - 1, 0, -1):
                    own = tags[stack[k]]
                    if own in SIBLINGS[tag]:
                        last = k
                    elif own in ("ul", "ol", "dl", "table", "select"):
                        break
                if last:
                    pop_to(last)
            elif tag == "body" or (tag in BLOCKS and tags[stack[-1]] == "head"):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "head":
                        pop_to(k)
                        break
            if tag in BLOCKS:
                runs.append((stack[-1], None))
            elif tag == "br":
                text(" ")
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
                continue
            node = self._open(tag, stack[-1], m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                if tag not in SILENT and not silent:
                    inner = source[at : end.start() if end else size]
                    runs.append((node, inner))
                    if tag in BLOCKS or tag == "xmp":
                        runs.append((stack[-1], None))
                close = source.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else size
                continue
            stack.append(node)
            silent += tag in SILENT

    def features(self) -> list[list[str]]:
        """Names of the features of each element."""
        n = len(self.tags)
        own, whole, linked, paragraphs, titles = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        before, at = [0] * n, 0  # text before an element's first
        for e, t in self.runs:
            if t:
                size = len(t.strip())
                if not own[e]:
                    before[e] = at
                own[e] += size
                at += size
        for e in range(n):
            whole[e] = own[e]
        first = [b if o else -1 for b, o in zip(before, own, strict=True)]
        for e in range(n - 1, 0, -1):
            p, tag = self.parents[e], self.tags[e]
            if tag == "a":
                linked[e] = whole[e]
            titles[e] += tag == "h1"
            whole[p] += whole[e]
            linked[p] += linked[e]
            titles[p] += titles[e]
            paragraphs[p] += (tag == "p" and own[e] + whole[e] > 0) + paragraphs[e]
            if first[e] >= 0 and (first[p] < 0 or first[e] < first[p]):
                first[p] = first[e]
        total, out, titled = max(whole[0], 1), [], False
        for e in range(n):
            tag, p = self.tags[e], self.parents[e]
            near = self.tags[p] if p >= 0 else ""
            density = linked[e] / whole[e] if whole[e] else 0.0
            share = min(int(8 * whole[e] / total), 7)
            place = "h1" if titles[e] else "after" if titled else "before"
            titled = titled or tag == "h1"
            row = [f"t:{tag}", f"t:{tag}<{near}", f"l:{min(int(density * 4), 3)}" if linked[e] else "l:no", f"w:{min(whole[e].bit_length(), 11)}", f"o:{min(own[e].bit_length(), 9)}", f"p:{min(paragraphs[e], 3)}", f"t:{tag}:w{min(whole[e].bit_length(), 10) // 2}"]
            around = paragraphs[p] if p >= 0 else 0
            row += [f"s:{share}", f"h:{place}", f"h:{place}:t:{tag}", f"q:{min(max(first[e], 0) * 4 // total, 3)}:{place}", f"a:{min(around, 4)}:{tag == 'p'}:{place}"]
            row += [f"n:{w}" for w in dict.fromkeys(self.names[e])]
            out.append(row)
        return out

    def text(self, keep) -> str:
        blocks, current = [], []
        for e, t in self.runs:
            if t is None:
                if current:
                    blocks.append("".join(current))
                    current = []
            elif keep[e]:
                current.append(t)
        blocks.append("".join(current))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


class Model:
    """Weights of features and the two-by-two table of parent and child, in logarithms."""

    def __init__(self, weights: dict[str, float], bias: float, link: list[list[float]]):
        self.weights, self.bias, self.link = weights, bias, link

    def marginals(self, page: Page) -> list[float]:
        """Probability that each element is part of the article, by sum-product messages on the tree."""
        n, parents, get = len(page.tags), page.parents, self.weights.get
        unary = [self.bias + sum(get(f, 0.0) for f in row) for row in page.features()]
        (l00, l01), (l10, l11) = self.link
        # Log-odds suffice for binary variables: up[e] is what a child tells its parent.
        total, up = list(unary), [0.0] * n
        for e in range(n - 1, 0, -1):
            up[e] = _sum(l10, l11 + total[e]) - _sum(l00, l01 + total[e])
            total[parents[e]] += up[e]
        belief = list(total)
        for e in range(1, n):
            rest = belief[parents[e]] - up[e]
            belief[e] = total[e] + _sum(l01, l11 + rest) - _sum(l00, l10 + rest)
        return [1 / (1 + math.exp(-max(min(b, 500.0), -500.0))) for b in belief]


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def labelled_pages(count: int = LABELLED_PAGES, seed: int = SEED) -> Iterator[tuple[str, set[str]]]:
    """Pages with the marks (words of the form ``qz<number>``) that stand in their articles."""
    r = random.Random(seed)
    marks = iter(range(10**9))
    syllables = "la to mi ren sol ka ve du ni por est al".split()
    kept: set[str] = set()

    def words(n: int, article: bool) -> str:
        m = f"qz{next(marks)}"
        if article:
            kept.add(m)
        return " ".join([m, *("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))]).capitalize() + r.choice([".", ".", "", "!"])

    def links(n: int, article: bool = False, tag: str = "ul") -> str:
        items = [f'<a href="/{k}">{words(r.randint(0, 3), article)}</a>' for k in range(n)]
        return f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>" if tag != "span" else " | ".join(items)

    def made_up() -> str:
        return r.choice(["", "c-", "css-", "x", "m-", "b_"]) + "".join(r.choices(syllables, k=r.randint(1, 3)))

    def named(tag: str, names: list[str], body: str) -> str:
        how = r.choice(["class", "class", "id", "none"])
        if r.random() < 0.12:
            names = [made_up()]
        return f"<{tag}>{body}</{tag}>" if how == "none" and tag not in ("div", "section", "span") else f'<{tag} {"id" if how == "id" else "class"}="{r.choice(names)}">{body}</{tag}>'

    def paragraph() -> str:
        inner = words(r.choice([0, 1, 3, 8, 20, 40, 80]), True)
        if r.random() < 0.3:
            inner += f" <{r.choice(['b', 'i', 'em', 'strong', 'span', 'code'])}>{words(4, True)}</b>"
        if r.random() < 0.25:
            inner += f' <a href="http://x/">{words(3, True)}</a> {words(6, True)}'
        return f"<p>{inner}" + r.choice(["</p>", "</p>", ""])

    def article() -> str:
        parts = [f"<h1>{words(5, True)}</h1>"] if r.random() < 0.7 else []
        if parts and r.random() < 0.3:
            parts = [f"<header>{parts[0]}<p>{words(6, True)}</p></header>"]
        for _ in range(r.choice([1, 1, 2, 3, 6, 12])):
            kind = r.random()
            if kind < 0.65:
                parts.append(paragraph())
            elif kind < 0.73:
                parts.append(f"<h{r.choice('23')}>{words(3, True)}</h2>")
            elif kind < 0.81:
                parts.append("<ul>" + "".join(f"<li>{words(r.choice([2, 9]), True)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{words(12, True)}</blockquote>")
            elif kind < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, True)}</td><td>{words(1, True)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.94:
                parts.append(f"<figure><img src=a><figcaption>{words(5, True)}</figcaption></figure>")
            elif kind < 0.97:
                parts.append(f"<pre>{words(8, True)}</pre>")
            else:
                parts.append(named("div", ["ad", "ads", "advert", "advertisement", "promo"], words(4, False)))
        if r.random() < 0.12:  # text with line breaks instead of paragraphs
            parts = [*parts[:1], "<br><br>".join(words(r.choice([15, 40, 80]), True) for _ in range(r.randint(1, 4)))]
        if r.random() < 0.08:
            parts.insert(r.randint(0, len(parts)), r.choice([f"<noscript>{words(6, True)}</noscript>", f"<p>{words(3, True)} <math><mi>{words(0, True)}</mi></math></p>", f"<figure><svg><text>{words(1, True)}</text></svg></figure>"]))
        body = "".join(parts)
        if r.random() < 0.3:
            body = named("div", ["body", "text", "inner", "wrap", "entry"], body)
        how = r.random()
        if how < 0.55:
            tag = r.choice(["article", "article", "article", "main", "div", "section"])
            if tag in ("div", "section"):
                return f'<{tag} {r.choice(["class", "id"])}="{r.choice(["content", "main", "article", "post", "entry-content", "story", "main-content", "article-body", "post-content"])}">{body}</{tag}>'
            return f"<{tag}>{body}</{tag}>"
        if how < 0.75:
            return f'<{r.choice(["div", "div", "section"])} {r.choice(["class", "id"])}="{" ".join(made_up() for _ in range(r.randint(1, 3)))}">{body}</div>'
        if how < 0.85:
            return f"<div>{body}</div>"
        if how < 0.88:
            return f"<table><tr><td>{body}</td></tr></table>"
        return body

    def comments() -> str:
        inner = "".join(named("div", ["comment", "reply", "comment-body"], f"<b>{words(1, False)}</b><p>{words(r.choice([5, 20, 40]), False)}</p>") for _ in range(r.randint(1, 4)))
        return named("section", ["comments", "comment-list", "discussion", "responses", "respond"], f"<h3>{words(1, False)}</h3>{inner}") if r.random() < 0.7 else f'<ol class="{r.choice(["comments", "commentlist"])}">' + "".join(f'<li class="comment"><p>{words(15, False)}</p></li>' for _ in range(2)) + "</ol>"

    before = [
        lambda: f"<nav>{links(r.randint(1, 8), tag=r.choice(['ul', 'span', 'ol']))}</nav>",
        lambda: named("div", ["nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topbar", "toolbar"], links(r.randint(1, 8), tag=r.choice(["ul", "span"]))),
        lambda: links(r.randint(2, 8)),
        lambda: f"<header><div>{words(2, False)}</div>{links(3)}</header>",
        lambda: named("div", ["header", "masthead", "site-header", "logo", "banner"], f"<p>{words(4, False)}</p>"),
        lambda: named("div", ["cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay"], f"<p>{words(r.choice([8, 20]), False)}</p>"),
        lambda: named("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], words(r.choice([2, 6, 15]), False)),
        lambda: f"<form><label>{words(1, False)}</label><input><p>{words(5, False)}</p></form>",
    ]
    after = [
        comments,
        comments,
        lambda: f"<aside>{r.choice([links(4), f'<p>{words(12, False)}</p>', f'<h3>{words(2, False)}</h3><p>{words(9, False)}</p>'])}</aside>",
        lambda: named("div", ["sidebar", "side", "widget", "related", "recommended", "more", "popular", "trending", "side-column"], f"<h3>{words(1, False)}</h3>" + r.choice([links(4), f"<p>{words(14, False)}</p>"])),
        lambda: named("div", ["share", "social", "newsletter", "subscribe", "signup", "tags", "author-bio", "pagination", "pager"], r.choice([links(3), f"<p>{words(7, False)}</p>"])),
        lambda: f"<form>{words(3, False)}<input></form>",
        before[6],
        before[5],
    ]
    for _ in range(count):
        kept = set()
        head = f"<head><title>{words(4, False)}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        parts = [r.choice(before)() for _ in range(r.randint(0, 4))] + [article()] + [r.choice(after)() for _ in range(r.randint(0, 4))]
        if r.random() < 0.85:
            parts.append(r.choice([f"<footer>&copy; {words(r.choice([3, 12]), False)}</footer>", f"<footer><p>{words(6, False)}</p>{links(3)}</footer>", f'<div class="{r.choice(["footer", "copyright", "site-footer"])}"><p>{words(8, False)}</p></div>']))
        if r.random() < 0.3:
            cut = r.randint(0, len(parts) - 1)
            parts = [*parts[:cut], f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout"])}">', *parts[cut:], "</div>"]
        page = f"<!DOCTYPE html><html>{head}<body>" + "".join(parts) + r.choice(["</body></html>", ""])
        yield page, kept & {m.lower() for m in _MARK.findall(page)}


def train(pages: Iterator[tuple[str, set[str]]] | None = None, steps: int = 200) -> Model:
    """Feature weights and the parent-child table by regularised pseudo-likelihood: each element given its parent and children."""
    rows: list[list[str]] = []
    labels: list[int] = []
    near: list[list[float]] = []
    for source, kept in pages if pages is not None else labelled_pages():
        page = Page(source)
        n = len(page.tags)
        good, bad = [0] * n, [0] * n
        for e, t in page.runs:
            for m in _MARK.findall(t or ""):
                if m.lower() in kept:
                    good[e] += 1
                else:
                    bad[e] += 1
        for e in range(n - 1, 0, -1):
            good[page.parents[e]] += good[e]
            bad[page.parents[e]] += bad[e]
        # An element with text of both kinds below is outside the article unless most of it is inside.
        own = [int(good[e] > 0 and good[e] >= 4 * bad[e]) for e in range(n)]
        own[0] = 0
        below, inside = [0] * n, [0] * n
        for e in range(1, n):
            if good[e] + bad[e]:
                below[page.parents[e]] += 1
                inside[page.parents[e]] += own[e]
        for e, row in enumerate(page.features()):
            if e and good[e] + bad[e]:
                up = own[page.parents[e]]
                rows.append(row)
                labels.append(own[e])
                # With the table (0, a; c, b + c), what parent and children add to the log-odds is linear in a, b and c.
                near.append([1 - up - inside[e], up + inside[e], below[e]])
    index: dict[str, int] = defaultdict(lambda: len(index))
    at = np.array([(k, index[f]) for k, row in enumerate(rows) for f in row])
    y, w, b = np.array(labels, float), np.zeros(len(index)), 0.0
    links, v = np.array(near, float).reshape(-1, 3), np.zeros(3)
    if len(at):
        squares, square_b, square_v = np.full(len(index), 1e-3), 1e-3, np.full(3, 1e-3)
        for _ in range(steps):
            z = b + np.bincount(at[:, 0], w[at[:, 1]], len(rows)) + links @ v
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g, h = np.bincount(at[:, 1], d[at[:, 0]], len(index)) + 0.3 * w, links.T @ d + 0.3 * v
            squares += g * g
            square_b += d.sum() ** 2
            square_v += h * h
            w -= 0.5 * g / np.sqrt(squares)
            b -= 0.5 * d.sum() / np.sqrt(square_b)
            v -= 0.5 * h / np.sqrt(square_v)
    link = [[0.0, float(v[0])], [float(v[2]), float(v[1] + v[2])]]
    return Model({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-4}, float(b), link)


def extract(model: Model, source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    return page.text([m >= 0.5 for m in model.marginals(page)])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """id, url, text, n_chars of every row."""
    own = model or train()
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(at, 256)
                sources = part.column(2).cast(pa.binary())
                texts = [extract(own, (t.as_py() or b"").decode("utf-8", "replace")) for t in sources]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string, n_chars long")
