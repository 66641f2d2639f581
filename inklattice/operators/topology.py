"""Cable topology of drawings: strip diagrams, circuit loops, cabinet regions, terminals and the geometry graph.

Work on one document's rows in file order; the ``scan_`` functions run them grouped by document, for documents of the
classes that have an analyzer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterable
from functools import cache
from math import floor, hypot

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inklattice.functions.text import CABLE_PREFIX, LOOP_LIKE, STRIP_NAME, WIRE_SERIAL
from inklattice.operators.grouped import Packed, per_document, together
from inklattice.operators.shapes import Box, Point, Word, corner_box, four_segment_boxes, holds, points_of, spans, words_of, written
from inklattice.operators.tables import schedule_records

RECORD = "document_hash string, cable_id string, conductor_no int, strip_name string, terminal_no int, terminal_no_remote string, cabinet_name string, cabinet_name_remote string, circuit_desc string, loop_id string, source_type string, wire_type string, error string"
REGION = "document_hash string, id string, name string, location string, display_name string, text_label string, x double, y double, w double, h double, layer string, handle string, ltype string, error string"
TERMINAL = "document_hash string, cabinet_id string, terminal_id string, kind string, x double, y double, error string"
# Names of dashed line types.
DASHED = frozenset({
    "ACAD_ISO10W100", "HIDDEN", "DASHED", "DASH", "DOTTED", "DASHDOT",
    "DASHED2", "HIDDEN2", "DASHEDX2", "HIDDENX2", "DOT2", "DASHDOT2", "DOT",
    "ACAD_ISO02W100", "ACAD_ISO03W100", "ACAD_ISO04W100", "ACAD_ISO05W100", "ACAD_ISO06W100", "ACAD_ISO07W100", "ACAD_ISO08W100", "ACAD_ISO09W100",
    "BATTING", "BATTING2",
})
# Words in names of cabinets, and what a short name looks like.
NAME_WORDS = ("屏", "柜", "箱", "端子排图")
SHORT_NAME = r"^[A-Za-z0-9][A-Za-z0-9._\-]{0,12}$"
SHORT, NAMED, SERIAL, WHOLE = re.compile(SHORT_NAME), re.compile("|".join(NAME_WORDS)), re.compile(WIRE_SERIAL), re.compile(r"\s*[+-]?[0-9]+\s*")
STRIP_LIKE, CABLE, LOOP = re.compile("|".join(STRIP_NAME)), re.compile(CABLE_PREFIX), [re.compile(p) for p in LOOP_LIKE]
# Tags of terminals; icons need no text, names need a colon.
ICON_TAGS, NAME_TAGS = ("TERNO", "BL", "BR"), ("NO", "ObjTerm.Name")
#: So many texts above a region are looked at one by one, more as arrays.
MANY = 64


class ByHeight:
    """Things with a y, for scans of a band; a band comes in file order."""

    def __init__(self, things: list, y: Callable):
        ys = [y(t) for t in things]
        self.order = sorted(range(len(things)), key=ys.__getitem__)
        self.ys = [ys[k] for k in self.order]
        self.things = things

    def band(self, low: float, high: float) -> list:
        a, b = bisect_left(self.ys, low), bisect_right(self.ys, high)
        return [self.things[k] for k in sorted(self.order[a:b])] if b > a else []


def cable_of(eed: object) -> str:
    """The first extended-data value that begins with a cable id."""
    for value in eed if eed is not None else []:
        m = CABLE.match(value or "")
        if m:
            return m[1]
    return ""


def column_roles(texts: list[str]) -> dict[str, str | None]:
    """Ordered fold of a column's texts (the same as the Column form in ``functions.text``)."""
    out: dict[str, str | None] = dict.fromkeys(("terminal_no", "loop_id", "circuit_desc", "unknown"))

    def put(t: str, *names: str) -> None:
        free = next((n for n in names if out[n] is None), None)
        if free:
            out[free] = t

    for t in texts:
        if t.isdigit():  # of several numbers the first counts, the others go
            put(t, "terminal_no")
        elif ("-" in t and len(t) >= 4) or any(p.match(t) for p in LOOP):
            put(t, "loop_id", "circuit_desc", "unknown")
        elif any(c.isalpha() for c in t):
            put(t, "circuit_desc", "unknown")
        else:
            put(t, "unknown", "circuit_desc")
    return out


def strip_name(x: float, y: float, ones: ByHeight, words: ByHeight) -> str | None:
    """Of words like strips, the nearest to the left of the text "1" next to a terminal: the nearest to its left, else the nearest."""
    level = [p for p in ones.band(y - 41, y + 41) if abs(p[1] - y) < 40]
    start = min([p for p in level if p[0] < x - 1] or level, key=lambda p: abs(p[0] - x), default=None)
    if start is None:
        return None
    named = [w for w in words.band(start[1] - 38, start[1] + 38) if w[0] < start[0] - 3 and abs(w[1] - start[1]) < 38]
    best = min(named, key=lambda w: start[0] - w[0], default=None)
    return best and best[2]


def strip_records(rows: list[dict], least: float = 20.0) -> list[dict]:
    """Conductors of a strip diagram.

    Lines with a cable's extended data are grouped by cable.  Each vertical of a cable, ``least`` long or more, is a
    conductor that leaves the cable's first horizontal; the texts beyond its far end say what it is joined to.
    """
    words, ones, tagged, title = [], [], {"NO": [], "EQUNAME": []}, None
    cables: dict[str, tuple[list, list]] = {}
    for r in rows:
        kind = r["kind"]
        if kind == "LINE":
            pts = points_of(r)
            cable = cable_of(r.get("eed"))
            if cable:
                flat, up = cables.setdefault(cable, ([], []))
                if len(pts) >= 2:
                    wide, high = spans(pts)
                    if high < 1.0:
                        flat.append(pts)
                    elif wide < 1.0:
                        up.append(pts)
        elif kind in ("TEXT", "ATTRIB"):
            x, y, t = r.get("x"), r.get("y"), (r.get("text") or "").strip()
            if title is None and "端子排图" in t:
                title = t
            if x is not None and y is not None:
                if t:
                    words.append((x, y, t))
                if kind == "TEXT":
                    if t == "1":
                        ones.append((x, y))
                elif (own := tagged.get((r.get("tag") or "").upper())) is not None:
                    own.append((x, y, t))
    wide, ones = ByHeight(words, lambda w: w[0]), ByHeight(ones, lambda p: p[1])
    strips = ByHeight([w for w in words if STRIP_LIKE.match(w[2])], lambda w: w[1])
    tagged = {name: ByHeight(own, lambda w: w[1]) for name, own in tagged.items()}
    home = title and (title.replace("端子排图", "").strip() or title)
    out = []
    for cable, (flat, up) in cables.items():
        if not flat:
            continue
        y = flat[0][0][1]
        side = max((w for w in tagged["EQUNAME"].band(y - 10, y + 10) if w[2]), key=lambda w: w[0], default=None)
        for pts in up:
            x, a, b = pts[0][0], pts[0][1], pts[-1][1]
            if abs(b - a) < least:
                continue
            corner, end = (a, b) if abs(a - y) < abs(b - y) else (b, a)
            number = next((int(t) for tx, _, t in tagged["NO"].band(y - 10, y + 10) if abs(tx - x) <= 5 and t.isdigit()), None)
            beyond = (lambda v: v >= end - 0.1) if end > corner else (lambda v: v <= end + 0.1)  # noqa: B023
            column = sorted((w for w in wide.band(x - 4, x + 4) if abs(w[0] - x) <= 3 and beyond(w[1]) and abs(w[1] - end) >= 0.1), key=lambda w: abs(w[1] - end))  # noqa: B023
            roles = column_roles([w[2] for w in column])
            terminal = int(roles["terminal_no"]) if roles["terminal_no"] else None
            at = next((w for w in column if w[2] == str(terminal)), None)
            out.append(
                {
                    "cable_id": cable, "conductor_no": number, "strip_name": strip_name(at[0], at[1], ones, strips) if at else None, "terminal_no": terminal, "terminal_no_remote": None,
                    "cabinet_name": home, "cabinet_name_remote": side and side[2], "circuit_desc": roles["circuit_desc"], "loop_id": roles["loop_id"], "source_type": "terminal_strip",
                }
            )
    return out


# --- the geometry graph -------------------------------------------------------------------------------------
class Grid:
    """Numbered points in square cells."""

    def __init__(self, size: float):
        self.size, self.cells, self.off = size, {}, 0.4 * size  # drawings are drawn on round places: cells end beside them

    def add(self, n: int, x: float, y: float) -> None:
        size, off = self.size, self.off
        self.cells.setdefault((floor((x + off) / size), floor((y + off) / size)), []).append((n, x, y))

    def within(self, x: float, y: float, radius: float) -> list[tuple[float, int]]:
        """(distance, number) of points within a radius, by number."""
        size, off, far, found, held = self.size, self.off, radius + 1e-6, [], self.cells.get
        low, high = floor((y - far + off) / size), floor((y + far + off) / size)
        left, right = floor((x - far + off) / size), floor((x + far + off) / size)
        for i in (left,) if left == right else range(left, right + 1):
            for j in (low,) if low == high else range(low, high + 1):
                for n, px, py in held((i, j), ()):
                    d = hypot(px - x, py - y)
                    if d <= radius:
                        found.append((d, n))
        if len(found) > 1:
            found.sort(key=lambda f: f[1])
        return found


class Graph:
    """Wire vertices and circles of a drawing, with numbered segments between them; close vertices stay apart beyond ``snap``."""

    def __init__(self, rows: list[dict], boxes: list[Box] | None = None, handles: frozenset[str] = frozenset(), snap: float = 0.5):
        self.at: list[Point] = []
        self.near: list[list[tuple[int, int]]] = []
        self.circles: set[int] = set()
        self.edges: dict[int, tuple[int, int]] = {}
        self.next_edge = 0
        # Around round places a look-up of the distances asked for stays in one cell of these sizes.
        wires, rings, corners = Grid(2.0), Grid(25.0), Grid(10.0)
        borders = [(y, b[0], b[0] + b[2]) for b in boxes or [] for y in (b[1], b[1] + b[3])]
        for n, (y, x0, _) in enumerate(borders):
            corners.add(n, x0, y)

        def on_border(level: float, left: float, right: float) -> bool:
            near = [borders[n] for _, n in corners.within(left, level, 2.1)]
            return bool(near) and any(abs(level - y) <= 0.5 and abs(left - x0) <= 2 and abs(right - x1) <= 2 for y, x0, x1 in near)

        def vertex(x: float, y: float) -> int:
            met = wires.within(x, y, snap)
            if met:
                return met[0][1]
            n = self.add(x, y)
            wires.add(n, x, y)
            return n

        for r in rows:
            kind = r["kind"]
            pts = points_of(r) if kind == "LINE" else None
            if pts and not ((handle := r.get("handle")) and handle in handles):
                for a, b in zip(pts, pts[1:], strict=False):
                    dx, dy = abs(a[0] - b[0]), abs(a[1] - b[1])
                    if not ((dy <= 3 and dx > 2) or (dx <= 3 and dy > 2)):
                        continue
                    level = a[1] if dy <= 3 else (a[1] + b[1]) / 2
                    if borders and on_border(level, min(a[0], b[0]), max(a[0], b[0])):
                        continue
                    i, j = vertex(*a), vertex(*b)
                    if i != j:
                        self.link(i, j)
            elif kind == "CIRCLE" and r.get("cx") is not None:
                n = self.add(r["cx"], r["cy"])
                self.circles.add(n)
                rings.add(n, r["cx"], r["cy"])
        self.rings = rings
        for n in range(len(self.at)) if self.circles else ():
            if n not in self.circles and self.near[n]:
                for _, c in rings.within(*self.at[n], 2.0):
                    if all(m != c for m, _ in self.near[n]):
                        self.link(n, c)
        self._split_at_circles()
        spread = []
        for _, (a, b) in sorted(self.edges.items()):
            (ax, ay), (bx, by) = self.at[a], self.at[b]
            spread.append(((ay + by) / 2, min(ax, bx), max(ax, bx), a, b))
        self.levels, self.wired, self.parts = ByHeight(spread, lambda s: s[0]), None, None

    def add(self, x: float, y: float) -> int:
        self.at.append((x, y))
        self.near.append([])
        return len(self.at) - 1

    def link(self, a: int, b: int) -> int:
        e = self.next_edge
        self.next_edge += 1
        self.edges[e] = (a, b)
        self.near[a].append((b, e))
        self.near[b].append((a, e))
        return e

    def _split_at_circles(self, tol: float = 2.0) -> None:
        """A circle that no wire ends at takes part in the segments that pass within ``tol`` of it: they get a vertex there."""
        size = 25.0
        cells: dict[tuple[int, int], list[int]] = {}

        def file(e: int) -> None:
            (ax, ay), (bx, by) = (self.at[n] for n in self.edges[e])
            for i in range(math.floor((min(ax, bx) - tol) / size), math.floor((max(ax, bx) + tol) / size) + 1):
                for j in range(math.floor((min(ay, by) - tol) / size), math.floor((max(ay, by) + tol) / size) + 1):
                    cells.setdefault((i, j), []).append(e)

        lone = [c for c in sorted(self.circles) if not self.near[c]]
        if lone:
            for e in self.edges:
                file(e)
        for c in lone:
            x, y = self.at[c]
            for e in sorted(set(cells.get((math.floor(x / size), math.floor(y / size)), ()))):
                if e not in self.edges:
                    continue
                a, b = self.edges[e]
                (ax, ay), (bx, by) = self.at[a], self.at[b]
                long = (bx - ax) ** 2 + (by - ay) ** 2
                t = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long if long >= 1e-12 else -1
                px, py = ax + t * (bx - ax), ay + t * (by - ay)
                if 0.01 <= t <= 0.99 and math.hypot(px - x, py - y) <= tol:
                    del self.edges[e]
                    for n in (a, b):
                        self.near[n] = [(m, k) for m, k in self.near[n] if k != e]
                    n = self.add(px, py)
                    for made in (self.link(a, n), self.link(n, b), self.link(n, c)):
                        file(made)

    def wire_near(self, x: float, y: float, tol: float = 30.0, tags: list[Point] | None = None) -> int | None:
        """An end of the segment with least dy + 0.1 * distance outside its x range, less 3 where a tag stands over it.

        The end is no circle if there is a choice, else the nearer one.  Without segments on that level, the nearest
        wired vertex within ``tol``.
        """
        ys, order, things = self.levels.ys, self.levels.order, self.levels.things
        middle, slack, best, first = bisect_left(ys, y), 3 if tags else 0, math.inf, -1
        for ks in (range(middle, bisect_right(ys, y + tol)), range(middle - 1, bisect_left(ys, y - tol) - 1, -1)):
            for k in ks:
                n = order[k]
                level, x0, x1, _, _ = things[n]
                off = abs(level - y)
                if off > tol or off - slack > best:
                    break  # levels go outward: none of the next costs less
                cost = off + 0.1 * max(x0 - x, x - x1, 0.0)
                for tx, ty in tags or ():
                    if x0 <= tx <= x1 and abs(ty - level) < 40:
                        cost -= 3
                        break
                if cost < best or (cost == best and n < first):
                    best, first = cost, n
        if first >= 0:
            _, _, _, a, b = things[first]
            if (a in self.circles) != (b in self.circles):
                return b if a in self.circles else a
            return a if math.dist(self.at[a], (x, y)) <= math.dist(self.at[b], (x, y)) else b
        if self.wired is None:
            self.wired = Grid(30.0)
            for n, (px, py) in enumerate(self.at):
                if self.near[n]:
                    self.wired.add(n, px, py)
        met = self.wired.within(x, y, tol)
        return min(met)[1] if met else None

    def _onward(self, n: int, sign: int, seen: set[int]) -> list[int]:
        return [m for m, _ in self.near[n] if m not in seen and sign * (self.at[m][0] - self.at[n][0]) > 0]

    def walk(self, start: int, sign: int, branch: bool = False) -> int:
        """Follow the wire to one side, up to a circle, its end or (unless ``branch``) a fork; at a fork the farthest way is taken."""
        n, seen = start, set()
        while n not in self.circles:
            seen.add(n)
            ways = self._onward(n, sign, seen)
            if not ways or (len(ways) > 1 and not branch):
                break
            n = max(ways, key=lambda m: sign * self.at[m][0])
        return n

    def reach(self, start: int, sign: int, numbered: Callable[[int], object], slop: float = 5.0, depth: int = 30) -> object:
        """What ``numbered`` gives for the first circle for which it gives anything, breadth first, never back by more than ``slop``."""
        seen, queue = {start}, deque([(start, self.at[start][0], 0)])
        while queue:
            n, far, d = queue.popleft()
            if n in self.circles and (got := numbered(n)):
                return got
            if d < depth:
                for m, _ in self.near[n]:
                    x = self.at[m][0]
                    if m not in seen and sign * (x - far) >= -slop:
                        seen.add(m)
                        queue.append((m, min(far, x) if sign < 0 else max(far, x), d + 1))
        return None

    def circles_joined(self, to: int) -> tuple[int, ...]:
        """The circles that wires join to a vertex, over any number of segments."""
        if self.parts is None:
            self.parts = {}
            for c in self.circles:
                if c not in self.parts:
                    part, seen = [c], {c}
                    for n in part:  # grows while it is walked
                        for m, _ in self.near[n]:
                            if m not in seen:
                                seen.add(m)
                                part.append(m)
                    self.parts.update(dict.fromkeys(part, tuple(n for n in part if n in self.circles)))
        return self.parts.get(to, ())

    def trace(self, start: int, stop, most: int = 20) -> tuple[list[int], float, str]:
        """Path to the first vertex that ``stop`` accepts: (vertices, length, reason)."""
        before: dict[int, int | None] = {start: None}
        queue, deep = deque([(start, 0)]), False
        while queue:
            n, d = queue.popleft()
            if n != start and stop(n):
                path = [n]
                while (p := before[path[-1]]) is not None:
                    path.append(p)
                path.reverse()
                return path, sum(math.dist(self.at[a], self.at[b]) for a, b in zip(path, path[1:], strict=False)), "VISITOR_STOP"
            if d >= most:
                deep = True
                continue
            for m, _ in self.near[n]:
                if m not in before:
                    before[m] = n
                    queue.append((m, d + 1))
        return [], 0.0, "MAX_DEPTH" if deep else "DEAD_END" if self.near[start] else "NO_PATH"


# --- cabinets -----------------------------------------------------------------------------------------------
def dashed_regions(rows: list[dict], least: float = 8.0) -> list[dict]:
    """Closed dashed rectangles with their layer, handle and line type, by (x, y) rounded to hundredths."""
    dashed = [(r, points_of(r)) for r in rows if r["kind"] == "LINE" and (named := r.get("ltype")) and named.upper() in DASHED]
    found = []
    for r, pts in dashed:
        box = corner_box(pts, least) if 4 <= len(pts) <= 8 else None
        if box and (r.get("closed") or len(pts) == 4 or max(abs(pts[0][0] - pts[-1][0]), abs(pts[0][1] - pts[-1][1])) < 3.0):
            found.append({"box": box, "layer": r.get("layer") or "", "handle": r.get("handle") or "", "ltype": r["ltype"]})
    single = [(r, pts) for r, pts in dashed if len(pts) == 2]
    for box, k in four_segment_boxes([tuple(pts) for _, pts in single], least, loops=False) if len(single) >= 4 else ():
        found.append({"box": box, "layer": single[k][0].get("layer") or "", "handle": "", "ltype": single[k][0]["ltype"]})
    return sorted(found, key=lambda f: (round(f["box"][0], 2), round(f["box"][1], 2)))


def _named(text: str) -> bool:
    return not text.isascii() and NAMED.search(text) is not None  # none of the words is ASCII


def _lowest(texts: Iterable[tuple[float, float, int]]) -> int | None:
    """Of (height, distance from the middle, number) of texts in file order the lowest, of those within 3 of the one held the nearest."""
    pick, high, off = None, math.inf, math.inf
    for dy, dx, k in texts:
        if dy < high - 3 or (abs(dy - high) <= 3 and dx < off):
            high, off, pick = dy, dx, k
    return pick


class RegionWords:
    """Texts of a drawing, numbered in file order, as its regions ask for them; each is held against the patterns once."""

    def __init__(self, words: list[Word]):
        self.words, self.by_row, pairs = words, {}, list(enumerate(words))
        for p in pairs:
            self.by_row.setdefault(round(p[1][1] * 2), []).append(p)
        named, short = [p for p in pairs if _named(p[1][2])], [p for p in pairs if SHORT.match(p[1][2])]
        self.named, self.short = (ByHeight(own, lambda p: p[1][1]) for own in (named, short))
        self.places: np.ndarray | None = None

    def lowest_short(self, top: float, middle: float, low: float, high: float) -> int | None:
        """The short code that names a region, from ``low`` to ``high`` in x; of many only those that are picked are walked."""
        a, b = bisect_left(self.short.ys, top), bisect_right(self.short.ys, top + 61)
        if b - a <= MANY:
            near = [p for p in self.short.band(top, top + 61) if low <= p[1][0] <= high and 0 < p[1][1] - top <= 60]
            return _lowest((abs(w[1] - top), abs(w[0] - middle), k) for k, w in near)
        if self.places is None:
            self.places = np.array([(w[0], w[1], k) for k, w in self.short.things], float)[self.short.order].T
        x, y, k = self.places[:, a:b]
        own = (low <= x) & (x <= high) & (0 < y - top) & (y - top <= 60)
        x, y, k = x[own], y[own], k[own]
        order = np.argsort(k)
        dy, dx, k = np.abs(y - top)[order], np.abs(x - middle)[order], k[order]
        pick, lowest, off, at, size = None, math.inf, math.inf, 0, MANY
        while at < len(k):
            there = slice(at, at + size)
            hits = np.flatnonzero((dy[there] < lowest - 3) | ((np.abs(dy[there] - lowest) <= 3) & (dx[there] < off)))
            if len(hits):
                at += int(hits[0])
                lowest, off, pick, at, size = dy[at], dx[at], int(k[at]), at + 1, MANY
            else:
                at, size = at + size, 2 * size
        return pick


def region_texts(box: Box, words: RegionWords) -> dict[str, str]:
    """Name, location and label of a region.

    The name is a text up to 60 above with a cabinet word, else a short code: the lowest, or of texts within 3 units
    in height of the one held the nearest to the middle, in file order.  The location is the nearest text left of the
    name on its row; the label the nearest text below with a cabinet word, which also names regions without such a word.
    """
    top, middle = box[1] + box[3], box[0] + box[2] / 2
    low, high, base = box[0] - 50, box[0] + box[2] + 80, box[1]
    named = [p for p in words.named.band(base - 241, top + 61) if low <= p[1][0] <= high]
    pick = _lowest((abs(w[1] - top), abs(w[0] - middle), k) for k, w in named if 0 < w[1] - top <= 60)
    if pick is None:
        pick = words.lowest_short(top, middle, low, high)
    name = location = ""
    if pick is not None:
        x, y, name = words.words[pick]
        row = round(y * 2)
        beside = words.by_row.get(row) or words.by_row.get(row + 1) or words.by_row.get(row - 1) or []
        left = [(x - v[0], v[2]) for j, v in beside if j != pick and v[0] < x and abs(v[1] - y) <= 3 and x - v[0] <= 250]
        location = min(left, key=lambda v: v[0])[1] if left else ""
    below = [(base - w[1], w[2]) for _, w in named if 0 < base - w[1] <= 240 and 3 <= len(w[2]) <= 30]
    label = min(below, key=lambda v: v[0])[1] if below else ""
    if label and not _named(name):
        name, label = label, "" if name else label
    return {"name": name, "location": location, "display_name": f"{location}-{name}" if location and name else name, "text_label": label}


def cabinet_regions(rows: list[dict]) -> list[dict]:
    """Cabinets of a circuit drawing: dashed rectangles with their texts, numbered by place."""
    words = RegionWords(words_of(rows))
    key = (rows[0].get("document_hash") or "")[:12] if rows else ""
    out = []
    for k, f in enumerate(dashed_regions(rows)):
        b = f["box"]
        out.append({"id": f"cab_{key or 'doc'}_{k + 1:03d}", **region_texts(b, words), "x": b[0], "y": b[1], "w": b[2], "h": b[3], "layer": f["layer"], "handle": f["handle"], "ltype": f["ltype"]})
    return out


def _box(c: dict) -> Box:
    return c["x"], c["y"], c["w"], c["h"]


class Cabinets:
    """Cabinets of a drawing, found by their place."""

    def __init__(self, cabinets: list[dict]):
        self.held = [(c["x"], c["x"] + c["w"], c["y"], c["y"] + c["h"], c) for c in cabinets]

    def at(self, x: float, y: float) -> dict | None:
        """The first cabinet around a point, those whose centre is not far off before others."""
        held = [c for x0, x1, y0, y1, c in self.held if y0 <= y <= y1 and x0 <= x <= x1]
        if len(held) < 2:
            return held[0] if held else None
        cell = lambda v: floor(v / 50)
        close = [c for c in held if abs(cell(c["x"] + c["w"] / 2) - cell(x)) <= 2 and abs(cell(c["y"] + c["h"] / 2) - cell(y)) <= 2]
        return (close or held)[0]


def cabinet_at(cabinets: list[dict], x: float, y: float) -> dict | None:
    return Cabinets(cabinets).at(x, y)


class CabinetNames:
    """Texts with 屏, 柜 or 箱, and the texts beside them."""

    def __init__(self, words: list[Word]):
        self.named, self.tall = [w for w in words if "屏" in w[2] or "柜" in w[2] or "箱" in w[2]], ByHeight([w for w in words if w[2]], lambda w: w[1])

    def find(self, x: float, y: float) -> str | None:
        """The least (dx, dy) of these texts above, joined to the nearest other text left of it on its row."""
        best = min((w for w in self.named if w[1] > y), key=lambda w: (abs(w[0] - x), w[1] - y), default=None)
        if best is None:
            return None
        left = min((w for w in self.tall.band(best[1] - 4, best[1] + 4) if w[2] != best[2] and abs(w[1] - best[1]) < 3 and 0 < best[0] - w[0] < 200), key=lambda w: best[0] - w[0], default=None)
        return f"{left[2]}-{best[2]}" if left else best[2]


def find_cabinet(x: float, y: float, words: list[Word]) -> str | None:
    return CabinetNames(words).find(x, y)


def wire_types(codes: list[Word], types: list[Word]) -> dict[str, str | None]:
    """Nearest type of each code by Manhattan distance under 100; later codes of one value overwrite."""
    out: dict[str, str | None] = {}
    tall = ByHeight(types, lambda w: w[1])
    for x, y, code in codes:
        best = min(tall.band(y - 101, y + 101), key=lambda w: abs(w[0] - x) + abs(w[1] - y), default=None)
        out[code] = best[2] if best and abs(best[0] - x) + abs(best[1] - y) < 100 else None
    return out


def loop_records(rows: list[dict], cabinets: list[dict] | None = None) -> list[dict]:
    """Cores of a circuit loop: each wire serial's wire, its terminals on both sides and the nearest descriptions."""
    cabinets = cabinet_regions(rows) if cabinets is None else cabinets
    graph = Graph(rows, [_box(c) for c in cabinets], frozenset(c["handle"] for c in cabinets if c["handle"]))
    words: list[Word] = []
    names: list[Word] = []
    tagged: dict[str, list[Word]] = {}
    for r, t in written(rows, sure=0.5):
        w = (r["x"], r["y"], t)
        words.append(w)
        if r["kind"] == "ATTRIB" and (tag := r.get("tag")):
            tagged.setdefault(tag, []).append(w)
            if tag in NAME_TAGS and ":" in t:
                names.append(w)
    cabinet_names, tagged_tall = CabinetNames(words), {tag: ByHeight(tagged.get(tag, []), lambda w: w[1]) for tag in ("WireDescription", "LoopCode")}
    terminals = Grid(50.0)
    for k, (x, y, _) in enumerate(names):
        terminals.add(k, x, y)
    cores: dict[str, dict[int, Point]] = {}
    for x, y, t in tagged.get("WireSerial", []):
        m = SERIAL.match(t)
        if m:
            cores.setdefault(m[1], {}).setdefault(int(m[2]), (x, y))
    types, around = wire_types(tagged.get("WIRECODE", []), tagged.get("WIRETYPE", [])), Cabinets(cabinets)
    kinds, first_code = ByHeight(tagged.get("WIRETYPE", []), lambda w: w[1]), {}
    for w in tagged.get("WIRECODE", []):
        first_code.setdefault(w[2], w)

    @cache
    def resolve(n: int) -> tuple[str, float, float, str]:
        """(terminal, x, y, cabinet) at a vertex: at its nearest circle within 8, the name within 12 in the same cabinet."""
        x, y = graph.at[n]
        ring = None if n in graph.circles else min(graph.rings.within(x, y, 8.0), default=None)
        if ring:
            x, y = graph.at[ring[1]]
        home = around.at(x, y)
        box = home and _box(home)
        met = min((p for p in terminals.within(x, y, 12.0) if box is None or holds(box, *names[p[1]][:2])), default=None)
        where = home["display_name"] if home else ""
        return (names[met[1]][2], names[met[1]][0], names[met[1]][1], where) if met else ("", x, y, where)

    def context(cable: str) -> list[Point]:
        code = first_code.get(cable)
        kind = code and next((w for w in kinds.band(code[1] - 51, code[1] + 51) if abs(w[0] - code[0]) < 50 and abs(w[1] - code[1]) < 50), None)
        return [w[:2] for w in (code, kind) if w]

    def numbered(n: int) -> tuple[str, float, float, str] | None:
        found = resolve(n)
        return found if found[0] else None

    @cache
    def any_numbered(first: int) -> bool:
        return any(map(numbered, graph.circles_joined(first)))

    def terminal(start: int | None, sign: int) -> tuple[str, float, float, str] | None:
        if start is None:
            return None
        end = graph.walk(start, sign)
        if end not in graph.circles and (joined := graph.circles_joined(end)) and any_numbered(joined[0]):
            got = graph.reach(end, sign, numbered)
            if got:
                return got
        return resolve(end)

    def nearest(tag: str, x: float, y: float) -> str | None:
        near = tagged_tall[tag].band(y - 81, y + 81)
        best = min((w for w in near if abs(w[1] - y) <= 80), key=lambda w: (abs(w[1] - y), abs(w[0] - x)), default=None)
        return best and best[2]

    out = []
    for cable in sorted(cores):
        tags, here, there = context(cable), None, None
        for core, (x, y) in sorted(cores[cable].items(), key=lambda c: -c[1][1]):
            start = graph.wire_near(x, y, tags=tags)
            left, right = terminal(start, -1), terminal(start, 1)
            if left and right and left[0] and left[0] == right[0] and left[3] == right[3]:
                right = None  # a short stub: both sides are one terminal
            if left and here is None:
                here = left[3] or cabinet_names.find(left[1], left[2])
            if right and there is None:
                there = right[3] or cabinet_names.find(right[1], right[2])
            strip, colon, no = (left[0] if left else "").partition(":")
            number = WHOLE.fullmatch(no)
            out.append(
                {
                    "cable_id": cable, "conductor_no": core, "strip_name": strip.strip() if colon else None, "terminal_no": int(no) if number else None, "terminal_no_remote": right[0] if right else None,
                    "cabinet_name": here, "cabinet_name_remote": there, "circuit_desc": nearest("WireDescription", x, y), "loop_id": nearest("LoopCode", x, y), "source_type": "circuit_loop", "wire_type": types.get(cable),
                }
            )
    return out


def cabinet_terminals(rows: list[dict], cabinets: list[dict], records: list[dict]) -> list[dict]:
    """Terminals inside cabinets, small cabinets first, one row for each (cabinet, terminal, kind): the last place wins.

    Named terminals count only if a cable's record uses them; icons always do, by their place if they have no text.
    """
    used = {f"{r['strip_name']}:{r['terminal_no']}" for r in records if r.get("strip_name") and r.get("terminal_no")}
    used |= {r["terminal_no_remote"] for r in records if ":" in (r.get("terminal_no_remote") or "")}
    out: dict[tuple, dict] = {}
    ordered = sorted(cabinets, key=lambda c: c["w"] * c["h"])
    for r, t in written(rows, ("ATTRIB",)):
        kind = r.get("tag") or ""
        if kind in ICON_TAGS:
            t = t or f"ICON_{kind}@{r['x']:.0f}_{r['y']:.0f}"
        elif kind not in NAME_TAGS or ":" not in t or t not in used:
            continue
        for c in ordered:
            if holds(_box(c), r["x"], r["y"]):
                out[c["id"], t, kind] = {"cabinet_id": c["id"], "terminal_id": t, "kind": kind, "x": r["x"], "y": r["y"]}
    return list(out.values())


# --- grouped runs -------------------------------------------------------------------------------------------
#: The analyzer of each class that has one.
ANALYZERS: dict[str, Callable[[list[dict]], list[dict]]] = {"circuit_loop": loop_records, "terminal_strip": strip_records, "cable_schedule": schedule_records}


def of_class(entities: DataFrame, classes: DataFrame | None, name: str) -> DataFrame:
    """The entities of the documents of one class (of all documents without a table of classes: document_hash, classification)."""
    if classes is None:
        return entities
    return entities.join(classes.filter(F.col("classification") == name).select("document_hash").distinct(), "document_hash", "left_semi")


STRIP_READS = ("kind", "x", "y", "text", "tag", "points", "eed")
REGION_READS = ("kind", "x", "y", "text", "tag", "points", "closed", "ltype", "layer", "handle")
LOOP_READS = (*REGION_READS, "cx", "cy", "confidence")
#: What each analyzer reads of an entity.
READS = {"circuit_loop": LOOP_READS, "terminal_strip": STRIP_READS, "cable_schedule": ("kind", "x", "y", "text")}


def analyzed(run: Callable[[list[dict]], list[dict]], rows: list[dict]) -> list[dict]:
    """An analyzer's records; its error is a record, beside those of other analyzers."""
    try:
        return run(rows)
    except Exception as error:
        return [{"error": f"{type(error).__name__}: {error}"}]


def scan_topology(entities: DataFrame | list[Packed], classes: DataFrame | None = None) -> DataFrame:
    """Topology records, each document by its class's analyzer; without classes, by all of them but the schedule's.

    Entities are read once: each carries the analyzers of its document.  Packed tables of different documents, dealt
    by document, meet their classes where they are.
    """
    names = list(ANALYZERS) if classes is not None else [n for n in ANALYZERS if n != "cable_schedule"]
    own, reads = entities, tuple(dict.fromkeys(c for n in names for c in READS[n]))
    per = None if classes is None else classes.filter(F.col("classification").isin(names)).groupBy("document_hash").agg(F.array_join(F.collect_set("classification"), ",").alias("_classes"))
    if not isinstance(entities, DataFrame):
        told = ("_classes",) if classes is not None else ()
        narrow = [p.reading(reads) for p in entities]
        own = together({str(k): p._replace(rows=p.rows.join(per.hint("shuffle_hash"), "document_hash") if told else p.rows, told=told) for k, p in enumerate(narrow)})
    elif classes is not None:
        own, reads = entities.join(per.hint("shuffle_hash"), "document_hash"), (*reads, "_classes")

    def run(rows: list[dict]) -> list[dict]:
        asked = rows[0]["_classes"].split(",") if "_classes" in rows[0] else names
        return [r for n in names if n in asked for r in analyzed(ANALYZERS[n], rows)]

    return per_document(own, run, RECORD, reads)


def scan_cabinet_regions(entities: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    return per_document(of_class(entities, classes, "circuit_loop"), cabinet_regions, REGION, REGION_READS)


def scan_cabinet_terminals(entities: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Terminals of cabinets of circuit loops that cables use, and icons."""

    def run(rows: list[dict]) -> list[dict]:
        regions = cabinet_regions(rows)
        return cabinet_terminals(rows, regions, loop_records(rows, regions))

    return per_document(of_class(entities, classes, "circuit_loop"), run, TERMINAL, LOOP_READS)


def cable_info(records: DataFrame) -> DataFrame:
    """One wire type for each cable of each document."""
    return records.filter("wire_type IS NOT NULL AND wire_type <> ''").groupBy("cable_id", "document_hash").agg(F.first("wire_type").alias("wire_type"))
