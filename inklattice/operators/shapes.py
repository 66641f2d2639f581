"""Boxes, lines, rectangles and texts of one document's rows (dicts in file order).  Boxes are (x, y, w, h)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

Box = tuple[float, float, float, float]
Point = tuple[float, float]
Word = tuple[float, float, str]


class Points(list):
    """A line's points as pairs, not rows."""


# --- boxes --------------------------------------------------------------------------------------------------
def overlap(a: Box, b: Box) -> float:
    """Intersection over the smaller area."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    small = min(a[2] * a[3], b[2] * b[3])
    return w * h / small if w > 0 and h > 0 and small > 0 else 0.0


def contains(outer: Box, inner: Box) -> bool:
    return outer[0] <= inner[0] and outer[1] <= inner[1] and outer[0] + outer[2] >= inner[0] + inner[2] and outer[1] + outer[3] >= inner[1] + inner[3]


def centre(b: Box) -> Point:
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def holds(b: Box, x: float, y: float, pad: float = 0.0) -> bool:
    return b[0] - pad <= x <= b[0] + b[2] + pad and b[1] - pad <= y <= b[1] + b[3] + pad


def holds_centre(outer: Box, inner: Box, pad: float = 5.0) -> bool:
    return holds(outer, *centre(inner), pad)


def same_box(a: Box, b: Box, tol: float = 1.0) -> bool:
    return all(abs(p - q) < tol for p, q in zip(a, b, strict=True))


def union_box(boxes: list[Box]) -> Box:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


# --- lines and rectangles -----------------------------------------------------------------------------------
def points_of(row: dict) -> list[Point]:
    points = row.get("points") if row["kind"] == "LINE" else None
    return points if type(points) is Points else [(p["x"], p["y"]) for p in points or []]


def spans(points: list[Point]) -> Point:
    if len(points) == 2:  # as max and min, without walking
        (ax, ay), (bx, by) = points
        return (bx if bx > ax else ax) - (bx if bx < ax else ax), (by if by > ay else ay) - (by if by < ay else ay)
    return max(p[0] for p in points) - min(p[0] for p in points), max(p[1] for p in points) - min(p[1] for p in points)


def extents(rows: list[dict]) -> Box:
    """Around all lines, circles and arcs; (0, 0, 1, 1) without any."""
    xs, ys = [], []
    for r in rows:
        if r["kind"] == "LINE":
            for x, y in points_of(r):
                xs.append(x)
                ys.append(y)
        elif r["kind"] in ("CIRCLE", "ARC") and r.get("cx") is not None:
            radius = r.get("radius") or 0.0
            xs += [r["cx"] - radius, r["cx"] + radius]
            ys += [r["cy"] - radius, r["cy"] + radius]
    return (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)) if xs else (0.0, 0.0, 1.0, 1.0)


def corner_box(points: list[Point], least: float) -> Box | None:
    """The bounding box if every point lies at one of its corners, within 3 units or 6 % of the longer side."""
    if len(points) < 4:
        return None
    w, h = spans(points)
    x, y = min(p[0] for p in points), min(p[1] for p in points)
    tol = min(3.0, 0.06 * max(w, h))
    at_corner = all(min(px - x, x + w - px) <= tol and min(py - y, y + h - py) <= tol for px, py in points)
    return (x, y, w, h) if w >= least and h >= least and at_corner else None


def four_segment_boxes(segments: list[tuple[Point, Point]], least: float, loops: bool) -> Iterator[tuple[Box, int]]:
    """Boxes of cycles of four segments whose first one's ends join two segments each, with that segment's number.

    Corners are the first segment's start and every segment's end, in the cycle's order, without repeats in a row.
    A cycle drawn head to tail comes back to its start, as a fifth corner: it counts only with ``loops``.
    """
    key = lambda p: (round(p[0], 2), round(p[1], 2))
    ends = [(key(a), key(b)) for a, b in segments]
    at: dict[Point, list[int]] = {}
    for k, pair in enumerate(ends):
        for p in pair:
            at.setdefault(p, []).append(k)
    used: set[int] = set()
    for k, (a, b) in enumerate(ends):
        if k in used or len(at[a]) != 2 or len(at[b]) != 2:
            continue
        chain, here = [k], b
        while len(chain) < 4 and (nxt := next((j for j in at[here] if j not in chain), None)) is not None:
            chain.append(nxt)
            here = ends[nxt][1] if ends[nxt][0] == here else ends[nxt][0]
        if len(chain) < 4 or here != a:
            continue
        corners = [a]
        for j in chain:
            if ends[j][1] != corners[-1]:
                corners.append(ends[j][1])
        if len(corners) == 5 and loops:
            corners.pop()
        box = corner_box(corners, least) if len(corners) == 4 else None
        if box:
            used.update(chain)
            yield box, k


def rectangles(rows: list[dict]) -> list[tuple[Box, str]]:
    """Axis-aligned rectangles from polylines of four or five points, then from cycles of four segments; each once."""
    found: dict[Box, tuple[Box, str]] = {}

    def add(b: Box | None, kind: str) -> None:
        if b:
            found.setdefault(tuple(round(v, 1) for v in b), (b, kind))

    lines = [points_of(r) for r in rows]
    for pts in lines:
        if len(pts) == 4 or (len(pts) == 5 and max(abs(pts[0][0] - pts[4][0]), abs(pts[0][1] - pts[4][1])) <= 0.1):
            add(corner_box(pts[:4], 0.5), "polyline")
    for b, _ in four_segment_boxes([(p[0], p[1]) for p in lines if len(p) == 2], 0.5, loops=True):
        add(b, "4seg")
    return list(found.values())


def long_lines(rows: list[dict], least: float) -> tuple[list[tuple[float, float, float]], list[tuple[float, float, float]]]:
    """Vertical (x, y0, y1) and horizontal (y, x0, x1) two-point lines."""
    up, flat = [], []
    for r in rows:
        p = points_of(r)
        if len(p) == 2:
            (ax, ay), (bx, by) = p
            if abs(ax - bx) < 1:
                if abs(ay - by) >= least:
                    up.append((ax, min(ay, by), max(ay, by)))
            elif abs(ay - by) < 1 and abs(ax - bx) >= least:
                flat.append((ay, min(ax, bx), max(ax, bx)))
    return up, flat


# --- texts --------------------------------------------------------------------------------------------------
def written(rows: list[dict], kinds: tuple[str, ...] = ("TEXT", "ATTRIB"), sure: float | None = None) -> Iterator[tuple[dict, str]]:
    """Rows of texts that have a place, with their trimmed text (which may be empty)."""
    for r in rows:
        if r["kind"] in kinds:
            get = r.get
            if get("x") is not None and get("y") is not None and (sure is None or (given := get("confidence")) is None or given >= sure):
                yield r, (get("text") or "").strip()


def words_of(rows: list[dict], **how) -> list[Word]:
    """(x, y, text) of texts that are not empty."""
    return [(r["x"], r["y"], t) for r, t in written(rows, **how) if t]


def default_noise(text: str) -> bool:
    return text.startswith(("\\M+", "KKS"))


def collected(rows: list[dict], box: Box | None = None, longest: int = 50, noise: Callable[[str], bool] = default_noise) -> list[Word]:
    """Texts up to a length, in a closed box, that are no noise."""
    return [w for w in words_of(rows) if len(w[2]) <= longest and not noise(w[2]) and (box is None or holds(box, w[0], w[1]))]


def count_texts(rows: list[dict], box: Box) -> int:
    return sum(holds(box, w[0], w[1]) for w in words_of(rows))


def texts_near(words: list[Word], x: float, y: float, radius: float) -> list[Word]:
    """Texts within a radius, nearest first."""
    return sorted((w for w in words if math.hypot(w[0] - x, w[1] - y) <= radius), key=lambda w: math.hypot(w[0] - x, w[1] - y))


def find_text(rows: list[dict], part: str = "") -> list[dict]:
    """Rows of free texts (no attributes) that contain a string."""
    return [r for r in rows if r["kind"] == "TEXT" and part in (r.get("text") or "")]


def document_text(rows: list[dict]) -> str:
    return "\n".join(r.get("text") or "" for r in find_text(rows))
