"""Panel position plans of one document: the room around labels like 12F, equal cells, their rows and groups, and their usage."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from inklattice.operators.drawing import NODE_SCHEMA, Tree
from inklattice.operators.grouped import per_document
from inklattice.operators.shapes import Box, Word, centre, points_of, rectangles, union_box, words_of
from inklattice.operators.tables import material_rows, schedule_records, usage_rows

CELL_LABEL = r"\d+F"
CELL_SCHEMA = "document_hash string, label string, row int, grp int, col int, equipment string, qty int, remark string, x double, y double, w double, h double, error string"
RECORD_SCHEMA = "document_hash string, cable_id string, conductor_no int, strip_name string, terminal_no_remote string, cabinet_name string, circuit_desc string, loop_id string, source_type string, error string"
USAGE_SCHEMA = "document_hash string, cell_label string, equipment string, qty int, remark string, error string"
MATERIAL_SCHEMA = "document_hash string, index string, name string, unit string, qty int, remark string, error string"


def cell_labels(rows: list[dict]) -> list[Word]:
    return [w for w in words_of(rows) if re.fullmatch(CELL_LABEL, w[2])]


def densest(labels: list[Word], gap: float = 50.0) -> list[Word]:
    """Of more than ten labels the largest run in x without a gap, of equal ones the lowest in extent."""
    if len(labels) <= 10:
        return labels
    runs: list[list[Word]] = []
    for w in sorted(labels, key=lambda w: w[0]):
        if not runs or w[0] - runs[-1][-1][0] > gap:
            runs.append([])
        runs[-1].append(w)
    return max(runs, key=lambda run: (len(run), min(w[1] for w in run) - max(w[1] for w in run)))


def _half(v: float) -> float:
    return round(v * 2) / 2


def room(rows: list[dict], labels: list[Word] | None = None) -> Box | None:
    """The room's box from long lines around the labels; without labels, between the lowest and highest long horizontals."""
    labels = densest(cell_labels(rows) if labels is None else labels)
    flat, up = [], []
    for r in rows:
        p = points_of(r)
        if len(p) >= 2:
            (ax, ay), (bx, by) = p[0], p[-1]
            if abs(ay - by) < 2:
                if abs(ax - bx) >= 50:
                    flat.append((min(ax, bx), (ay + by) / 2, max(ax, bx), abs(ax - bx)))
            elif abs(ax - bx) < 2 and abs(ay - by) >= 50:
                up.append((min(ax, bx), abs(ay - by)))
    if not flat:
        return None
    levels: dict[float, list[tuple]] = {}
    for s in flat:
        levels.setdefault(_half(s[1]), []).append(s)
    longest = lambda own: max(own, key=lambda s: s[3])
    if not labels:
        ys = sorted(levels)
        if len(ys) < 2:
            return None
        low, high = longest(levels[ys[0]]), longest(levels[ys[-1]])
        return min(low[0], high[0]), ys[0], max(low[2], high[2]) - min(low[0], high[0]), ys[-1] - ys[0]
    x0, x1, y0, y1 = (f(w[axis] for w in labels) for axis in (0, 1) for f in (min, max))
    # Lines of one height count together: paired segments with a gap span the labels as one.
    wide = []
    for y, own in levels.items():
        a, b = min(s[0] for s in own), max(s[2] for s in own)
        if a <= x0 + 0.2 * (x1 - x0) and b >= x1 - 0.2 * (x1 - x0) and b - a >= 0.6 * (x1 - x0):
            best = longest(own)
            wide.append((best[0], y, best[2], best[3]))
    if len(wide) < 2:
        margin = max(0.3 * (y1 - y0), 20.0)
        wide += [s for s in flat if y0 - margin <= s[1] <= y1 + margin]
        if len(wide) < 2:
            return None
    by_y: dict[float, tuple] = {}
    for s in wide:
        key = _half(s[1])
        if key not in by_y or s[3] > by_y[key][3]:
            by_y[key] = s
    bottom, top = min(by_y), max(by_y)
    left, right = min(by_y[bottom][0], by_y[top][0]), max(by_y[bottom][2], by_y[top][2])
    reach = 0.2 * (right - left)
    walls = sorted(_half(x) for x, size in up if size >= 0.6 * (top - bottom) and left - reach <= x <= right + reach)
    if walls:
        left, right = min(left, walls[0]), max(right, walls[-1])
    return left, bottom, right - left, top - bottom


def cells(rows: list[dict], place: Box, labels: list[Word] | None = None) -> list[dict]:
    """Rectangles of the most common rounded size (within 3 units) whose centres lie in a room, with the nearest label, if any is near."""
    labels = cell_labels(rows) if labels is None else labels
    inside = [b for b, _ in rectangles(rows) if place[0] < centre(b)[0] < place[0] + place[2] and place[1] < centre(b)[1] < place[1] + place[3]]
    sizes = Counter((round(b[2]), round(b[3])) for b in inside)
    if not sizes:
        return []
    w, h = max(sizes, key=lambda s: sizes[s])
    own = [t for t in labels if place[0] <= t[0] <= place[0] + place[2]]
    out = []
    for b in inside:
        if abs(b[2] - w) <= 3 and abs(b[3] - h) <= 3:
            cx, cy = centre(b)
            far, name = min((((x - cx) ** 2 + (y - cy) ** 2, t) for x, y, t in own), key=lambda d: d[0], default=(float("inf"), ""))
            out.append({"label": name if far <= (0.8 * max(b[2], b[3])) ** 2 else "", "bbox": b, "equipment": "", "qty": 0, "remark": ""})
    return out


def cell_rows(found: list[dict]) -> list[list[dict]]:
    """Rows from above: a cell over 0.6 of the middle height off its row's first one starts the next; groups split at wide gaps."""
    if not found:
        return []
    tol = 0.6 * sorted(c["bbox"][3] for c in found)[len(found) // 2]
    rows: list[list[dict]] = []
    for c in sorted(found, key=lambda c: -centre(c["bbox"])[1]):
        if rows and abs(centre(c["bbox"])[1] - centre(rows[-1][0]["bbox"])[1]) <= tol:
            rows[-1].append(c)
        else:
            rows.append([c])
    for r, row in enumerate(rows):
        row.sort(key=lambda c: c["bbox"][0])
        gaps = [b["bbox"][0] - a["bbox"][0] for a, b in zip(row, row[1:], strict=False)]
        wide = 1.5 * sorted(gaps)[len(gaps) // 2] if gaps else 0.0
        group = column = 0
        for k, c in enumerate(row):
            if k and gaps[k - 1] > wide:
                group, column = group + 1, 0
            c |= {"row": r, "group": group, "col": column}
            column += 1
    return rows


def cross_reference(found: list[dict], usage: list[dict]) -> list[dict]:
    """Cells with the equipment, quantity and remark of their label; of equal labels the last counts."""
    by = {u["cell_label"]: u for u in usage if u["cell_label"]}
    return [{**c, **({k: by[c["label"]][k] for k in ("equipment", "qty", "remark")} if c.get("label") in by else {})} for c in found]


def position_cells(rows: list[dict]) -> tuple[Box | None, list[list[dict]]]:
    labels = cell_labels(rows)
    place = room(rows, labels)
    usage = usage_rows(rows) if place else []
    return place, [cross_reference(row, usage) for row in cell_rows(cells(rows, place, labels))] if place else []


def position_nodes(rows: list[dict]) -> list[dict]:
    """Flat nodes: the room, its rows, their cells."""
    place, lines = position_cells(rows)
    tree = Tree()
    if lines:
        root = tree.add(None, "ROOM", place)
        for k, line in enumerate(lines):
            row = tree.add(root, "POSITION_ROW", union_box([c["bbox"] for c in line]), row_index=k)
            for c in line:
                tree.add(row, "POSITION_CELL", c["bbox"], c["label"], equipment=c["equipment"], qty=c["qty"], remark=c["remark"], row_index=c["row"], col_index=c["col"], group_index=c["group"])
    return tree.nodes


# --- grouped runs -------------------------------------------------------------------------------------------
READS, TEXT_READS = ("kind", "x", "y", "text", "points"), ("kind", "x", "y", "text")


def scan_positions(entities: DataFrame) -> DataFrame:
    def run(rows: list[dict]) -> list[dict]:
        keys = ("label", "row", "col", "equipment", "qty", "remark")
        return [{**{k: c[k] for k in keys}, "grp": c["group"], **dict(zip("xywh", c["bbox"], strict=True))} for line in position_cells(rows)[1] for c in line]

    return per_document(entities, run, CELL_SCHEMA, READS)


def scan_position_nodes(entities: DataFrame) -> DataFrame:
    return per_document(entities, position_nodes, NODE_SCHEMA, READS)


def scan_schedules(entities: DataFrame) -> DataFrame:
    return per_document(entities, schedule_records, RECORD_SCHEMA, TEXT_READS)


def scan_usage(entities: DataFrame) -> DataFrame:
    return per_document(entities, usage_rows, USAGE_SCHEMA, TEXT_READS)


def scan_materials(entities: DataFrame) -> DataFrame:
    return per_document(entities, material_rows, MATERIAL_SCHEMA, TEXT_READS)
