"""Panel layouts of one document: cabinets, areas, device candidates, groups, their meaning, and the tree of all of them.

The functions take plain rows (dicts) of one document in file order; ties resolve to the first in that order.
"""

from __future__ import annotations

import math
from collections import Counter
from statistics import mean, stdev

from pyspark.sql import DataFrame

from inklattice.operators.grouped import per_document
from inklattice.operators.shapes import Box, Point, Word, centre, extents, holds, holds_centre, long_lines, overlap, points_of, rectangles, same_box, texts_near, union_box, words_of
from inklattice.operators.tables import cabinet_table, dbscan, match_devices

# Words in names of panel cabinets.
CABINET_WORDS = ("柜", "屏", "箱", "继电器", "控制", "保护")
# Name prefixes and what they say of a group, with weights.
NAME_EVIDENCE = [
    (("1d", "2d", "3d", "4d", "5d", "6d", "7d", "8d", "9d", "10d", "11d", "12d", "13d", "14d", "15d", "16d", "17d", "18d", "19d", "20d"), "TERMINAL_COLUMN", 0.40),
    (("dtz", "ddz", "dsz", "dssd"), "METER_GROUP", 0.30),
    (("dk", "zdk", "zdf", "gz", "xd"), "RELAY_GROUP", 0.30),
    (("fa", "fu"), "MODULE_GROUP", 0.20),
    (("m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8"), "METER_GRID", 0.30),
    (("dh1", "dh2", "dh3", "dh4", "dh5", "dh6"), "METER_GRID", 0.20),
]
# What a group's shape says.
SHAPE_EVIDENCE = {"VERTICAL_COLUMN": ("TERMINAL_COLUMN", 0.20), "HORIZONTAL_ROW": ("DEVICE_PANEL", 0.10), "GRID": ("METER_GRID", 0.20)}
# Table words and attribute categories.
TABLE_EVIDENCE = [("电表", "METER_GROUP", 0.25), ("电能表", "METER_GROUP", 0.25), ("继电器", "RELAY_GROUP", 0.25), ("端子", "TERMINAL_COLUMN", 0.25), ("开关", "DEVICE_PANEL", 0.20)]
MODEL_EVIDENCE = [("dtz", "METER_GROUP", 0.15), ("dk", "RELAY_GROUP", 0.15)]
ATTRIBUTE_EVIDENCE = {"TERMINAL": "TERMINAL_COLUMN", "METER": "METER_GROUP", "RELAY": "RELAY_GROUP"}
# Categories of blocks and of name prefixes.
BLOCK_CATEGORIES = {
    "METER_BLOCK": "METER", "DTZ178_SYMBOL": "METER", "RELAY_SYMBOL": "RELAY", "TERMINAL_SYMBOL": "TERMINAL",
    "SWITCH_SYMBOL": "SWITCH", "MODULE_SYMBOL": "MODULE", "FUSE_BLOCK": "MODULE", "CABLE_MARKER": "TERMINAL",
}
NAME_CATEGORIES = [
    (("dtz", "ddz", "dsz", "dssd"), "METER"), (("wh", "varh", "vah"), "METER"), (("dk", "zdk", "zdf", "gz"), "RELAY"), (("xd", "xdt"), "RELAY"), (("lp", "zlp"), "TERMINAL"), (("qd", "zqd"), "SWITCH"),
    (("fa", "fu"), "MODULE"), (("zk", "zkz"), "SWITCH"), (("ya", "ha", "hw"), "SWITCH"), (("1d", "2d", "3d", "4d", "5d", "6d"), "TERMINAL"), (("m1", "m2", "m3", "m4", "m5"), "METER"),
]


# --- cabinets and areas -------------------------------------------------------------------------------------
def cabinet_name(words: list[Word], box: Box) -> str:
    """The text with a cabinet word nearest in height to the box's top, from 50 below the box to 10 above it."""
    near = [w for w in words if box[0] - 20 <= w[0] <= box[0] + box[2] + 20 and box[1] - 50 <= w[1] <= box[1] + box[3] + 10 and any(k in w[2] for k in CABINET_WORDS)]
    best = min(near, key=lambda w: abs(w[1] - box[1] - box[3]), default=None)
    return best[2] if best else ""


def cabinets(rows: list[dict], boxes: list[Box] | None = None) -> list[dict]:
    """Tall rectangles and pairs of long verticals, one of each group that overlaps.

    Groups gather around the largest box left (overlap over 0.3).  Of a group the widest rectangle stays, else the
    widest box with a name, else the widest.  Rectangles come first; a pair of verticals over half on one goes.
    """
    boxes = [b for b, _ in rectangles(rows)] if boxes is None else boxes
    words, whole = words_of(rows), extents(rows)
    found = [{"bbox": b, "rect": True} for b in boxes if b[2] >= 30 and b[3] >= 100 and 1.5 <= b[3] / b[2] <= 5.0 and 5000 <= b[2] * b[3] and not 0 < 0.9 * whole[2] * whole[3] <= b[2] * b[3]]
    up = sorted(long_lines(rows, 50.0)[0], key=lambda v: v[0])
    for k, a in enumerate(up):
        for b in up[k + 1 :]:
            low, high, w = max(a[1], b[1]), min(a[2], b[2]), b[0] - a[0]
            if w >= 100 and high - low >= 100 and (high - low) / w >= 1.5:
                found.append({"bbox": (a[0], low, w, high - low), "rect": False})
    for c in found:
        c["name"] = cabinet_name(words, c["bbox"])
    groups: list[list[dict]] = []
    for c in sorted(found, key=lambda c: -c["bbox"][2] * c["bbox"][3]):
        home = next((g for g in groups if overlap(c["bbox"], g[0]["bbox"]) > 0.3), None)
        if home is None:
            groups.append([c])
        else:
            home.append(c)
    best = [max([c for c in g if c["rect"]] or [c for c in g if c["name"]] or g, key=lambda c: c["bbox"][2]) for g in groups]
    rects = [c for c in best if c["rect"]]
    return rects + [c for c in best if not c["rect"] and all(overlap(c["bbox"], r["bbox"]) <= 0.5 for r in rects)]


def interior(cabinet: Box, boxes: list[Box]) -> tuple[list[Box], Box | None, list[Box]]:
    """Rectangles inside a cabinet: headers (wide and flat, from below), the largest device area, and others."""
    headers, area, others = [], None, []
    for b in boxes:
        if not holds_centre(cabinet, b):
            continue
        if b[2] >= 0.8 * cabinet[2] and b[3] <= 15:
            headers.append(b)
        elif b[2] >= 0.5 * cabinet[2] and b[3] >= 0.4 * cabinet[3]:
            if b[2] <= 1.1 * cabinet[2] and b[3] <= 1.1 * cabinet[3] and (area is None or b[2] * b[3] > area[2] * area[3]):
                area = b
        else:
            others.append(b)
    return sorted(headers, key=lambda b: b[1]), area, others


def area_name(words: list[Word], area: Box, cabinet: Box) -> str:
    """The highest text in the area's upper fifth."""
    top = area[1] + area[3]
    held = [w for w in words if cabinet[0] <= w[0] <= cabinet[0] + cabinet[2] and top - 0.2 * area[3] <= w[1] <= top]
    best = min(held, key=lambda w: top - w[1], default=None)
    return best[2] if best else ""


def areas(rows: list[dict], cabinet: Box, boxes: list[Box] | None = None, least: float = 30.0) -> list[tuple[Box, str, int]]:
    """(box, name, number) of a cabinet's areas: its device area unless that is the cabinet, else bands between dividers.

    A divider crosses half of the cabinet, or three tenths from one of its sides.  Numbers count bands that are too low, too.
    """
    words = words_of(rows)
    device_area = interior(cabinet, [b for b, _ in rectangles(rows)] if boxes is None else boxes)[1]
    if device_area is not None:
        return [] if same_box(device_area, cabinet) else [(device_area, area_name(words, device_area, cabinet), 0)]
    x, y, w, h = cabinet
    dividers = set()
    for at, x0, x1 in long_lines(rows, 50.0)[1]:
        part = min(x1, x + w) - max(x0, x)
        if y < at < y + h and (part >= 0.5 * w or ((abs(x0 - x) < 5 or abs(x1 - x - w) < 5) and part > 0.3 * w)):
            dividers.add(at)
    ys = sorted({y, y + h, *dividers}) if dividers else []
    bands = [((x, a, w, b - a), k) for k, (a, b) in enumerate(zip(ys, ys[1:], strict=False)) if b - a >= least]
    return [(band, area_name(words, band, cabinet), k) for band, k in bands]


# --- device candidates --------------------------------------------------------------------------------------
def _candidate(box: Box, score: float, source: str, texts: list[str] | None = None) -> dict:
    return {"bbox": box, "score": score, "source": source, "texts": texts or [], "name": "", "description": []}


def _around(points: list[Point]) -> Box:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def _turn(corner: Point, p: Point, q: Point) -> float:
    u, v = (p[0] - corner[0], p[1] - corner[1]), (q[0] - corner[0], q[1] - corner[1])
    long = math.hypot(*u) * math.hypot(*v)
    return math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / long)))) if long else 0.0


def open_shapes(rows: list[dict], container: Box, tol: float = 2.0) -> list[tuple[Box, float, str]]:
    """U shapes (three chained segments whose outer ones are upright or level, 0.7), then L shapes (0.5), in file order."""
    x, y, w, h = container[0] - 5, container[1] - 5, container[2] + 10, container[3] + 10
    segments = [p for r in rows if len(p := points_of(r)) == 2 and all(holds((x, y, w, h), *q) for q in p)]
    key = lambda p: (round(p[0], 1), round(p[1], 1))
    at: dict[Point, list[int]] = {}
    for k, p in enumerate(segments):
        for q in p:
            at.setdefault(key(q), []).append(k)
    used: set[int] = set()
    out: list[tuple[Box, float, str]] = []
    straight = lambda p: abs(p[0][0] - p[1][0]) < 1 or abs(p[0][1] - p[1][1]) < 1
    for k in range(len(segments)):
        chain = [k] if k not in used else []
        while 0 < len(chain) < 3 and (nxt := next((j for q in segments[chain[-1]] for j in at[key(q)] if j not in chain), None)) is not None:
            chain.append(nxt)
        if len(chain) == 3 and straight(segments[chain[0]]) and straight(segments[chain[2]]):
            b = _around([*segments[chain[0]], segments[chain[1]][1], segments[chain[2]][1]])
            if b[2] >= 3 and b[3] >= 3:
                used.update(chain)
                out.append((b, 0.7, "U_shape"))
    for k, p in enumerate(segments):
        for j in range(k + 1, len(segments)) if k not in used else ():
            q = segments[j]
            met = None if j in used else next(((m, n) for m in (0, 1) for n in (0, 1) if abs(p[m][0] - q[n][0]) <= tol and abs(p[m][1] - q[n][1]) <= tol), None)
            if met and 85 <= _turn(p[met[0]], p[1 - met[0]], q[1 - met[1]]) <= 95:
                b = _around([p[met[0]], p[1 - met[0]], q[1 - met[1]]])
                if b[2] >= 3 and b[3] >= 3:
                    used |= {k, j}
                    out.append((b, 0.5, "L_shape"))
                break
    return out


def spine_devices(rows: list[dict], container: Box, words: list[Word]) -> list[dict]:
    """Boxes with texts between neighbouring short horizontals of one span that hang on a long vertical (0.75).

    Their far side is closed by a vertical or lies at the container's edge.
    """
    x, y, w, h = container
    up, flat = long_lines(rows, 3.0)
    short = [s for s in flat if y - 3 <= s[0] <= y + h + 3 and s[1] >= x - 5 and s[2] <= x + w + 5 and (s[2] - s[1] < 50 or abs(s[2] - x - w) <= 3 or abs(s[1] - x) <= 3)]
    steps: dict[Point, set[float]] = {}
    for at, x0, x1 in short:
        steps.setdefault((round(x0), round(x1)), set()).add(at)
    out = []
    for sx, s0, s1 in up:
        if s1 - s0 < 100 or not x - 2 <= sx <= x + w + 2:
            continue
        for (x0, x1), levels in steps.items():
            if (abs(x0 - sx) > 2 and abs(x1 - sx) > 2) or x1 - x0 < 2:
                continue
            far = x1 if abs(x0 - sx) <= 2 else x0
            ys = sorted(levels, reverse=True)
            for top, low in zip(ys, ys[1:], strict=False):
                closed = any(abs(v[0] - far) < 1 and v[1] <= low + 2 and v[2] >= top - 2 for v in up)
                box = (float(min(x0, far)), low, float(x1 - x0), top - low)
                if 5 <= top - low <= 100 and (closed or min(abs(far - x - w), abs(far - x)) <= 3) and holds_centre(container, box):
                    texts = [t[2] for t in words if len(t[2]) <= 20 and holds(box, t[0], t[1])]
                    if texts:
                        out.append(_candidate(box, 0.75, "spine_device", texts))
    return out


def dedup(devices: list[dict], symbols: list[dict] = ()) -> list[dict]:
    """Devices by falling score without those over 0.4 on a kept one, then symbols not over 0.5 on any."""
    kept: list[dict] = []
    for c in sorted(devices, key=lambda c: -c["score"]):
        if all(overlap(c["bbox"], k["bbox"]) <= 0.4 for k in kept):
            kept.append(c)
    for s in symbols:
        if all(overlap(s["bbox"], k["bbox"]) <= 0.5 for k in kept):
            kept.append(s)
    return kept


def candidates(rows: list[dict], container: Box, boxes: list[Box] | None = None) -> list[dict]:
    """Rectangles (0.95), spine devices (0.75), open shapes (0.7, 0.5), circles with texts (0.60) and lone texts (0.40)."""
    words = words_of(rows)
    boxes = [b for b, _ in rectangles(rows)] if boxes is None else boxes
    devices = [_candidate(b, 0.95, "closed_rect") for b in boxes if holds_centre(container, b) and 3 <= b[2] <= 150 and 3 <= b[3] <= 150]
    devices += spine_devices(rows, container, words)
    devices += [_candidate(b, score, kind) for b, score, kind in open_shapes(rows, container)]
    symbols = []
    for r in rows:
        if r["kind"] == "CIRCLE" and r.get("cx") is not None and 2 <= (r.get("radius") or 0) <= 30 and holds(container, r["cx"], r["cy"]):
            texts = [w[2] for w in texts_near(words, r["cx"], r["cy"], 1.5 * r["radius"])]
            if texts:
                box = (r["cx"] - r["radius"], r["cy"] - r["radius"], 2 * r["radius"], 2 * r["radius"])
                symbols.append({**_candidate(box, 0.60, "symbol", texts), "name": texts[0]})
    held = dedup(devices, symbols)
    for x, y, t in words:
        if len(t) <= 20 and holds(container, x, y) and all(overlap((x - 1, y - 1, 2, 2), c["bbox"]) <= 0.2 for c in held):
            w = max(10.0 * len(t), 20.0)
            devices.append(_candidate((x - w / 2, y - 7.5, w, 15.0), 0.40, "text", [t]))
    return dedup(devices, symbols)


def name_devices(devices: list[dict], words: list[Word]) -> None:
    """The highest text in each device's box is its name, the others its description."""
    for d in devices:
        inside = sorted((w for w in words if holds(d["bbox"], w[0], w[1])), key=lambda w: -w[1])
        if inside:
            d["name"], d["description"] = inside[0][2], [w[2] for w in inside[1:]]


def shown_name(device: dict) -> str:
    """Name and description as a node shows them; empty for devices without any text."""
    name = device["name"] or (device["texts"][0] if device.get("texts") else "")
    return " / ".join([name, *([" / ".join(device["description"])] if device["description"] else [])]) if name else ""


# --- groups -------------------------------------------------------------------------------------------------
def _spread(v: list[float]) -> float:
    return max(v) - min(v)


def line_score(boxes: list[Box], along: int, container: Box) -> tuple[float, list[str]]:
    """Evidence that boxes form a column (along 1) or row (along 0) of a container."""
    across, order = [centre(b)[1 - along] for b in boxes], sorted(centre(b)[along] for b in boxes)
    gaps = [b - a for a, b in zip(order, order[1:], strict=False)]
    apart = bool(gaps) and min(gaps) > 2.0
    even = stdev(gaps) if apart and len(gaps) >= 2 else None
    size = container[2 + (1 - along)] if container[2 + (1 - along)] > 0 else 1
    low, high = (mean(across) - container[1 - along]) / size, (container[1 - along] + size - mean(across)) / size
    edge = ("left_edge" if container[0] > 0 and low < 0.15 else "right_edge" if high < 0.15 else "") if along else ("top_edge" if high < 0.1 else "")
    tests = [
        (_spread(across) <= 4, 0.30, "x_align" if along else "y_align"), (_spread([b[2] for b in boxes]) <= 8, 0.15, "w_consist"), (_spread([b[3] for b in boxes]) <= 6, 0.15, "h_consist"),
        (even is not None and even <= 5, 0.20, f"spacing_std:{even or 0:.1f}"), (apart, 0.10, f"count:{len(boxes)}"), (bool(edge), 0.10, edge),
    ]
    return sum(points for test, points, _ in tests if test), [why for test, _, why in tests if test]


def is_grid(boxes: list[Box]) -> tuple[int, int] | None:
    """(columns, rows) if the centres' distinct coordinates make up as many places as there are boxes."""
    xs, ys = ({round(centre(b)[axis], 1) for b in boxes} for axis in (0, 1))
    return (len(xs), len(ys)) if len(boxes) >= 4 and len(xs) >= 2 and len(ys) >= 2 and len(xs) * len(ys) == len(boxes) else None


def classify_group(boxes: list[Box], container: Box) -> tuple[str, float, list[str]]:
    grid = is_grid(boxes)
    if grid:
        return "GRID", 0.8, [f"grid_{grid[0]}x{grid[1]}"]
    for kind, along, most in (("VERTICAL_COLUMN", 1, 12), ("HORIZONTAL_ROW", 0, 8)):
        if _spread([centre(b)[1 - along] for b in boxes]) <= most:
            score, why = line_score(boxes, along, container)
            if score >= 0.4:
                return kind, score, why
    return "FREEFORM", 0.0, ["connected"]


def groups(devices: list[dict], container: Box) -> list[dict]:
    """Clusters of devices within 30 units with their type, score and evidence; columns and grids from above, rows from the left."""
    label = dbscan([(*centre(d["bbox"]), 0.1 * d["bbox"][2], 0.1 * d["bbox"][3]) for d in devices], 30.0, 2)
    out = []
    for k in range(max(label, default=-1) + 1):
        own = [d for d, at in zip(devices, label, strict=True) if at == k]
        kind, score, why = classify_group([d["bbox"] for d in own], container)
        if kind != "FREEFORM":
            own.sort(key=lambda d: centre(d["bbox"])[0] if kind == "HORIZONTAL_ROW" else -centre(d["bbox"])[1])
        out.append({"bbox": union_box([d["bbox"] for d in own]), "type": kind, "score": score, "evidence": why, "members": own, "name": ""})
    return out


def name_groups(found: list[dict], words: list[Word]) -> None:
    """The lowest text up to 30 above a group and 50 beside its middle is its name."""
    for g in found:
        top, middle = g["bbox"][1] + g["bbox"][3], centre(g["bbox"])[0]
        near = [w for w in words if abs(w[0] - middle) <= 50 and 0 <= w[1] - top <= 30]
        g["name"] = min(near, key=lambda w: w[1])[2] if near else ""


def device_category(name: str, block: str = "", parent: str = "") -> tuple[str, float]:
    """Category of a device from its block (0.4), each list of name prefixes (0.3) and its parent's name (0.1); first on ties."""
    score: dict[str, float] = {}
    if block in BLOCK_CATEGORIES:
        score[BLOCK_CATEGORIES[block]] = 0.4
    for shown, points in ((name, 0.3), (parent, 0.1)):
        for prefixes, kind in NAME_CATEGORIES:
            if shown and shown.lower().startswith(prefixes):
                score[kind] = score.get(kind, 0.0) + points
    best = max(score, key=lambda k: score[k], default="UNKNOWN")
    return best, score.get(best, 0.0)


def semantics(shape: str | None, members: list[dict], table: dict | None = None) -> tuple[str, float]:
    """Sum of evidence from shape, names, attribute categories and a table row; the highest label, first on ties."""
    score: dict[str, float] = {}

    def add(label: str, points: float) -> None:
        score[label] = score.get(label, 0.0) + points

    if shape in SHAPE_EVIDENCE:
        add(*SHAPE_EVIDENCE[shape])
    names = [m["name"].lower() for m in members if m.get("name")]
    for prefixes, label, weight in NAME_EVIDENCE if names else ():
        hit = sum(n.startswith(prefixes) for n in names)
        if hit:
            add(label, weight * hit / len(names))
    kinds = Counter(m["category"] for m in members if m.get("category"))
    for kind, label in ATTRIBUTE_EVIDENCE.items():
        if kinds and kinds[kind] / kinds.total() >= 0.5:
            add(label, 0.20)
    for word, label, weight in TABLE_EVIDENCE if table else ():
        if word in (table.get("description") or ""):
            add(label, weight)
    model = next((m for m in MODEL_EVIDENCE if table and (table.get("model") or "").strip().lower().startswith(m[0])), None)
    if model:
        add(*model[1:])
    best = max(score, key=lambda k: score[k], default="UNKNOWN")
    return best, round(score.get(best, 0.0), 3)


def faces(boxes: list[Box], words: list[Word]) -> list[str]:
    """front or back of each cabinet from the face text below it; of cabinets without one, the lowest is the front."""
    if len(boxes) < 2:
        return [""] * len(boxes)
    marks = [(x, y, t.replace(" ", "")) for x, y, t in words if t.replace(" ", "") in ("正面", "背面")]
    out = []
    for b in boxes:
        cx = centre(b)[0]
        met = min(((abs(x - cx) + 0.5 * (b[1] - y), k) for k, (x, y, _) in enumerate(marks) if abs(x - cx) <= 0.6 * b[2] and 0 < b[1] - y <= 200), default=None)
        out.append({"正面": "front", "背面": "back"}[marks[met[1]][2]] if met else "")
    bare = sorted((k for k, f in enumerate(out) if not f), key=lambda k: boxes[k][1])
    for n, k in enumerate(bare):
        out[k] = "back" if n else "front"
    return out


# --- the tree -----------------------------------------------------------------------------------------------
NODE_SCHEMA = "document_hash string, node_id string, parent_id string, root_id string, ord int, type string, name string, group_type string, x double, y double, w double, h double, data map<string,string>, error string"


class Tree:
    """Flat nodes with their parents; ids are numbers in order of making, so they are unique in a document."""

    def __init__(self):
        self.nodes: list[dict] = []

    def add(self, parent: dict | None, kind: str, box: Box, name: str = "", group_type: str | None = None, **data: object) -> dict:
        node = {
            "node_id": f"n{len(self.nodes)}", "parent_id": parent and parent["node_id"], "root_id": parent["root_id"] if parent else f"n{len(self.nodes)}", "ord": len(self.nodes), "type": kind, "name": name,
            "group_type": group_type, "x": box[0], "y": box[1], "w": box[2], "h": box[3], "data": {k: str(v) for k, v in data.items()},
        }
        self.nodes.append(node)
        return node


def grow(tree: Tree, parent: dict, container: Box, cabinet: Box, rows: list[dict], boxes: list[Box], table: dict | None, taken: list[Box]) -> None:
    """Groups and devices of a container, without those in areas that are done; fewer than two candidates give nothing."""
    words = [w for w in words_of(rows) if len(w[2]) <= 20]
    devices = candidates(rows, container, boxes)
    if len(devices) >= 2:
        devices = [d for d in devices if not any(holds_centre(b, d["bbox"]) for b in taken)]
    if len(devices) < 2:
        return
    name_devices(devices, words)
    for k, info in match_devices(table, [d["name"] for d in devices]).items():
        devices[k]["table_info"] = info
    found = groups(devices, cabinet)
    name_groups(found, words)

    def put(home: dict, d: dict) -> None:
        name = shown_name(d)
        if name:
            tree.add(home, "DEVICE", d["bbox"], name, source=d["source"], **d.get("table_info", {}))

    for g in found:
        label, sure = semantics(g["type"], [{"name": shown_name(m)} for m in g["members"]])
        node = tree.add(parent, "GROUP", g["bbox"], g["name"], g["type"], score=round(g["score"], 2), evidence=",".join(g["evidence"]), semantic=label, confidence=sure)
        for m in g["members"]:
            put(node, m)
    grouped = {id(m) for g in found for m in g["members"]}
    for d in devices:
        if id(d) not in grouped:
            put(parent, d)


def layout_nodes(rows: list[dict]) -> list[dict]:
    """Flat layout nodes of one document: cabinets, areas, groups, devices with their parents."""
    boxes, tree, roots = [b for b, _ in rectangles(rows)], Tree(), []
    for c in cabinets(rows, boxes):
        table = cabinet_table(rows, c["bbox"])
        root = tree.add(None, "CABINET", c["bbox"], c["name"], source="rectangle" if c["rect"] else "paired_verticals")
        roots.append(root)
        if table:
            root["data"] |= {"table_header": "\t".join(table["header"]), "table_rows": "\n".join("\t".join(r) for r in table["rows"])}
        parts = areas(rows, c["bbox"], boxes)
        for box, name, number in parts:
            area = tree.add(root, "PANEL_AREA", box, name, number=number)
            grow(tree, area, box, c["bbox"], rows, boxes, table, [])
        grow(tree, root, c["bbox"], c["bbox"], rows, boxes, table, [box for box, _, _ in parts])
    for root, face in zip(roots, faces([(r["x"], r["y"], r["w"], r["h"]) for r in roots], words_of(rows)), strict=True):
        if face:
            root["data"]["face"] = face
            root["name"] = root["name"] or {"front": "正面", "back": "背面"}[face]
    return tree.nodes


def physical_cabinets(nodes: list[dict]) -> list[dict]:
    """Cabinets of a layout with their devices: those directly below and any below their areas, not those of direct groups."""
    by_id = {n["node_id"]: n for n in nodes}

    def counted(n: dict, root: dict) -> bool:
        up = by_id.get(n["parent_id"])
        while up and up["parent_id"] != root["node_id"] and up is not root:
            up = by_id.get(up["parent_id"])
        return up is root or (up is not None and up["type"] == "PANEL_AREA")

    out = []
    for root in nodes:
        if root["type"] == "CABINET":
            own = [n for n in nodes if n["type"] == "DEVICE" and n["root_id"] == root["node_id"] and counted(n, root)]
            out.append({"cabinet_id": root["node_id"], "name": root["name"], "x": root["x"], "y": root["y"], "w": root["w"], "h": root["h"], "devices": len(own), "names": ",".join(sorted(n["name"] for n in own))})
    return out


PHYSICAL_SCHEMA = "document_hash string, cabinet_id string, name string, x double, y double, w double, h double, devices int, names string, error string"


# --- grouped runs -------------------------------------------------------------------------------------------
READS = ("kind", "x", "y", "text", "points", "cx", "cy", "radius")


def with_parents(nodes: list[dict]) -> list[dict]:
    """Nodes with the type of the node above them."""
    kinds = {n["node_id"]: n["type"] for n in nodes}
    return [{**n, "parent": kinds.get(n["parent_id"])} for n in nodes]


def scan_layout(entities: DataFrame, parents: bool = False) -> DataFrame:
    """Layout nodes; with ``parents`` also the type of each one's parent, which a join would look up."""
    if parents:
        return per_document(entities, lambda rows: with_parents(layout_nodes(rows)), f"{NODE_SCHEMA}, parent string", READS)
    return per_document(entities, layout_nodes, NODE_SCHEMA, READS)


def scan_physical_cabinets(entities: DataFrame) -> DataFrame:
    return per_document(entities, lambda rows: physical_cabinets(layout_nodes(rows)), PHYSICAL_SCHEMA, READS)

