"""Tables in drawings: regions, rows, headers, and the parsers of equipment, usage, material and schedule tables.

All work on one document's rows in file order.  Rows of a table are lists of (x, text) cells from left to right.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from inklattice.operators.shapes import Box, Word, centre, collected, count_texts, default_noise, holds, rectangles, union_box, words_of

Row = list[tuple[float, str]]
Roles = list[tuple[str, str]]

# Header words of tables and their roles, in order.
TABLE_ROLES: dict[str, Roles] = {
    "equipment": [("index", r"序号|序號|编[号號]|顺序"), ("name", r"名[\s]*称|名[称稱]|符号|符號|代号"), ("model", r"型[\s]*号|型[号號]|规[\s]*格|规[格範]"), ("desc", r"说[\s]*明|說明|描[\s]*述|用[\s]*途|备[\s]*注|備[注]"), ("qty", r"数[\s]*量|數量|件数"), ("position", r"安[\s]*装|位[\s]*置|柜[\s]*体|安装位置")],
    "usage": [("cell_label", r"屏\s*号"), ("equipment", r"名\s*称"), ("qty", r"数\s*量"), ("remark", r"备[\s]*注")],
    "material": [("name", r"名[\s]*称|名[称稱]"), ("unit", r"单位|單[位]"), ("qty", r"数量|數[量]"), ("remark", r"备[\s]*注|備[注]|说明|說明"), ("index", r"序号|序號|顺序|順[序]"), ("legend", r"图例")],
    "schedule": [
        ("cable_id", r"电缆编号|电缆编[号碼]|编[号號]|序号|序號|电缆(?:名称|ID|编号)"), ("circuit_desc", r"电缆型号|型号|规格|电[缆线]型号"), ("strip_name", r"起点(?:柜|端子)?|起始|始端|来源|來[源渊]|本端"), ("terminal_no_remote", r"终点(?:柜|端子)?|終点|末端|目标|目的|对端"),
        ("conductor_no", r"芯数|线芯|线[芯心]数|芯线数|缆芯"), ("loop_id", r"回路(?:编号|编[号號])?|回[路線]编号"), ("circuit_desc", r"备注|注|说明|說[明文]"), ("cabinet_name", r"柜体|机柜|安装位置|所在柜|所属柜"),
    ],
}
# Least sizes of table regions, and sizes of regions around titles.
LEAST_TEXTS, LEAST_RECTS = 4, 6
TITLE_BOX, MATERIAL_BOX, EQUIPMENT_BOX = (-200, -350, 350, 450), (-140, -170, 300, 200), (-120, -42, 240, 52)
# Cells that say nothing, and words that mark a device's name rather than a table's title.
IDLE_CELLS = frozenset({"右侧", "左侧", "正面", "背面", "设  备  表", "设备表", "材料表", "设备材料表", "附件材料表"})
METER_WORDS = "电压电流功"
CABLE_ID = r"[A-Za-z0-9]{2,8}-[A-Za-z0-9]{1,8}"
USAGE_LABEL = r"\d+[CF]"


# --- rows and headers ---------------------------------------------------------------------------------------
def text_rows(words: list[Word], tol: float) -> list[Row]:
    """Rows by round(y / tol) half to even, top first, cells from left; one row alone is none."""
    rows: dict[float, Row] = {}
    for x, y, t in words:
        rows.setdefault(round(y / tol) * tol, []).append((x, t))
    return [sorted(rows[k], key=lambda c: c[0]) for k in sorted(rows, reverse=True)] if len(rows) >= 2 else []


def _number(label: str) -> int:
    m = re.match(r"\d+", label)
    return int(m[0]) if m else 0


def label_rows(words: list[Word], label: str, tol: float) -> list[Row]:
    """Rows around labels (full matches), by their numbers: each other text within ``tol`` goes to the first label only."""
    anchors = sorted((w for w in words if re.fullmatch(label, w[2])), key=lambda w: _number(w[2]))
    if not anchors:
        return text_rows(words, tol)
    left = {k: w for k, w in enumerate(words) if not re.fullmatch(label, w[2])}
    rows = []
    for x, y, name in anchors:
        own = [k for k, w in left.items() if abs(w[1] - y) <= tol]
        rows.append(sorted([(x, name), *((left.pop(k))[::2] for k in own)], key=lambda c: c[0]))
    return sorted(rows, key=lambda r: _number(r[0][1]))


def header_row(rows: list[Row], roles: Roles) -> int | None:
    """The first row whose joined text holds any header word."""
    return next((k for k, row in enumerate(rows) if any(re.search(p, " ".join(t for _, t in row)) for _, p in roles)), None)


def header_roles(cells: Row, roles: Roles) -> dict[int, str]:
    """Role of each cell that has one: the first whose words it holds."""
    return {k: role for k, (_, t) in enumerate(cells) if (role := next((r for r, p in roles if re.search(p, t)), None))}


def gap_between(cells: Row, roles: dict[int, str], role: str = "cell_label") -> float | None:
    """Where a table's second half begins: midway before the second cell of a role."""
    at = [k for k, r in roles.items() if r == role]
    return (cells[at[1] - 1][0] + cells[at[1]][0]) / 2 if len(at) > 1 else None


# --- regions ------------------------------------------------------------------------------------------------
def dbscan(features: list[tuple[float, ...]], eps: float, least: int) -> list[int]:
    """Cluster of each point in scan order, -1 for noise; eps is inclusive and a point is its own neighbour.

    Neighbours are looked for in cells of the first two coordinates.
    """
    cells: dict[tuple[int, int], list[int]] = {}
    cell = lambda f: (int(f[0] // eps), int(f[1] // eps))
    for k, f in enumerate(features):
        cells.setdefault(cell(f), []).append(k)

    def near(k: int) -> list[int]:
        f, (i, j) = features[k], cell(features[k])
        around = [m for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for m in cells.get((a, b), ())]
        return sorted(m for m in around if sum((p - q) ** 2 for p, q in zip(f, features[m], strict=True)) <= eps * eps)

    label, at = [-1] * len(features), -1
    for k in range(len(features)):
        if label[k] >= 0 or len(own := near(k)) < least:
            continue
        at += 1
        label[k], queue = at, own
        for m in queue:  # grows while it is walked
            if label[m] < 0:
                label[m] = at
                if len(more := near(m)) >= least:
                    queue += more
    return label


def table_clusters(rows: list[dict]) -> list[tuple[Box, float]]:
    """Clusters of small rectangles whose centres fill half of a grid or more, with texts: (box, 0.9)."""
    small = [b for b, _ in rectangles(rows) if b[2] < 200 and b[3] < 200]
    if len(small) < LEAST_RECTS:
        return []
    label = dbscan([centre(b) for b in small], 30.0, LEAST_RECTS)
    out = []
    for k in range(max(label) + 1):
        own = [b for b, at in zip(small, label, strict=True) if at == k]
        columns, lines = ({round(centre(b)[axis] / 8) * 8 for b in own} for axis in (0, 1))
        if len(own) >= LEAST_RECTS and len(columns) >= 2 and len(lines) >= 2 and 2 * len(own) >= len(columns) * len(lines):
            box = union_box(own)
            if count_texts(rows, box) >= LEAST_TEXTS:
                out.append((box, 0.9))
    return out


def table_rects(rows: list[dict], container: Box | None = None, least: tuple[float, float] = (60.0, 80.0)) -> list[Box]:
    """Rectangles with texts whose lower left corner lies in the container."""
    boxes = (b for b, _ in rectangles(rows) if b[2] >= least[0] and b[3] >= least[1] and (container is None or holds(container, b[0], b[1])))
    return [b for b in boxes if count_texts(rows, b) >= LEAST_TEXTS]


def around(x: float, y: float, offsets: tuple[float, float, float, float]) -> Box:
    return x + offsets[0], y + offsets[1], offsets[2], offsets[3]


def title_region(rows: list[dict]) -> Box | None:
    """A box around the right-most text that ends with 表."""
    titles = [w for w in words_of(rows) if w[2].replace(" ", "").endswith("表")]
    best = max(titles, key=lambda w: w[0], default=None)
    return best and around(best[0], best[1], TITLE_BOX)


def table_regions(rows: list[dict], container: Box | None = None) -> list[tuple[Box, float]]:
    """Clusters (0.9), rectangles (0.6) and the title's box (0.4), without such at the same corner, surest first."""
    out = list(table_clusters(rows))
    title = title_region(rows)
    for box, sure in [*((b, 0.6) for b in table_rects(rows, container)), *([(title, 0.4)] if title else [])]:
        if not any(abs(b[0] - box[0]) < 1 and abs(b[1] - box[1]) < 1 for b, _ in out):
            out.append((box, sure))
    return sorted(out, key=lambda r: -r[1])


# --- the parsers' common part -------------------------------------------------------------------------------
class Head:
    """A table's rows with its header found, and the texts between the header's margins."""

    def __init__(self, rows: list[Row], at: int, roles: dict[int, str], texts: list[Word]):
        self.rows, self.at, self.cells, self.roles = rows, at, rows[at], roles
        low, high = min(x for x, _ in self.cells) - 30, max(x for x, _ in self.cells) + 30
        self.texts = [w for w in texts if low <= w[0] <= high]
        self.gap = gap_between(self.cells, roles)


def find_head(rows: list[dict], box: Box | None, kind: str, tol: float, longest: int, noise: Callable[[str], bool] = default_noise) -> Head | None:
    texts = collected(rows, box, longest, noise)
    lines = text_rows(texts, tol) if len(texts) >= LEAST_TEXTS else []
    at = header_row(lines, TABLE_ROLES[kind])
    roles = header_roles(lines[at], TABLE_ROLES[kind]) if at is not None else {}
    return Head(lines, at, roles, texts) if roles else None


# --- equipment ----------------------------------------------------------------------------------------------
def _idle(cell: str) -> bool:
    t = cell.strip()
    return not t or t in IDLE_CELLS or (len(t) <= 8 and re.fullmatch(r"[A-Za-z\-.]+", t) is not None)


def dealt_to_columns(row: Row, headers: list[float]) -> list[str]:
    """Texts go to the nearest of the next three headers (5 units nearer, to pass one by); a header passed by takes no more."""
    cells, at = [""] * len(headers), 0
    for x, t in sorted(row, key=lambda c: c[0]):
        if x < headers[0] - 15 or at >= len(headers):
            continue
        best, gap = at, abs(x - headers[at])
        for k in range(at + 1, min(at + 3, len(headers))):
            if abs(x - headers[k]) < gap - 5:
                best, gap = k, abs(x - headers[k])
        cells[best] = t
        at = best + 1
    return cells


def equipment_table(rows: list[dict], box: Box) -> dict | None:
    """{header, columns: {role: index}, rows: lists of cells} of an equipment table in a box."""
    head = find_head(rows, box, "equipment", 5.0, 30)
    if head is None:
        return None
    at = [x for x, _ in head.cells]
    dealt = [dealt_to_columns(row, at) for k, row in enumerate(head.rows) if k != head.at]
    data = [cells for cells in dealt if not all(map(_idle, cells))]
    return {"header": [t for _, t in head.cells], "columns": {r: k for k, r in head.roles.items()}, "rows": data, "bbox": box} if data else None


def cabinet_table(rows: list[dict], cabinet: Box) -> dict | None:
    """The first equipment table with a name column near a cabinet: at a title, else in a rectangle of 60 x 50 or more."""
    search = (cabinet[0], cabinet[1] - 100, cabinet[2] + 200, cabinet[3] + 100)
    boxes = []
    for x, y, t in words_of(rows):
        clean = t.replace(" ", "")
        if clean.endswith("表") and len(clean) <= 6 and not any(c in METER_WORDS for c in clean[:-1]) and holds(search, x, y):
            boxes.append(around(x, y, EQUIPMENT_BOX))
    for box in [*boxes, *table_rects(rows, search, (60.0, 50.0))]:
        table = equipment_table(rows, box)
        if table and "name" in table["columns"]:
            return table
    return None


def match_devices(table: dict | None, names: list[str]) -> dict[int, dict[str, str]]:
    """Model, description and quantity of each device: the first whose name is the row's, or begins with it and a space."""
    if not table or "name" not in table["columns"]:
        return {}
    columns, out = table["columns"], {}
    for row in table["rows"]:
        name = row[columns["name"]]
        k = next((k for k, n in enumerate(names) if name and (n == name or n.startswith(name + " "))), None)
        info = {key: row[columns[role]] for key, role in (("model", "model"), ("description", "desc"), ("qty", "qty")) if role in columns}
        if k is not None and info:
            out[k] = info
    return out


# --- usage, material, schedule ------------------------------------------------------------------------------
def usage_rows(rows: list[dict]) -> list[dict]:
    """Label, equipment, quantity and remark of a usage table: texts within 6 units of a label, by their order around it."""
    box = title_region(rows)
    head = find_head(rows, box, "usage", 6.0, 50) if box else None
    if head is None:
        return []
    sides = [head.cells] if head.gap is None else [[c for c in head.cells if c[0] < head.gap], [c for c in head.cells if c[0] >= head.gap]]
    out = []
    for x, y, label in sorted((w for w in head.texts if re.fullmatch(USAGE_LABEL, w[2])), key=lambda w: _number(w[2])):
        side = int(head.gap is not None and x >= head.gap)
        # Roles count from a half's left edge, in both halves by the first half's header.
        roles = [head.roles.get(k, "") for k in range(len(sides[side]))]
        place = max((k for k, r in enumerate(roles) if r == "cell_label"), default=None)
        if place is None:
            continue
        own = sorted((w for w in head.texts if abs(w[1] - y) <= 6 and not re.fullmatch(USAGE_LABEL, w[2]) and (head.gap is None or (w[0] >= head.gap) == bool(side))), key=lambda w: w[0])
        made = {"cell_label": label, "equipment": "", "qty": 0, "remark": ""}
        for k, (_, _, t) in enumerate(own):
            role = roles[k + (k >= place)] if k + (k >= place) < len(roles) else ""
            if role == "equipment" and not made["equipment"]:
                made["equipment"] = t
            elif role == "qty" and re.fullmatch(r"[+-]?[0-9]+", t):
                made["qty"] += int(t)
            elif role == "remark" and t not in made["remark"]:
                made["remark"] = f"{made['remark']} / {t}" if made["remark"] else t
        out.append(made)
    return out


def material_rows(rows: list[dict]) -> list[dict]:
    """Rows below the header of the table titled 材料表: each cell under its nearest header within 50 units."""
    title = next((w for w in words_of(rows) if "材料表" in w[2].replace(" ", "")), None)
    noise = lambda t: default_noise(t) or re.fullmatch("[A-Z]", t) is not None
    head = find_head(rows, around(title[0], title[1], MATERIAL_BOX), "material", 5.0, 60, noise) if title else None
    out = []
    for row in head.rows[head.at + 1 :] if head else []:
        made: dict[str, str] = {}
        for x, t in row:
            k = min(range(len(head.cells)), key=lambda k: abs(head.cells[k][0] - x))
            if abs(head.cells[k][0] - x) <= 50 and k in head.roles:
                role = head.roles[k]
                made[role] = f"{made[role]} {t}" if made.get(role) else t
        if "name" in made or "qty" in made:
            qty = made.get("qty", "0")
            out.append({"index": made.get("index", ""), "name": made.get("name", ""), "unit": made.get("unit", ""), "qty": int(qty) if re.fullmatch(r"[+-]?[0-9]+", qty) else 0, "remark": made.get("remark", "")})
    return out


def schedule_rows(rows: list[dict]) -> list[dict]:
    """Topology records of a cable schedule's rows: cells take the roles of the header's cells by their order."""
    head = find_head(rows, None, "schedule", 3.0, 80)
    place = next((k for k, role in head.roles.items() if role == "cable_id"), None) if head else None
    out = []
    for row in head.rows[head.at + 1 :] if place is not None else []:
        cells = [t.strip() for _, t in row]
        if len(cells) <= place or not re.fullmatch(CABLE_ID, cells[place]):
            continue
        made: dict[str, object] = {"cable_id": cells[place], "source_type": "cable_schedule"}
        for k, role in head.roles.items():
            if k >= len(cells) or not cells[k] or role == "cable_id":
                continue
            if role == "conductor_no" and re.fullmatch(r"[+-]?[0-9]+", cells[k]):
                made["conductor_no"] = int(cells[k])
            elif role == "conductor_no":
                made["circuit_desc"] = f"{made.get('circuit_desc') or ''} {cells[k]}"
            elif role == "circuit_desc":
                made["circuit_desc"] = f"{made.get('circuit_desc') or ''} {cells[k]}".strip()
            else:
                made[role] = cells[k]
        out.append(made)
    return out


def schedule_records(rows: list[dict]) -> list[dict]:
    """Records of a cable schedule; without a table, its distinct cable ids in order."""
    found = schedule_rows(rows)
    if found:
        return found
    ids = sorted({i for _, _, t in collected(rows, None, 80) for i in re.findall(rf"\b({CABLE_ID})\b", t)})
    return [{"cable_id": i, "source_type": "cable_schedule"} for i in ids]
