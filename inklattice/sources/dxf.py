"""Reader of ASCII DXF drawings.

A file is pairs of lines: a group code and a value.  Entities of the drawing come out in file order; an insert's
attributes and, for converted drawings, the shapes of its block come before the insert itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

Pairs = list[tuple[int, str]]

# Applications whose extended data count.
APPLICATIONS = ("Cable", "WireLine")


def gbk_escapes(text: str) -> str:
    """``\\M+5XXXX`` escapes as GBK characters; what does not decode stays."""

    def one(m: re.Match) -> str:
        try:
            return bytes.fromhex(m[1]).decode("gbk")
        except UnicodeDecodeError:
            return m[0]

    return re.sub(r"\\M\+5([0-9A-Fa-f]{4})", one, text)


def plain_mtext(text: str) -> str:
    """Formatted text without its codes: paragraphs as line ends, groups without braces, escaped characters as they are."""
    text = re.sub(r"\\P", "\n", text)
    text = re.sub(r"\\~", " ", text)
    text = re.sub(r"\\[ACFHQTWfp][^;\\{}]*;", "", text)
    text = re.sub(r"\\[LlOoKk]", "", text)
    return re.sub(r"\\([\\{}])", r"\1", re.sub(r"(?<!\\)[{}]", "", text))


def _groups(text: str) -> Pairs:
    lines = [x.strip("\r\n") for x in text.split("\n")]
    return [(int(c), v.strip()) for c, v in zip(lines[::2], lines[1::2], strict=False) if re.fullmatch(r"\s*-?[0-9]+\s*", c)]


def _records(pairs: Pairs) -> Iterator[tuple[str, Pairs]]:
    """(type, groups) of each record: a record begins at code 0."""
    kind, held = None, []
    for code, value in pairs:
        if code == 0:
            if kind is not None:
                yield kind, held
            kind, held = value, []
        else:
            held.append((code, value))
    if kind is not None:
        yield kind, held


def _sections(pairs: Pairs) -> dict[str, list[tuple[str, Pairs]]]:
    out: dict[str, list[tuple[str, Pairs]]] = {}
    name = None
    for kind, groups in _records(pairs):
        if kind == "SECTION":
            name = next((v for c, v in groups if c == 2), "")
            out.setdefault(name, [])
        elif kind in ("ENDSEC", "EOF"):
            name = None
        elif name is not None:
            out[name].append((kind, groups))
    return out


def _first(groups: Pairs, code: int, default: str = "") -> str:
    return next((v for c, v in groups if c == code), default)


def _number(groups: Pairs, code: int) -> float | None:
    value = _first(groups, code)
    return float(value) if value else None


def _extended(groups: Pairs) -> list[str]:
    """Strings (code 1000) below the applications that count."""
    out, app = [], None
    for code, value in groups:
        if code == 1001:
            app = value
        elif code == 1000 and app in APPLICATIONS:
            out.append(value)
    return out


class Drawing:
    """Layers' line types, blocks and entities of a file."""

    def __init__(self, text: str):
        sections = _sections(_groups(text))
        self.layers = {_first(g, 2): _first(g, 6) for kind, g in sections.get("TABLES", []) if kind == "LAYER"}
        self.entities = sections.get("ENTITIES", [])
        self.blocks: dict[str, tuple[tuple[float, float], list[tuple[str, Pairs]]]] = {}
        name = None
        for kind, groups in sections.get("BLOCKS", []):
            if kind == "BLOCK":
                name = _first(groups, 2)
                self.blocks[name] = ((_number(groups, 10) or 0.0, _number(groups, 20) or 0.0), [])
            elif kind == "ENDBLK":
                name = None
            elif name is not None:
                self.blocks[name][1].append((kind, groups))

    def line_type(self, groups: Pairs, layer: str) -> str | None:
        """The entity's own line type; by its layer if it says so or says nothing."""
        own = _first(groups, 6, "BYLAYER")
        return (self.layers.get(layer, "") if own.upper() == "BYLAYER" else own) or None

    def shape(self, kind: str, groups: Pairs, full: bool, move=None, layer: str = "") -> dict | None:
        """The row of a shape or text, moved; None for kinds that are left out."""
        moved = move or (lambda x, y: (x, y))
        layer = _first(groups, 8) or layer
        row: dict = {"layer": layer, "handle": _first(groups, 5) or None}
        x, y = _number(groups, 10), _number(groups, 20)
        if x is not None and y is not None and kind != "LWPOLYLINE":
            x, y = moved(x, y)
        more = {"ltype": self.line_type(groups, layer)} if full else {}
        if kind in ("LINE", "LWPOLYLINE") and full and move is None:
            more["eed"] = _extended(groups)
        if kind == "LINE":
            x2, y2 = _number(groups, 11), _number(groups, 21)
            if x is None or x2 is None or y2 is None:
                return None
            x2, y2 = moved(x2, y2)
            return row | {"kind": "LINE", "points": [{"x": x, "y": y}, {"x": x2, "y": y2}], "closed": False} | more
        if kind == "LWPOLYLINE":
            xs, ys = [float(v) for c, v in groups if c == 10], [float(v) for c, v in groups if c == 20]
            points = [dict(zip("xy", moved(*p), strict=True)) for p in zip(xs, ys, strict=False)]
            return row | {"kind": "LINE", "points": points, "closed": bool(int(_first(groups, 70, "0")) & 1)} | more
        if kind == "CIRCLE" or (kind == "ARC" and full):
            row |= {"kind": kind, "cx": x, "cy": y, "radius": _number(groups, 40)}
            return row | ({"start_angle": _number(groups, 50), "end_angle": _number(groups, 51)} if kind == "ARC" else {})
        if kind in ("TEXT", "MTEXT"):
            shown = "".join(v for c, v in groups if c == 3) + _first(groups, 1) if kind == "MTEXT" else _first(groups, 1)
            shown = gbk_escapes(plain_mtext(shown) if kind == "MTEXT" else shown).strip()
            return row | {"kind": "TEXT", "text": shown, "x": x, "y": y, "rotation": _number(groups, 50) or 0.0} if shown else None
        return None

    def rows(self, full: bool = True) -> Iterator[dict]:
        """Rows in order.  Plain drawings (not ``full``) have no arcs, line types, extended data and expanded blocks."""
        pending: dict | None = None
        for kind, groups in self.entities:
            if kind == "ATTRIB" and pending is not None:
                tag, shown = _first(groups, 2).strip(), gbk_escapes(_first(groups, 1)).strip()
                if tag and shown:
                    yield {"kind": "ATTRIB", "entity_id": f"{pending['handle'] or ''}__{tag}", "tag": tag, "text": shown, "x": _number(groups, 10), "y": _number(groups, 20), "layer": pending["layer"]}
                continue
            if pending is not None:
                yield from self._close(pending, full)
                pending = None
            if kind == "INSERT":
                pending = {
                    "kind": "INSERT", "layer": _first(groups, 8), "handle": _first(groups, 5) or None, "block_name": _first(groups, 2), "ins_x": _number(groups, 10), "ins_y": _number(groups, 20), "rotation": _number(groups, 50) or 0.0,
                    "scale_x": _number(groups, 41) or 1.0, "scale_y": _number(groups, 42) or 1.0,
                }
            elif (row := self.shape(kind, groups, full)) is not None:
                yield row
        if pending is not None:
            yield from self._close(pending, full)

    def _close(self, insert: dict, full: bool) -> Iterator[dict]:
        """The shapes of an insert's block at their places, one level down, then the insert."""
        (bx, by), members = self.blocks.get(insert["block_name"], ((0.0, 0.0), []))
        turn, sx, sy = math.radians(insert["rotation"]), insert["scale_x"], insert["scale_y"]

        def move(x: float, y: float) -> tuple[float, float]:
            x, y = (x - bx) * sx, (y - by) * sy
            return insert["ins_x"] + x * math.cos(turn) - y * math.sin(turn), insert["ins_y"] + x * math.sin(turn) + y * math.cos(turn)

        if full and insert["ins_x"] is not None and insert["ins_y"] is not None:
            for kind, groups in members:
                row = self.shape(kind, groups, full, move, insert["layer"])
                if row and row["kind"] in ("CIRCLE", "ARC"):
                    if abs(abs(sx) - abs(sy)) > 1e-9:
                        continue  # an ellipse
                    row["radius"] = row["radius"] * abs(sx) if row["radius"] is not None else None
                    if row["kind"] == "ARC" and row["start_angle"] is not None:
                        row |= {"start_angle": row["start_angle"] + insert["rotation"], "end_angle": (row["end_angle"] or 0.0) + insert["rotation"]}
                if row:
                    yield row
        yield insert


def dxf_entities(text: str, document: str, full: bool = True) -> list[dict]:
    """Entity rows of an ASCII DXF text."""
    out = []
    for row in Drawing(text).rows(full):
        out.append({"document_hash": document, "seq": len(out), "entity_id": row.get("handle") or f"dxf_{len(out)}", "source": "dxf", "page": 1, "confidence": 1.0, **row})
    return out
