"""Reader of drawing dumps: one JSON document of objects for each drawing, as drawing converters write it.

A dump is ``{"OBJECTS": [...]}``; objects with ``entity`` are drawn, those with ``object`` are tables and controls.
Handles are arrays of numbers: a code, a size, the value's parts, and last the value itself.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inklattice import schema
from inklattice.operators.grouped import arrow_schema, batch_of

# Named blocks that are expanded beside anonymous ones (*U...), and the two spaces.
EXPANDED = frozenset({"CT1", "tmR", "tmInLR", "IsGround", "CQ"})
SPACES = ("*Model_Space", "*Paper_Space")
DEPTH = 8
#: Rows that leave a task together.
BATCH_ROWS = 10_000

Affine = tuple[float, float, float, float, float, float]


# --- values -------------------------------------------------------------------------------------------------
def _number(v: object) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _text(o: dict, *names: str) -> str:
    return next((o[n].strip() for n in names if isinstance(o.get(n), str)), "")


def _point(v: object) -> tuple[float, float] | None:
    pair = [_number(x) for x in v[:2]] if isinstance(v, list) and len(v) >= 2 else [None]
    return None if None in pair else (pair[0], pair[1])


def _points(v: object) -> list[tuple[float, float]]:
    made = [_point([p.get("x"), p.get("y")] if isinstance(p, dict) else p) for p in v] if isinstance(v, list) else []
    return [p for p in made if p]


def _handle(v: object) -> list[int]:
    return [x for x in v if isinstance(x, int)] if isinstance(v, list) else []


def _value(v: object) -> int:
    """The handle's value; 0 without a handle."""
    return (_handle(v) or [0])[-1]


def _tail(handle: list[int]) -> tuple[int, ...]:
    """The value's parts: as many as the second number says."""
    return tuple(handle[2 : 2 + handle[1]]) if len(handle) >= 3 else ()


def extended_values(o: dict) -> list[str]:
    """The strings of extended data, trimmed, without empty ones."""
    found: list[str] = []

    def walk(v: object) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "value" and isinstance(x, str):
                    if x.strip():
                        found.append(x.strip())
                else:
                    walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(o.get("eed"))
    return found


# --- tables -------------------------------------------------------------------------------------------------
class Names:
    """Line types and blocks of a drawing.

    Objects carry other handles than references to them; both come in one order (by block, by layer, entries), so
    they are paired by place.
    """

    def __init__(self, objects: list[dict]):
        of = lambda kind: [o for o in objects if o.get("object") == kind]
        control = (of("LTYPE_CONTROL") or [{}])[0]
        references = [h for h in [*(_handle(control.get(k)) for k in ("byblock", "bylayer")), *map(_handle, control.get("entries") or [])] if h]
        types = [_text(o, "name") for o in of("LTYPE") if _handle(o.get("handle")) and _text(o, "name")]
        self.types = list(zip(references, types, strict=False))
        entries = (of("BLOCK_CONTROL") or [{}])[0].get("entries") or []
        blocks = [_text(o, "name") for o in objects if o.get("entity") == "BLOCK" and _text(o, "name") not in SPACES]
        self.blocks = {_tail(_handle(e)): name for e, name in zip(entries, blocks, strict=False) if _tail(_handle(e))}
        #: Members and base point of each block's header, by its handle's value.
        self.headers = {
            _value(o["handle"]): {"name": _text(o, "name"), "members": [_value(m) for m in o.get("entities") or [] if _handle(m)], "base": _point(o.get("base_pt")) or (0.0, 0.0)}
            for o in of("BLOCK_HEADER") if len(_handle(o.get("handle"))) >= 3
        }

    def line_type(self, o: dict) -> str | None:
        """The name of an explicit line type (flags 2 or 3): by the whole reference, else by all but its code."""
        own = _handle(o.get("ltype"))
        if not own or o.get("ltype_flags") not in (2, 3):
            return None
        return next((n for h, n in self.types if h == own), None) or next((n for h, n in self.types if h[1:] == own[1:]), None)


# --- entities -----------------------------------------------------------------------------------------------
def _moved(p: tuple[float, float], by: Affine | None) -> tuple[float, float]:
    return p if by is None else (by[0] * p[0] + by[1] * p[1] + by[4], by[2] * p[0] + by[3] * p[1] + by[5])


def _composed(outer: Affine | None, inner: Affine) -> Affine:
    if outer is None:
        return inner
    a, b, c, d, x, y = outer
    e, f, g, h, u, v = inner
    return a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h, a * u + b * v + x, c * u + d * v + y


def insertion(o: dict, base: tuple[float, float]) -> Affine:
    """Block coordinates to those of the place where a block is inserted: from the base point, scaled, turned, moved."""
    turn, at = _number(o.get("rotation")) or 0.0, _point(o.get("ins_pt")) or (0.0, 0.0)
    sx, sy = _point(o.get("scale")) or (1.0, 1.0)
    a, b, c, d = sx * math.cos(turn), -sy * math.sin(turn), sx * math.sin(turn), sy * math.cos(turn)
    return a, b, c, d, at[0] - a * base[0] - b * base[1], at[1] - c * base[0] - d * base[1]


def entity_row(o: dict, names: Names, by: Affine | None = None) -> dict | None:
    """The row of a drawn object, with its points moved; None for kinds that are left out and objects without their points."""
    kind, handle = o.get("entity"), ".".join(map(str, _handle(o.get("handle"))))
    row: dict = {"layer": o["layer"] if isinstance(o.get("layer"), str) else "", "handle": handle, "confidence": 1.0}
    place = _point(o.get("ins_pt"))
    x, y = _moved(place, by) if place else (None, None)
    radius, centre = _number(o.get("radius")), _point(o.get("center"))
    if kind in ("TEXT", "MTEXT"):
        text = _text(o, "text_value", "default_value")
        return row | {"kind": "TEXT", "text": text, "x": x, "y": y, "rotation": _number(o.get("rotation")) or 0.0} if text else None
    if kind == "ATTRIB":
        return row | {"kind": "ATTRIB", "text": _text(o, "text_value", "default_value"), "tag": _text(o, "tag"), "x": x, "y": y, "eed": extended_values(o)}
    if kind == "LINE":
        ends = [_point(o.get("start")), _point(o.get("end"))]
        return row | {"kind": "LINE", "points": [_moved(p, by) for p in ends], "closed": False, "ltype": names.line_type(o)} if all(ends) else None
    if kind == "LWPOLYLINE":
        flag = o.get("flag", o.get("flags", 0))
        pts = _points(o.get("points"))
        return row | {"kind": "LINE", "points": [_moved(p, by) for p in pts], "closed": isinstance(flag, int) and bool(flag & 1), "ltype": names.line_type(o), "eed": extended_values(o)} if pts else None
    if kind in ("CIRCLE", "ARC"):
        if not centre or not radius:
            return None
        cx, cy = _moved(centre, by)
        angles = {"start_angle": _number(o.get("start_angle")) or 0.0, "end_angle": _number(o.get("end_angle")) or 0.0} if kind == "ARC" else {}
        return row | {"kind": kind, "cx": cx, "cy": cy, "radius": radius} | angles
    if kind == "INSERT":
        sx, sy = _point(o.get("scale")) or (1.0, 1.0)
        return row | {"kind": "INSERT", "block_name": names.blocks.get(_tail(_handle(o.get("block_header"))), _text(o, "name")), "ins_x": x, "ins_y": y, "rotation": _number(o.get("rotation")) or 0.0, "scale_x": sx, "scale_y": sy}
    return None


def dump_rows(text: str) -> list[dict]:
    """Entities of a dump in the order: drawn in a space; texts of blocks (confidence 0, block coordinates); expanded blocks.

    Anonymous blocks and those of ``EXPANDED`` are expanded where they are inserted in a space, with the blocks in them
    down to ``DEPTH`` levels.
    """
    objects = [o for o in json.loads(text).get("OBJECTS", []) if isinstance(o, dict)]
    names = Names(objects)
    home = {m: h for h, header in names.headers.items() if header["name"] not in SPACES for m in header["members"]}
    inside: dict[int, list[dict]] = {}
    out, inserts = [], []
    for o in objects:
        if "entity" not in o or o["entity"] in ("BLOCK", "ENDBLK"):
            continue
        block = home.get(_value(o.get("handle")))
        if block is not None:
            inside.setdefault(block, []).append(o)
            continue
        row = entity_row(o, names)
        if row:
            out.append(row)
            if row["kind"] == "INSERT" and row["ins_x"] is not None and (row["block_name"].startswith("*U") or row["block_name"] in EXPANDED):
                inserts.append(o)
    for members in inside.values():
        for o in members:
            row = entity_row(o, names) if o["entity"] in ("TEXT", "MTEXT", "ATTRIB") else None
            if row and row["text"]:
                out.append(row | {"confidence": 0.0})

    def expand(o: dict, by: Affine | None, depth: int) -> None:
        block = _value(o.get("block_header"))
        if depth > DEPTH or block not in inside:
            return
        whole = _composed(by, insertion(o, names.headers[block]["base"]))
        for member in inside[block]:
            if member["entity"] == "INSERT":
                expand(member, whole, depth + 1)
            elif member["entity"] != "ATTDEF" and (row := entity_row(member, names, whole)):
                out.append(row)

    for o in inserts:
        expand(o, None, 0)
    return [{"seq": k, "entity_id": f"dump_{k + 1}", "source": "dwg", "page": 1, **r, **({"points": [{"x": x, "y": y} for x, y in r["points"]]} if "points" in r else {})} for k, r in enumerate(out)]


# --- grouped runs -------------------------------------------------------------------------------------------
def dump_entities(dumps: DataFrame, key: str = "document_hash", content: str = "content") -> DataFrame:
    """Entities of dumps held in a column.  A dump that cannot be read gives one text of confidence 0; a null one nothing."""
    made_as = arrow_schema(schema.ENTITIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    own = dump_rows(text)
                except Exception as error:  # one bad dump must not stop the job
                    own = [{"seq": 0, "entity_id": "error", "source": "dwg", "page": 1, "kind": "TEXT", "text": f"<{type(error).__name__}: {error}>", "confidence": 0.0}]
                rows += [{**r, "document_hash": document} for r in own]
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows, made_as)
                    rows = []
            yield batch_of(rows, made_as)

    return dumps.select(dumps[key].cast("string").alias("key"), dumps[content].alias("content")).mapInArrow(run, schema.ENTITIES)


def read_dumps(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Entities of dump files below a folder, keyed by the files' content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("content")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"document_hash": [hashlib.sha256(c).hexdigest() for c in batch["content"]], "content": [c.decode("utf-8", "replace") for c in batch["content"]]})

    return dump_entities(files.mapInPandas(named, "document_hash string, content string"))
