"""Fixtures of drawings with known outcomes."""

from inklattice.operators import drawing as D
from inklattice.operators import positions as P
from inklattice.operators import tables as B


def line(*pts):
    return {"kind": "LINE", "points": [{"x": float(x), "y": float(y)} for x, y in pts], "closed": False}


def text(t, x, y):
    return {"kind": "TEXT", "text": t, "x": float(x), "y": float(y)}


def box(x, y, w, h):
    return line((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))


def device(x, y, w, h, name="", score=0.95, source="rect"):
    return {"bbox": (float(x), float(y), float(w), float(h)), "name": name, "description": [], "score": score, "source": source}


FRAME = [line((-166, -107), (-166, 200)), line((12, -107), (12, 200))]


def test_rectangles():
    assert D.rectangles([box(0, 0, 100, 50)]) == [((0, 0, 100, 50), "polyline")]
    four = [line((0, 0), (100, 0)), line((100, 0), (100, 50)), line((100, 50), (0, 50)), line((0, 50), (0, 0))]
    assert D.rectangles(four) == [((0, 0, 100, 50), "4seg")]
    assert D.rectangles([line((0, 0), (5, 5), (9, 0), (4, -5), (0, 0))]) == [] and D.rectangles([]) == []


def test_cabinet_from_verticals():
    (cab,) = D.cabinets([*FRAME, text("保护屏 220kV线路A", -77, 210)])
    assert cab["bbox"] == (-166, -107, 178, 307) and cab["name"] == "保护屏 220kV线路A"
    rows = [*FRAME, line((-166, 60), (12, 60)), line((-166, 10), (12, 10)), text("上区", -70, 195), text("低", -70, 170)]
    got = D.areas(rows, D.cabinets(rows)[0]["bbox"])
    assert [(a[0][1], a[1], a[2]) for a in got] == [(-107, "", 0), (10, "", 1), (60, "上区", 2)]
    assert D.areas(FRAME, cab["bbox"]) == [] and D.cabinets([]) == []
    # A device area takes the dividers' place; one as large as the cabinet gives no area.
    inner = (-160.0, -100.0, 160.0, 200.0)
    assert D.areas([*rows, box(*inner)], cab["bbox"]) == [(inner, "", 0)]
    assert D.areas([*rows, box(*cab["bbox"])], cab["bbox"]) == []
    heads, area, others = D.interior(cab["bbox"], [(-160, 180, 160, 10), inner, (-100, 0, 20, 20), (-166, -107, 300, 307)])
    assert (heads, area, others) == ([(-160, 180, 160, 10)], inner, [(-100, 0, 20, 20)])


def test_cabinets_gather_around_the_largest():
    rows = [box(0, 0, 100, 300), box(5, 5, 80, 240), line((0, 0), (0, 300)), line((150, 0), (150, 300)), box(1000, 0, 90, 300), box(5000, 5000, 10, 10)]
    got = D.cabinets(rows)
    assert [(c["bbox"], c["rect"]) for c in got] == [((0, 0, 100, 300), True), ((1000, 0, 90, 300), True)]


def test_layout_tree():
    rows = [*FRAME, line((-166, 40), (12, 40)), *[box(-120, y, 20, 18) for y in range(180 - 18, 50, -25)]]
    rows += [text(f"{2 * k}D", -110, 171 - 25 * (k - 1)) for k in range(1, 6)] + [text("左侧", -80, 200)]
    nodes = D.layout_nodes(rows)
    (group,) = [n for n in nodes if n["type"] == "GROUP"]
    assert group["group_type"] == "VERTICAL_COLUMN" and group["data"]["semantic"] == "TERMINAL_COLUMN" and group["name"] == "左侧"
    parent = next(n for n in nodes if n["node_id"] == group["parent_id"])
    assert parent["type"] == "PANEL_AREA" and [n["name"] for n in nodes if n["parent_id"] == group["node_id"]] == ["2D", "4D", "6D", "8D", "10D"]
    (cab,) = D.physical_cabinets(nodes)
    assert cab["devices"] == 6 and cab["names"] == "10D,2D,4D,6D,8D,左侧"


def test_candidates():
    home = (0.0, 0.0, 200.0, 300.0)
    assert [c["bbox"] for c in D.candidates([box(10, 10, 40, 20)], home)] == [(10, 10, 40, 20)]
    assert [s[1:] for s in D.open_shapes([line((10, 10), (50, 10)), line((50, 10), (50, 40))], home)] == [(0.5, "L_shape")]
    assert [s[1:] for s in D.open_shapes([line((10, 10), (10, 40)), line((10, 10), (40, 10)), line((40, 10), (40, 40))], home)] == [(0.7, "U_shape")]
    (circle,) = D.candidates([{"kind": "CIRCLE", "cx": 50.0, "cy": 50.0, "radius": 8.0}, text("GZ11", 50, 50)], home)
    assert circle["score"] == 0.60 and circle["name"] == "GZ11"
    assert D.candidates([{"kind": "CIRCLE", "cx": 50.0, "cy": 50.0, "radius": 8.0}], home) == []
    kept = D.dedup([device(0, 0, 50, 20), device(5, 2, 40, 16, score=0.5)], [device(100, 100, 20, 20, score=0.6, source="symbol"), device(0, 0, 20, 20, score=0.6)])
    assert [k["bbox"][0] for k in kept] == [0, 100]
    (named,) = D.candidates([box(100, 100, 50, 40), text("DTZ178", 120, 130), text("M1", 120, 138), text("张北I线", 120, 120)], (0.0, 0.0, 400.0, 400.0))
    D.name_devices([named], [(120.0, 130.0, "DTZ178"), (120.0, 138.0, "M1"), (120.0, 120.0, "张北I线")])
    assert named["name"] == "M1" and named["description"] == ["DTZ178", "张北I线"] and D.shown_name(named) == "M1 / DTZ178 / 张北I线"


def test_spine_devices():
    home = (0.0, 0.0, 100.0, 200.0)
    rows = [line((10, 0), (10, 180)), line((40, 25), (40, 115)), *[line((10, y), (40, y)) for y in (30, 50, 70, 200)], text("a", 20, 40), text("b", 20, 60), text("far", 20, 150)]
    assert [(c["bbox"], c["texts"]) for c in D.spine_devices(rows, home, D.words_of(rows))] == [((10, 50, 30, 20), ["b"]), ((10, 30, 30, 20), ["a"])]
    # The far side may lie at the container's edge instead of a vertical.
    edge = [line((40, 0), (40, 180)), *[line((40, y), (100, y)) for y in (30, 50)], text("a", 70, 40)]
    assert [c["bbox"] for c in D.spine_devices(edge, home, D.words_of(edge))] == [(40, 30, 60, 20)]


HOME = (5.0, 0.0, 300.0, 400.0)


def test_groups():
    (column,) = D.groups([device(10, y, 20, 10) for y in range(180, 0, -30)], HOME)
    assert column["type"] == "VERTICAL_COLUMN" and abs(column["score"] - 1.0) < 1e-9 and "left_edge" in column["evidence"]
    assert D.groups([device(0, 0, 20, 10), device(100, 0, 20, 10), device(200, 90, 20, 10)], HOME) == []
    assert D.groups([device(0, 0, 20, 10), device(20, 20, 20, 10)], HOME)[0]["type"] == "FREEFORM"
    assert D.is_grid([(x, y, 5, 5) for x in (0, 10) for y in (0, 10)]) == (2, 2)
    assert D.is_grid([(x, y, 5, 5) for x in (0, 10, 20) for y in (0, 10)][:5]) is None
    assert D.line_score([(10, 0, 5, 5), (40, 0, 5, 5), (70, 0, 5, 5)], 0, HOME)[0] >= 0.4
    assert D.faces([(0, 100, 10, 10), (0, 300, 10, 10)], []) == ["front", "back"]
    assert D.faces([(0, 100, 100, 10), (300, 100, 100, 10)], [(50, 80, "背 面")]) == ["back", "front"]


def test_semantics():
    named = lambda *n: [{"name": x} for x in n]
    assert D.semantics("VERTICAL_COLUMN", []) == ("TERMINAL_COLUMN", 0.20) and D.semantics("FREEFORM", []) == ("UNKNOWN", 0.0)
    assert D.semantics(None, named("2D", "4D", "6D")) == ("TERMINAL_COLUMN", 0.40) and D.semantics(None, named("DTZ1", "DTZ2")) == ("METER_GROUP", 0.30)
    assert D.semantics("VERTICAL_COLUMN", [{"name": n, "category": "TERMINAL"} for n in ("2D", "4D", "6D")]) == ("TERMINAL_COLUMN", 0.80)
    label, score = D.semantics("GRID", [], {"model": "DTZ178", "description": "电能表"})
    assert label == "METER_GROUP" and score == 0.40
    assert D.device_category("DTZ-1") == ("METER", 0.3) and D.device_category("zkz1", "FUSE_BLOCK") == ("MODULE", 0.4) and D.device_category("", "", "") == ("UNKNOWN", 0)
    assert D.device_category("q", "", "1d9") == ("TERMINAL", 0.1)


def words(*cells):
    return [text(t, x, y) for x, y, t in cells]


def test_equipment_table():
    head = [(x, 100, t) for x, t in ((0, "序号"), (30, "名称"), (60, "型号"), (90, "数量"))]
    body = [(x, 90 - 10 * k, t) for k, n in enumerate(("M1-设备", "M2-设备", "DH1-设备")) for x, t in ((0, str(k)), (30, n), (60, "DTZ178"), (90, "1"))]
    noise = [(30, 50, "abc"), (30, 40, "KKS-1"), (-40, 80, "左")]
    table = B.equipment_table(words(*head, *body, *noise), (-50.0, 0.0, 300.0, 200.0))
    assert table["header"] == ["序号", "名称", "型号", "数量"] and table["columns"] == {"index": 0, "name": 1, "model": 2, "qty": 3}
    assert [r[1] for r in table["rows"]] == ["M1-设备", "M2-设备", "DH1-设备"] and table["rows"][0] == ["0", "M1-设备", "DTZ178", "1"]
    # A column that was passed by takes no more; far texts to the left of the first column are left out.
    assert B.dealt_to_columns([(62, "c"), (33, "b"), (-30, "x")], [0, 30, 60, 90]) == ["", "b", "c", ""]
    assert B.dealt_to_columns([(30, "b"), (31, "b2")], [0, 30, 60]) == ["", "b", "b2"]
    assert B.equipment_table(words((0, 1, "a"), (0, 50, "b")), (-9.0, -9.0, 99.0, 99.0)) is None
    met = B.match_devices(table, ["M1-设备", "M2-设备 x", "M2-设备2", "DH1-设备"])
    assert set(met) == {0, 1, 3} and met[0] == {"model": "DTZ178", "qty": "1"} and B.match_devices(table, ["Q"]) == {}
    assert B.text_rows([(0.0, 100.0, "a"), (0.0, 50.0, "b")], 5)[0] == [(0.0, "a")] and B.text_rows([(0.0, 1.0, "a")], 5) == []
    assert [round(y / 5) for y in (2.5, 7.5, 12.5)] == [0, 2, 2]
    titled = [*words((60, 120, "设备表"), *[(x + 0, y, t) for x, y, t in [*head, *body[:8]]])]
    assert B.cabinet_table(titled, (0.0, 60.0, 100.0, 200.0))["columns"]["name"] == 1
    assert B.cabinet_table(words((60, 120, "电能表")), (0.0, 60.0, 100.0, 200.0)) is None


def test_table_regions():
    grid = [box(20 * i, 20 * j, 18, 18) for i in range(4) for j in range(3)]
    texts = [text(f"t{k}", 5 + 20 * (k % 4), 5 + 20 * (k // 4)) for k in range(6)]
    ((found, sure),) = B.table_regions([*grid, *texts])
    assert found == (0, 0, 78, 58) and sure == 0.9
    assert B.table_clusters([*grid[:5], *texts]) == []
    frame = box(-10, -10, 120, 100)
    assert [r[1] for r in B.table_regions([frame, *texts, text("用途表", 300, 300)])] == [0.6, 0.4]
    assert B.table_rects([box(0, 0, 100, 60), *texts], None, (60.0, 50.0)) == [(0, 0, 100, 60)] and B.table_rects([box(0, 0, 100, 60), *texts]) == []
    assert B.label_rows([(0.0, 10.0, "2F"), (0.0, 20.0, "1F"), (5.0, 15.0, "b"), (9.0, 11.0, "c")], r"\d+[CF]", 5.0) == [[(0.0, "1F"), (5.0, "b")], [(0.0, "2F"), (9.0, "c")]]
    assert B.dbscan([(0.0, 0.0), (30.0, 0.0), (61.0, 0.0), (-29.0, 0.0)], 30.0, 2) == [0, 0, -1, 0]


def test_schedule():
    rows = words(*[(x, 100, t) for x, t in ((0, "电缆编号"), (40, "起点"), (80, "终点"), (120, "芯数"))], (0, 90, "GY6-136"), (40, 90, "9D"), (80, 90, "X2:1"), (120, 90, "4"))
    (got,) = B.schedule_records(rows)
    assert got == {"cable_id": "GY6-136", "strip_name": "9D", "terminal_no_remote": "X2:1", "conductor_no": 4, "source_type": "cable_schedule"}
    assert [r["cable_id"] for r in B.schedule_records(words((0, 0, "ZL-2 and ZL-1"), (0, 9, "ZL-2")))] == ["ZL-1", "ZL-2"] and B.schedule_records([]) == []


def usage_table():
    head = [(x, 100, t) for x, t in ((0, "屏号"), (30, "名称"), (60, "数量"), (90, "备注"))]
    return words((45, 130, "用途表"), *head, (0, 80, "1F"), (30, 82, "励磁柜"), (60, 79, "1"), (90, 80, "备"), (0, 50, "2C"), (30, 50, "调节柜"), (60, 50, "1"))


def test_usage():
    usage = B.usage_rows(usage_table())
    assert [(u["cell_label"], u["equipment"], u["qty"], u["remark"]) for u in usage] == [("1F", "励磁柜", 1, "备"), ("2C", "调节柜", 1, "")]
    assert B.usage_rows(words((0, 80, "1F"))) == []
    assert [c["equipment"] for c in P.cross_reference([{"label": "1F", "equipment": ""}, {"label": "9F", "equipment": ""}], usage)] == ["励磁柜", ""]
    assert B.gap_between([(0, "a"), (10, "b"), (30, "c")], {0: "cell_label", 2: "cell_label"}) == 20


def test_material():
    rows = words((100, 100, "设备材料表"), *[(x, 80, t) for x, t in ((0, "序号"), (40, "名称"), (100, "单位"), (150, "数量"))], (0, 70, "1"), (40, 70, "电缆"), (100, 70, "米"), (150, 70, "12"), (40, 60, "Q"), (0, 50, "9"))
    assert B.material_rows(rows) == [{"index": "1", "name": "电缆", "unit": "米", "qty": 12, "remark": ""}]


def plan():
    rows = [line((-350, -14), (-300, -14)), line((-350, 14), (-300, 14)), line((-350, -14), (-350, 40))]
    rows += [box(-340 + 12 * (k % 2), -12 + 10 * (k // 2), 10, 5) for k in range(4)]
    return rows + [text(f"{k + 1}F", -335 + 12 * (k % 2), -9.5 + 10 * (k // 2)) for k in range(4)] + [text("ABC", 0, 0), text("12G", 5, 5)]


def test_positions():
    place, lines = P.position_cells(plan())
    assert place == (-350, -14, 50, 28)
    assert [(c["label"], c["row"], c["col"]) for line_ in lines for c in line_] == [("3F", 0, 0), ("4F", 0, 1), ("1F", 1, 0), ("2F", 1, 1)]
    # Cells without a label stay; without long lines there is no room.
    bare = [r for r in plan() if r.get("text") != "3F"]
    assert [c["label"] for line_ in P.position_cells(bare)[1] for c in line_] == ["", "4F", "1F", "2F"]
    assert P.position_cells(plan()[3:]) == (None, [])
    kinds = [n["type"] for n in P.position_nodes(plan())]
    assert kinds == ["ROOM", "POSITION_ROW", "POSITION_CELL", "POSITION_CELL", "POSITION_ROW", "POSITION_CELL", "POSITION_CELL"]
    crowd = [(float(x), 0.0, "1F") for x in (0, 10, 200, 210, 220)] + [(400.0 + k, float(k), "2F") for k in range(7)]
    assert len(P.densest(crowd)) == 7


def test_grouped_runs(spark):
    from inklattice import schema

    names = [p.strip().split(" ")[0] for p in "document_hash seq kind x y text points".split(" ")]
    rows = []
    for doc in ("a", "b", "c"):
        for k, e in enumerate([*FRAME, text("1柜", -77, 210), *([box(-120, 150, 20, 18), text("2D", -110, 159), box(-80, 100, 20, 18), text("3D", -70, 109)] if doc == "a" else []), *([{"kind": "LINE", "points": []}] if doc == "c" else [])]):
            rows.append(tuple({"document_hash": doc, "seq": k, **e}.get(n) for n in names))
    df = spark.createDataFrame(rows, "document_hash string, seq long, kind string, x double, y double, text string, points array<struct<x:double,y:double>>")
    df = df.unionByName(spark.createDataFrame([], schema.ENTITIES), allowMissingColumns=True)
    got = D.scan_layout(df).collect()
    assert {(r.document_hash, r.type, r.name) for r in got} == {("a", "CABINET", "1柜"), ("a", "DEVICE", "2D"), ("a", "DEVICE", "3D"), ("b", "CABINET", "1柜"), ("c", "CABINET", "1柜")}
    assert all(r.error is None for r in got)
    assert [r.cable_id for r in P.scan_schedules(df).collect()] == [] and P.scan_positions(df).collect() == []


def test_any_error_stays_in_its_document(spark):
    from inklattice.operators.grouped import per_document

    def run(rows):
        if rows[0]["v"] == 2:
            return [][1]
        return [{"n": len(rows)}]

    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3)], "document_hash string, seq long, v int")
    got = {r.document_hash: (r.n, r.error) for r in per_document(df, run, "document_hash string, n int, error string").collect()}
    assert got["a"] == (1, None) and got["c"] == (1, None) and got["b"][0] is None and got["b"][1].startswith("IndexError")
