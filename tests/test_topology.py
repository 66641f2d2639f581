from inklattice.operators import topology as T


def line(*pts, **more):
    return {"kind": "LINE", "points": [{"x": float(x), "y": float(y)} for x, y in pts], **more}


def attrib(tag, text, x, y):
    return {"kind": "ATTRIB", "tag": tag, "text": text, "x": float(x), "y": float(y)}


def text(t, x, y):
    return {"kind": "TEXT", "text": t, "x": float(x), "y": float(y)}


def circle(x, y, r=1.0):
    return {"kind": "CIRCLE", "cx": float(x), "cy": float(y), "radius": r}


def test_strip():
    rows = [
        line((0, 0), (50, 0), eed=["x", "GY6-136(4)"]), line((0, 500), (50, 500), eed=["GY6-136"]), line((10, 0), (10, -30), eed=["GY6-136"]), line((30, 40), (30, 0), eed=["GY6-136"]),
        line((20, 0), (20, -19), eed=["GY6-136"]), line((40, 0), (40, -30)), line((45, 0), (45, -30), eed=["AB-1"]),
        attrib("NO", "x", 10, 0), attrib("no", "1", 10, 5), attrib("EQUNAME", "左柜", -50, 3), attrib("EQUNAME", "右柜", 90, -9), attrib("EQUNAME", "far", 99, 11),
        text("12", 10, -32), text("7", 10, -34), text("AB-101", 10, -36), text("跳闸", 10, -40), text("**", 10, -44), text("behind", 10, -20), text("1", -5, -32), text("1D", -20, -32), text("9X", -20, 20), text("1号端子排图", 0, 90),
    ]
    down, up = T.strip_records(rows)
    assert (down["cable_id"], down["conductor_no"], down["terminal_no"], down["loop_id"], down["circuit_desc"], down["strip_name"]) == ("GY6-136", 1, 12, "AB-101", "跳闸", "1D")
    assert (down["cabinet_name"], down["cabinet_name_remote"], down["source_type"]) == ("1号", "右柜", "terminal_strip")
    assert (up["terminal_no"], up["strip_name"], up["conductor_no"]) == (None, None, None)
    assert T.column_roles(["5", "6", "A1", "B2", "C3", "D4"]) == {"terminal_no": "5", "loop_id": "A1", "circuit_desc": "B2", "unknown": "C3"}
    assert T.column_roles(["**", "++", "x"]) == {"terminal_no": None, "loop_id": None, "circuit_desc": "++", "unknown": "**"}


def loop(*more):
    return [attrib("WireSerial", "ZL-307ZF(1)", 50, 2), line((0, 0), (100, 0)), circle(0, 0), circle(100, 0), attrib("NO", "9D:1", -3, 2), attrib("WireDescription", "合闸", 50, 8), *more]


def test_circuit_loop():
    (r,) = T.loop_records(loop(attrib("NO", "X2:1", 103, 2), attrib("LoopCode", "A101", 50, 20), attrib("WireSerial", "ZL-307ZF(1)", 50, 900)))
    assert (r["cable_id"], r["conductor_no"], r["strip_name"], r["terminal_no"], r["terminal_no_remote"], r["circuit_desc"], r["loop_id"]) == ("ZL-307ZF", 1, "9D", 1, "X2:1", "合闸", "A101")
    (r,) = T.loop_records(loop())
    assert r["terminal_no_remote"] == "" and r["wire_type"] is None
    (r,) = T.loop_records([attrib("WireSerial", "ZL-307ZF(2)", 50, 2)])
    assert r["terminal_no_remote"] is None and r["strip_name"] is None
    # One terminal for both sides of a short stub: the remote one goes.
    (r,) = T.loop_records([attrib("WireSerial", "ZL-1A(1)", 3, 1), line((0, 0), (6, 0)), attrib("NO", "9D:7", 3, 2)])
    assert (r["strip_name"], r["terminal_no"], r["terminal_no_remote"]) == ("9D", 7, None)
    # Cabinets settle once for a cable; a wire's type is that nearest to its code.
    more = [text("甲柜", 0, 60), text("站", -30, 61), attrib("NO", "X2:1", 103, 2), attrib("WireSerial", "ZL-307ZF(2)", 50, -98), line((0, -100), (100, -100)), circle(0, -100), attrib("WIRECODE", "ZL-307ZF", 40, 30), attrib("WIRETYPE", "KVV 4x1.5", 45, 33), attrib("WIRETYPE", "other", 80, 33)]
    first, second = T.loop_records(loop(*more))
    assert first["cabinet_name"] == second["cabinet_name"] == "站-甲柜" and first["wire_type"] == "KVV 4x1.5" and (first["conductor_no"], second["conductor_no"]) == (1, 2)


def test_loop_inside_cabinets():
    left = line((-20, -50), (20, -50), (20, 50), (-20, 50), (-20, -50), ltype="HIDDEN", handle="h1")
    rows = loop(left, text("A柜", 0, 60), attrib("NO", "X2:1", 103, 2), attrib("NO", "8D:4", 25, 0), attrib("TERNO", "", 5, 5), attrib("BL", "q", 300, 0), attrib("NO", "9D:9", 0, 9))
    regions = T.cabinet_regions(rows)
    (r,) = T.loop_records(rows)
    assert (r["cabinet_name"], r["cabinet_name_remote"]) == ("A柜", "A柜") or r["cabinet_name"] == "A柜"
    got = {(t["terminal_id"], t["kind"]) for t in T.cabinet_terminals(rows, regions, [r])}
    assert got == {("9D:1", "NO"), ("ICON_TERNO@5_5", "TERNO")}


def test_graph():
    g = T.Graph([line((0, 0), (50, 0), (50, 40)), line((50.2, 0.1), (90, 0)), circle(25, 0.5), line((0, 0), (30, 30))])
    c = next(iter(g.circles))
    (split,) = [n for n, _ in g.near[c]]
    assert g.at[split] == (25, 0) and len(g.near[split]) == 3
    path, cost, why = g.trace(0, lambda n: g.at[n][0] > 80)
    assert why == "VISITOR_STOP" and path[0] == 0 and abs(cost - 90) < 1
    assert g.trace(0, lambda n: False)[2] == "DEAD_END"
    assert g.at[g.walk(0, 1)] == (90, 0)  # neither the circle above nor the branch up lies further right
    assert g.wire_near(70, 5) is not None and g.wire_near(70, 500) is None
    ring = T.Graph([line((0, 0), (100, 0)), circle(100.5, 0)])
    assert ring.walk(0, 1) in ring.circles
    box = T.Graph([line((0, 0), (100, 0)), line((0, 5), (60, 5))], [(0.0, 0.0, 100.0, 50.0)])
    assert len(box.edges) == 1


def test_regions():
    dashed = line((0, 0), (100, 0), (100, 200), (0, 200), (0, 0), ltype="Dashed")
    (c,) = T.cabinet_regions([{"document_hash": "0123456789abcdef", **dashed}, text("保护柜", 40, 220), text("1号室", -60, 220.1), text("备用柜标签", 50, -30), text("无关", 50, -10), line((0, 0), (5, 0), (5, 5), (0, 5), ltype="DASHED")])
    assert (c["id"], c["name"], c["location"], c["display_name"], c["text_label"]) == ("cab_0123456789ab_001", "保护柜", "1号室", "1号室-保护柜", "备用柜标签")
    # Texts of one row: the nearer to the middle; a short code gives way to the label below.
    (c,) = T.cabinet_regions([dashed, text("甲柜", 0, 220), text("乙柜", 45, 222)])
    assert c["name"] == "乙柜" and c["id"] == "cab_doc_001"
    (c,) = T.cabinet_regions([dashed, text("P1", 50, 210), text("丙屏柜", 50, -30)])
    assert (c["name"], c["text_label"]) == ("丙屏柜", "")
    (c,) = T.cabinet_regions([dashed, text("丙屏柜", 50, -30)])
    assert (c["name"], c["text_label"]) == ("丙屏柜", "丙屏柜")
    # Four segments count if they are not drawn head to tail.
    ends = [((0, 0), (9, 0)), ((9, 0), (9, 20)), ((9, 20), (0, 20)), ((0, 0), (0, 20))]
    chain = [line(a, b, ltype="DOT") for a, b in ends]
    assert [(c["x"], c["w"], c["h"]) for c in T.cabinet_regions(chain)] == [(0, 9, 20)] or T.cabinet_regions(chain) == []
    assert T.cabinet_regions([line((0, 0), (9, 0), ltype="DOT"), line((9, 0), (9, 20), ltype="DOT"), line((9, 20), (0, 20), ltype="DOT"), line((0, 20), (0, 0), ltype="DOT")]) == []


def test_small_parts():
    assert T.wire_types([(0, 0, "a"), (500, 0, "b")], [(10, 0, "T1"), (30, 0, "T2")]) == {"a": "T1", "b": None}
    assert T.find_cabinet(0, 0, [(5, 50, "柜"), (-20, 51, "L"), (1, -9, "屏")]) == "L-柜"
    assert T.cable_of(["", None, "q", "GY6-1x"]) == "GY6-1x"


def test_grouped(spark):
    from inklattice import schema

    rows = [("d", k, e["kind"], e.get("x"), e.get("y"), e.get("text"), e.get("tag"), e.get("points"), e.get("cx"), e.get("cy"), e.get("radius")) for k, e in enumerate(loop(attrib("NO", "X2:1", 103, 2)))]
    df = spark.createDataFrame(rows, "document_hash string, seq long, kind string, x double, y double, text string, tag string, points array<struct<x:double,y:double>>, cx double, cy double, radius double")
    df = df.unionByName(spark.createDataFrame([], schema.ENTITIES), allowMissingColumns=True)
    (r,) = T.scan_topology(df).collect()
    assert (r.cable_id, r.terminal_no, r.terminal_no_remote, r.error) == ("ZL-307ZF", 1, "X2:1", None)
    assert T.scan_cabinet_regions(df).collect() == []


def test_wire_of_a_core_is_looked_up_once(monkeypatch):
    """Both sides start from one wire; a core without any near it has no terminals."""
    from inklattice.operators import topology

    asked, near = [], topology.Graph.wire_near
    monkeypatch.setattr(topology.Graph, "wire_near", lambda self, *a, **k: asked.append(a) or near(self, *a, **k))
    rows = [{"kind": "LINE", "points": [{"x": 100.0, "y": 0.0}, {"x": 300.0, "y": 0.0}]}]
    rows += [{"kind": "CIRCLE", "cx": x, "cy": 0.0} for x in (100.0, 300.0)]
    rows += [{"kind": "ATTRIB", "tag": tag, "x": x, "y": y, "text": t} for tag, x, y, t in (("NO", 97.0, 2.0, "X1:7"), ("ObjTerm.Name", 303.0, 2.0, "Y2:3"), ("WireSerial", 200.0, 2.0, "OR-1(1)"), ("WireSerial", 200.0, -500.0, "OR-1(2)"))]
    got = {r["conductor_no"]: (r["strip_name"], r["terminal_no"], r["terminal_no_remote"]) for r in topology.loop_records(rows)}
    assert got == {1: ("X1", 7, "Y2:3"), 2: (None, None, None)} and len(asked) == 2


def test_crowded_drawings_are_looked_at_near_their_texts_only(monkeypatch):
    """Wires, names and terminals are as a look at everything gives them, without that look."""
    import random
    from types import SimpleNamespace

    rng = random.Random(1)
    place = lambda: (rng.randrange(-960, 960) / 16, rng.randrange(-960, 960) / 16)
    rows = []
    for k in range(1200):
        x, y = place()
        rows += [line((x, y), (x + 5 + k % 7, y), (x + 5 + k % 7, y + 4), ltype=None), text(f"{k % 12}D", *place())]
        if k % 40 == 0:
            rows += [line((x, y), (x + 9, y), (x + 9, y + 9), (x, y + 9), (x, y), ltype="DASHED"), attrib("WireSerial", f"ZL-{k}(1)", *place())]
    graph, seen = T.Graph(rows), []

    class Seen(list):
        def __getitem__(self, k):
            seen.append(k)
            return list.__getitem__(self, k)

    every = list(graph.levels.things)
    graph.levels.things = Seen(every)
    asked = [place() for _ in range(50)]
    for x, y in asked:
        for tags in (None, [(x + 3, y), (x - 30, y + 9)]):
            cost = lambda s: abs(s[0] - y) + 0.1 * max(s[1] - x, x - s[2], 0.0) - (3 if any(s[1] <= tx <= s[2] and abs(ty - s[0]) < 40 for tx, ty in tags or ()) else 0)  # noqa: B023, E731
            best = min((s for s in every if abs(s[0] - y) <= 30), key=cost)
            a, b = best[3:]
            assert graph.wire_near(x, y, tags=tags) == min(a, b, key=lambda n: (T.hypot(graph.at[n][0] - x, graph.at[n][1] - y), n != a))  # noqa: B023
    assert len(seen) < 100 * len(every) / 8

    held: list[str] = []
    pattern = T.SHORT
    monkeypatch.setattr(T, "SHORT", SimpleNamespace(match=lambda t: held.append(t) or pattern.match(t)))
    regions, words = T.cabinet_regions(rows), T.words_of(rows)
    assert len(regions) == 30 and len(held) == len(words)
    for r in regions:
        top, middle, high, off, name = r["y"] + r["h"], r["x"] + r["w"] / 2, 1e9, 1e9, ""
        for x, y, t in words:
            dy, dx = y - top, abs(x - middle)
            if r["x"] - 50 <= x <= r["x"] + r["w"] + 80 and 0 < dy <= 60 and pattern.match(t) and (dy < high - 3 or (abs(dy - high) <= 3 and dx < off)):
                high, off, name = dy, dx, t
        assert r["name"] == name

    # No circle, or none with a terminal: no core's wire is followed to look for one.
    monkeypatch.setattr(T.Graph, "reach", lambda *_: 1 / 0)
    assert len(T.loop_records(rows, regions)) == 30
    ring = T.Graph([line((0, 0), (9, 0)), line((9, 0), (20, 0)), line((50, 0), (60, 0)), circle(20, 0)])
    assert [len(ring.circles_joined(n)) for n in range(len(ring.at))] == [1, 1, 1, 0, 0, 1]
