from pyspark.sql import functions as F

from inklattice.functions import text as T
from inklattice.operators import classify, matching, spatial, store
from inklattice.sources import entities, sinks


def test_tiers_and_variants(spark):
    variants = spark.sql("SELECT '3B-0' AS t").select(T.confusion_variants(F.col("t")).alias("v")).first().v
    assert set(variants) == {"8B-0", "JB-0", "38-0", "3B_0", "3B.0", "3B 0", "3B0", "3B-O", "3B-Q"}
    targets = spark.createDataFrame([("GY6-136",), ("AB-1",)], "target string")
    texts = spark.createDataFrame([("d1", "see GY6-136 now"), ("d2", "xgy6_136"), ("d3", "GY6-I36"), ("d4", "GY6-1367"), ("d5", "none"), ("d6", "G6-136"), ("d7", "a gy6 136 b"), ("d8", "GY6 136"), ("d9", None)], "doc string, text string")
    got = {r.doc: r.match_type for r in matching.tiered(targets, texts, fuzzy=True).collect()}
    assert got == {"d1": "exact", "d2": "normalized", "d3": "confusion", "d4": "exact", "d6": "levenshtein", "d7": "normalized", "d8": "normalized"}
    assert matching.tiered(targets.limit(0), texts).collect() == [] and matching.tiered(targets, texts.limit(0)).collect() == []
    short = spark.createDataFrame([("ab",), ("b",), ("",)], "k string")
    assert sorted((r.k, r.doc) for r in matching.containing(short, spark.createDataFrame([(1, "xabx"), (2, "b"), (3, "")], "doc int, text string")).collect()) == [("ab", 1), ("b", 1), ("b", 2)]


def test_best_of_stages(spark):
    s1 = spark.createDataFrame([("c", "h", "confusion", 1), ("e", "h", "", 2)], "cable string, hash string, match_type string, row_ix int")
    s2 = spark.createDataFrame([("c", "h", "exact", 1), ("e", "h", "odd", 2)], s1.schema)
    got = {r.cable: (r.match_type, r.stage) for r in matching.best_of_stages([s1, s2], ["cable", "hash"]).collect()}
    assert got == {"c": ("exact", 2), "e": ("", 1)}
    assert matching.stage_filter("1-3", 4) == [1, 2, 3] and matching.stage_filter("all", 2) == [1, 2] and matching.stage_filter("3,1,3", 4) == [3, 1]


def test_fill_null(spark):
    rows = spark.createDataFrame([("s", 1, None, "d1"), ("s", 2, "v", "d2"), ("s", 3, "w", "d3")], "strip string, seq int, name string, doc string")
    assert store.first_write_fills(rows, "strip", ["seq"], ["name"]).first().asDict() == {"strip": "s", "seq": 1, "name": "v", "doc": "d1"}


def test_edges_are_inclusive(spark):
    p = spark.createDataFrame([("d", 1, 10.0, 5.0), ("d", 2, 10.1, 5.0)], "doc string, seq int, x double, y double")
    b = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 2, 5.0, 0.0, 100.0, 100.0)], "doc string, box int, b_x double, b_y double, b_w double, b_h double")
    assert sorted((r.seq, r.box) for r in spatial.points_in_boxes(p, b).collect()) == [(1, 1), (1, 2), (2, 2)]
    line = spark.createDataFrame([("d", k, 10.0, 30.0 * k) for k in range(6)] + [("d", 9, 500.0, 0.0)], "doc string, seq int, x double, y double")
    assert {(r.seq, r.cluster) for r in spatial.clusters(line, 30.0).collect()} == {(k, 0) for k in range(6)}


def test_classes(spark):
    texts = spark.createDataFrame([("a", "端子排图", None), ("b", "产品说明书", None), ("c", "nothing", None), ("d", "WIRENO", "WIRENO")], "document_hash string, text string, tag string")
    got = {r.document_hash: (r.primary, r.confidence) for r in classify.combine(classify.keyword_scores(texts)).collect()}
    assert got["a"][0] == "terminal_strip" and got["c"] == ("unknown", 0.0) and got["d"][0] == "circuit_loop"


def test_marks_override(spark):
    texts = spark.createDataFrame([("b", "产品说明书"), ("b", "回路图"), ("b", "屏柜"), ("p", "保护屏位图"), ("p", "保护"), ("p", "差动"), ("q", "保护 测控")], "document_hash string, text string")
    got = {r.document_hash: r for r in classify.combine(classify.keyword_scores(texts), marks=classify.text_marks(texts)).collect()}
    assert (got["b"].primary, got["b"].confidence) == ("manufacturer_catalog", 1.0) and "circuit_loop" not in got["b"].secondary
    assert got["p"].primary == "panel_position" and "protection_diagram" in got["p"].secondary + [got["p"].primary]
    assert got["q"].primary == "protection_diagram" and set(got["q"].signals) == set(classify.TYPES)


def test_documents_are_classified_from_their_entities(spark):
    from inklattice import schema

    rows = [("a", k, "TEXT", float(k), 0.0, "端子排图" if k == 1 else "x") for k in range(3)] + [("b", 0, "LINE", None, None, None)]
    df = spark.createDataFrame([], schema.ENTITIES).unionByName(spark.createDataFrame(rows, "document_hash string, seq long, kind string, x double, y double, text string"), allowMissingColumns=True)
    got = {r.document_hash: r.primary for r in classify.classify_documents(df).collect()}
    assert got == {"a": "terminal_strip", "b": "unknown"}


DXF = "0\nSECTION\n2\nENTITIES\n0\nLINE\n5\nA1\n8\nL\n10\n0\n20\n0\n11\n5\n21\n0\n0\nTEXT\n10\n1\n20\n2\n1\n1D\n0\nLWPOLYLINE\n70\n1\n10\n0\n20\n0\n10\n4\n20\n0\n10\n4\n20\n3\n0\nCIRCLE\n10\n1\n20\n1\n40\n2\n0\nENDSEC\n0\nEOF\n"


def test_dxf(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DXF)
    rows = sorted(entities.read_dxf(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [r.kind for r in rows] == ["LINE", "TEXT", "LINE", "CIRCLE"]
    assert rows[0].entity_id == "A1" and rows[1].text == "1D" and rows[2].closed and len(rows[2].points) == 3 and rows[3].radius == 2.0
    assert [r.suffix for r in entities.discover(spark, str(tmp_path)).collect()] == [".dxf"]


RICH = [
    (0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER"), (0, "LAYER"), (2, "W"), (6, "HIDDEN"), (0, "ENDTAB"), (0, "ENDSEC"),
    (0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "b"), (10, 1), (20, 0), (0, "LINE"), (8, "W"), (10, 1), (20, 0), (11, 3), (21, 0), (0, "CIRCLE"), (10, 2), (20, 0), (40, 1), (0, "ATTDEF"), (1, "x"), (0, "ENDBLK"), (0, "ENDSEC"),
    (0, "SECTION"), (2, "ENTITIES"), (0, "LINE"), (5, "A"), (8, "W"), (10, 0), (20, 0), (11, 5), (21, 0), (1001, "Cable"), (1000, "C-1"), (1001, "Other"), (1000, "no"),
    (0, "MTEXT"), (10, 1), (20, 1), (3, "{\\\\fArial|b0;up"), (1, "per}\\\\Plow \\\\M+5B9F1"), (0, "INSERT"), (5, "I"), (8, "W"), (2, "b"), (10, 10), (20, 0), (41, 2), (42, 2), (50, 90), (66, 1), (0, "ATTRIB"), (2, "NO"), (1, "X:1"), (10, 11), (20, 2), (0, "ATTRIB"), (2, "E"), (1, " "), (0, "SEQEND"),
    (0, "ARC"), (10, 0), (20, 0), (40, 3), (50, 0), (51, 90), (0, "ENDSEC"), (0, "EOF"),
]


def test_rich_dxf():
    from inklattice.sources.dxf import dxf_entities

    text = "\n".join(f"{c}\n{v}" for c, v in RICH).replace("\\\\", "\\")
    rows = dxf_entities(text, "d")
    assert [r["kind"] for r in rows] == ["LINE", "TEXT", "ATTRIB", "LINE", "CIRCLE", "INSERT", "ARC"]
    assert rows[0]["ltype"] == "HIDDEN" and rows[0]["eed"] == ["C-1"] and rows[1]["text"] == "upper\nlow 柜"
    assert rows[2]["entity_id"] == "I__NO" and [(round(p["x"], 6), round(p["y"], 6)) for p in rows[3]["points"]] == [(10, 0), (10, 4)] and rows[3]["ltype"] == "HIDDEN"
    assert (round(rows[4]["cx"], 6), round(rows[4]["cy"], 6), rows[4]["radius"]) == (10, 2, 2.0) and rows[5]["rotation"] == 90.0
    plain = dxf_entities(text, "d", full=False)
    assert [r["kind"] for r in plain] == ["LINE", "TEXT", "ATTRIB", "INSERT"] and "ltype" not in plain[0]


def test_blocks(spark):
    ins = spark.createDataFrame([("d", 1, "b", 10.0, 0.0, 90.0, 2.0, 2.0)], "document_hash string, seq int, block_name string, ins_x double, ins_y double, rotation double, scale_x double, scale_y double")
    mem = spark.createDataFrame([("b", "TEXT", 1.0, 0.0, "t", None, 0.0, 0.0), ("b", "INSERT", 0.0, 0.0, None, "in", 0.0, 0.0), ("in", "TEXT", 0.0, 1.0, "u", None, 0.0, 0.0)], "block_name string, kind string, mx double, my double, text string, child string, base_x double, base_y double")
    got = {r.text: (round(r.x, 6), round(r.y, 6)) for r in entities.expand_blocks(ins, mem).collect()}
    assert got == {"t": (10.0, 2.0), "u": (8.0, 0.0)}
    turned = mem.withColumn("scale_x", F.when(F.col("child") == "in", 3.0)).withColumn("scale_y", F.when(F.col("child") == "in", 5.0)).withColumn("rotation", F.when(F.col("child") == "in", 90.0))
    got = {r.text: (round(r.x, 6), round(r.y, 6)) for r in entities.expand_blocks(ins, turned).collect()}
    assert got == {"t": (10.0, 2.0), "u": (10.0, -10.0)}


def test_tree_and_targets(spark):
    nodes = spark.createDataFrame([("d", "r", None, 0, 0, "ROOM", 'a "q"'), ("d", "c2", "r", 2, 1, "CELL", "y"), ("d", "c1", "r", 1, 1, "CELL", "x")], "document_hash string, node_id string, parent_id string, ord int, depth int, type string, name string")
    import json

    (root,) = json.loads(sinks.tree_json(nodes).first().tree_json)
    assert root["name"] == 'a "q"' and [c["id"] for c in root["children"]] == ["c1", "c2"]
    files = spark.createDataFrame([("p1", "a.pdf"), ("p2", "a.pdf"), ("p3", "b")], "path string, name string")
    assert sorted(r.target for r in sinks.unique_targets(files).collect()) == ["a.pdf", "a_1.pdf", "b"]


def test_incremental(spark, tmp_path):
    from inklattice.streaming.incremental import scan_stream

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "document_hash string, v int"
    for batch in ([("a", 1), ("a", 2), ("b", 1)], [("a", 9)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        scan_stream(spark, src, schema, out, ck).awaitTermination()
    assert sorted((r.document_hash, r.v) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 1)]
    # A document of which a batch leaves nothing loses its old rows.
    for batch in ([("a", -1), ("c", 4)],):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        scan_stream(spark, src, schema, out, ck, lambda df: df.filter("v > 0")).awaitTermination()
    assert sorted((r.document_hash, r.v) for r in spark.read.parquet(out).collect()) == [("b", 1), ("c", 4)]


def test_dumps(spark, tmp_path):
    from inklattice.sources import dump

    objects = [
        {"object": "BLOCK_CONTROL", "entries": [[2, 1, 50]]}, {"entity": "BLOCK", "name": "CT1", "handle": [0, 1, 9]}, {"object": "BLOCK_HEADER", "name": "CT1", "handle": [0, 1, 50], "entities": [[3, 1, 60], [3, 1, 61]], "base_pt": [1, 0, 0]},
        {"entity": "LWPOLYLINE", "handle": [0, 1, 1], "points": [[0, 0], [1, 0], [1, 1]], "flag": 1, "eed": [{"code": 0, "value": " C-1 "}, {"value": 3}, {"value": [{"value": "in"}]}], "ltype": [5, 1, 8], "ltype_flags": 1},
        {"entity": "INSERT", "handle": [0, 1, 2], "block_header": [5, 1, 50], "ins_pt": [10, 0], "rotation": 3.141592653589793}, {"entity": "ARC", "handle": [0, 1, 3], "center": [0, 0], "radius": 2, "start_angle": 1},
        {"entity": "LINE", "handle": [0, 1, 60], "start": [1, 0], "end": [3, 0]}, {"entity": "ATTRIB", "handle": [0, 1, 61], "tag": "NO", "text_value": "", "ins_pt": [1, 1]}, {"entity": "TEXT", "handle": [0, 1, 62], "text_value": " "}, {"entity": "CIRCLE", "handle": [0, 1, 63]}, 7,
    ]
    import json

    rows = dump.dump_rows(json.dumps({"OBJECTS": objects}))
    assert [r["kind"] for r in rows] == ["LINE", "INSERT", "ARC", "LINE", "ATTRIB"] and rows[0]["closed"] and rows[0]["eed"] == ["C-1", "in"] and rows[0]["ltype"] is None
    assert rows[1]["block_name"] == "CT1" and [(round(p["x"], 6), round(p["y"], 6)) for p in rows[3]["points"]] == [(10, 0), (8, 0)] and (round(rows[4]["x"], 6), round(rows[4]["y"], 6)) == (10, -1)
    assert dump.dump_rows("{}") == []
    frame = spark.createDataFrame([("a", json.dumps({"OBJECTS": objects})), ("b", "{"), ("c", None)], "document_hash string, content string")
    got = dump.dump_entities(frame).collect()
    assert {(r.document_hash, r.confidence) for r in got if r.document_hash != "a"} == {("b", 0.0)} and sum(r.document_hash == "a" for r in got) == 5
    (tmp_path / "x.json").write_text(json.dumps({"OBJECTS": objects}))
    (tmp_path / "a.dxf").write_text(DXF)
    (tmp_path / "n.txt").write_text("no drawing")
    assert sorted(r.kind for r in entities.read_drawings(spark, str(tmp_path)).collect()) == sorted(["LINE", "TEXT", "LINE", "CIRCLE", "LINE", "INSERT", "ARC", "LINE", "ATTRIB"])
    (gone,) = entities.read_drawings(spark, str(tmp_path / "none")).collect()
    assert gone.confidence == 0.0 and gone.text.startswith("<missing")


def test_wide_boxes_make_few_rows(spark):
    p = spark.createDataFrame([("d", 1, 5e5, 5e5), ("d", 2, 1.0, 1.0), ("d", 3, -1.0, 0.0)], "doc string, seq int, x double, y double")
    b = spark.createDataFrame([("d", 1, 0.0, 0.0, 1e6, 1e6), ("d", 2, 0.0, 0.0, 2.0, 2.0), ("d", 3, 0.0, 0.0, 0.0, 0.0)], "doc string, box int, b_x double, b_y double, b_w double, b_h double")
    assert sorted((r.seq, r.box) for r in spatial.points_in_boxes(p, b).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_relations(spark):
    nodes = [("d", "r", None, "r", 0, "CABINET", 0.0, 0.0, 100.0, 100.0), ("d", "a", "r", "r", 1, "DEVICE", 0.0, 0.0, 10.0, 10.0), ("d", "b", "r", "r", 2, "DEVICE", 2.0, 30.0, 10.0, 10.0), ("d", "c", "r", "r", 3, "DEVICE", 50.0, 2.0, 10.0, 10.0)]
    df = spark.createDataFrame(nodes, "document_hash string, node_id string, parent_id string, root_id string, ord int, type string, x double, y double, w double, h double")
    got = sorted((r.source, r.target, r.relation, r.distance) for r in spatial.tree_relations(df).collect())
    want = [("a", "b", "ALIGNED_VERT", 20.0), ("a", "b", "BELOW", 20.0), ("a", "c", "ALIGNED_HORZ", 40.0), ("a", "c", "LEFT_OF", 40.0), ("r", "a", "CONTAINS", 0.0), ("r", "b", "CONTAINS", 0.0), ("r", "c", "CONTAINS", 0.0)]
    assert got == want
    assert spatial.device_relations(df, most=2).collect() == []
    assert [(r.source, r.relation) for r in spatial.reversed_relations(spatial.directional_relations(df)).orderBy("source").collect()] == [("b", "ABOVE"), ("c", "RIGHT_OF")]
    assert {r.node_id for r in spatial.nodes_meeting(df, 5, 5, 10, 10).collect()} == {"r", "a"} and {r.node_id for r in spatial.nodes_near(df, 5, 5, 1).collect()} == {"a"}


def test_large_cabinets_have_all_device_relations(spark):
    """Cabinets of over 2,000 pairs of devices had none."""
    import math
    import random

    draw = random.Random(3)
    devices = [(r, f"{r}{k}", k, float(draw.randrange(-900, 900)) / 2, float(draw.randrange(-900, 900)) / 2, 10.0, float(draw.choice([6, 8]))) for r, n in (("p", 150), ("q", 70), ("s", 40)) for k in range(n)]
    devices += [("p", "pn", 900, math.nan, 0.0, 10.0, 8.0), ("p", "pi", 901, math.inf, 0.0, 10.0, 8.0), ("p", "pj", 902, 2e19, 8.0, 10.0, 8.0)]
    want = []
    for i, (r, a, ka, ax, ay, aw, ah) in enumerate(devices):
        for r2, b, kb, bx, by, bw, bh in devices[i + 1 :]:
            dx, dy = abs(ax + aw / 2 - bx - bw / 2), abs(ay + ah / 2 - by - bh / 2)
            if r == r2:
                kind = "ALIGNED_VERT" if dx <= 8 else "ALIGNED_HORZ" if dy <= 8 else "NEAR" if math.hypot(dx, dy) <= 40 else None
                if kind:
                    gap = max(dy - (ah + bh) / 2, 0.0) if dx <= 8 else max(dx - (aw + bw) / 2, 0.0) if dy <= 8 else math.hypot(dx, dy)
                    want.append((a, b, kind, round(gap, 1)))
    df = spark.createDataFrame([("d", d[1], "r", d[0], d[2], "DEVICE", *d[3:]) for d in devices], "document_hash string, node_id string, parent_id string, root_id string, ord int, type string, x double, y double, w double, h double")
    got = [(r.source, r.target, r.relation, r.distance) for r in spatial.device_relations(df).collect()]
    assert len(got) == len(want) and {g[:3] for g in got} == {w[:3] for w in want} and {w[2] for w in want} == {"ALIGNED_VERT", "ALIGNED_HORZ", "NEAR"}
    far = {w[:3]: w[3] for w in want}
    assert all(abs(g[3] - far[g[:3]]) < 0.11 for g in got if not {g[0], g[1]} & {"pn", "pi", "pj"})


def test_scan_keeps_errors_apart(spark):
    from inklattice.operators import scan

    df = spark.createDataFrame([("a", 1), ("b", 2)], "document_hash string, v int")
    first = lambda t: {"one": t["entities"].selectExpr("document_hash", "v", "IF(v = 2, 'bad', NULL) AS error")}
    second = lambda t: {"two": t["entities"].selectExpr("document_hash", "v * 10 AS v")}
    got = scan.run_steps({"entities": df}, [first, second])
    assert [tuple(r) for r in got["errors"].collect()] == [("b", "one", "bad")] and [tuple(r) for r in got["two"].collect()] == [("a", 10)] and got["one"].columns == ["document_hash", "v"]
    assert [s[0] for s in scan.chosen_stages("tesseract", "1,3")] == ["chieng_tess", "chisim_tess"]


def test_cable_models_look_far(spark):
    from inklattice.operators import rows

    texts = [("d", 0, "C-1(2)", 0.0, 100.0), ("d", 1, "far", 10.0, -9000.0), ("d", 2, "3x2.5 end", 299.0, -9e6), ("d", 3, "beside", 301.0, 90.0), ("d", 4, "C-1", 0.0, 50.0), ("d", 5, "C-2", 0.0, -1e7), ("e", 0, "C-1", 0.0, 0.0), ("e", 1, "one", 0.0, -1.0)]
    cables = spark.createDataFrame([("C-1", "d"), ("C-2", "d"), ("C-1", "e"), ("C-9", "e")], "cable_id string, document_hash string")
    got = {(r.cable_id, r.document_hash): (r.model, r.cross_section) for r in rows.cable_models(cables, spark.createDataFrame(texts, "document_hash string, seq int, text string, x double, y double")).collect()}
    assert got == {("C-1", "d"): ("far 3x2.5 end", "2.5"), ("C-1", "e"): ("one", "")}


def test_clusters_across_tiles(spark):
    """A chain of over forty tiles' doublings, copies of one place, and a lone point."""
    line = [("a", k, 3.0 * k, 0.5) for k in range(3000)] + [("a", 5000 + k, -900.0, 7.0) for k in range(300)] + [("a", 9999, -5000.0, 0.0), ("b", 1, 0.0, 0.0)]
    got = {(r.doc, r.seq): r.cluster for r in spatial.clusters(spark.createDataFrame(line, "doc string, seq long, x double, y double"), 4.0).collect()}
    assert got == {**{("a", k): 0 for k in range(3000)}, **{("a", 5000 + k): 5000 for k in range(300)}}


def test_clusters_pair_copies_once(spark):
    """Copies of a place are not paired with each other: half a million pairs of a thousand copies were."""
    copies = spark.range(1000).selectExpr("'a' AS doc", "id AS seq", "1.0D AS x", "2.0D AS y")
    out = spatial.clusters(copies, 4.0)
    assert out.filter("cluster = 0").count() == 1000 and "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()


def test_containing_by_tasks_and_by_join(spark):
    """Few keys go to the texts' tasks, any number to a join; both find the same."""
    keys = spark.createDataFrame([("b",), ("AB-12",), ("屏-1",), ("xAB-12",), ("",), (None,)], "k string")
    texts = spark.createDataFrame([(1, "xAB-123"), (2, "屏-1屏-1b"), (3, "12-BA"), (4, None), (5, "")], "doc int, text string")
    near, far = (sorted((r.k, r.doc) for r in f(keys, texts).collect()) for f in (matching.containing, matching.containing_joined))
    assert near == far == [("AB-12", 1), ("b", 2), ("xAB-12", 1), ("屏-1", 2)]
    assert "Join" not in matching.containing(keys, texts)._jdf.queryExecution().executedPlan().toString()
