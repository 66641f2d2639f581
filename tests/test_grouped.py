"""Grouped runs over batches and dealt rows."""

import os

import pytest
from pyspark.sql import functions as F

from inklattice.operators.grouped import per_document
from inklattice.plans import planted, planted_queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_across_batches(spark):
    """Documents end where they end, not where a batch does; a value that does not fit is its own document's error."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(f"d{k}", s, float("nan") if s == 1 else float(s), [{"x": 1.0, "y": float(s)}] if s % 2 else None) for k in range(5) for s in range(k + 1, 0, -1)] + [(None, 1, 1.0, None)]
        df = spark.createDataFrame(rows, "document_hash string, seq long, x double, points array<struct<x:double,y:double>>")

        def run(rows):
            return [{"n": "many" if rows[0]["document_hash"] == "d2" else len(rows), "shown": ",".join(f"{r['seq']}:{r['x']}:{r['points'] and list(r['points'])}" for r in rows[:2])}]

        got = {r.document_hash: r for r in per_document(df, run, "document_hash string, n int, shown string, error string").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {k: r.n for k, r in got.items()} == {None: 1, "d0": 1, "d1": 2, "d2": None, "d3": 4, "d4": 5}
    assert got["d2"].error and not got["d1"].error
    assert got["d4"].shown == "1:None:[(1.0, 1.0)],2:2.0:None"


@tables
def test_position_plan_deals_parts_not_entities(spark):
    """Entities are made where their document is, so the only exchange is that of the parts, into as many tasks as there are partitions."""
    plan = physical(planted_queries.position_plan(spark, SF))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and plan.index("Generate") < plan.index("Exchange")
    assert planted.plans(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1


@tables
def test_layout_nodes_run_once_and_join_nothing(spark):
    plan = physical(planted_queries.layout_nodes(spark, SF))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@tables
def test_layout_relations_broadcast_nothing(spark):
    assert "Broadcast" not in physical(planted_queries.layout_relations(spark, SF))


@tables
def test_match_tiers_broadcast_nothing(spark):
    from inklattice.plans import store_queries

    assert "Broadcast" not in physical(store_queries.match_tiers(spark, SF))


@tables
def test_cable_models_deal_pairs_not_texts(spark):
    """The pairs are dealt by document once for cables and once for texts (one exchange, used twice); no text is."""
    from inklattice.plans import store_queries

    plan = physical(store_queries.cable_models(spark, SF))
    assert "Join" not in plan and "Scan ExistingRDD" not in plan
    assert plan.count("Exchange hashpartitioning") == 2 and all("Generate" not in below for below in plan.split("Exchange hashpartitioning")[2:])


def test_numbers_come_from_a_table_not_a_checkpoint(spark):
    from inklattice.operators import store

    made = store.numbered(spark.range(1000, -1, -1).selectExpr("lpad(id, 4, '0') AS k"), "k")
    assert [(r.k, r.number) for r in made.orderBy("k").collect()] == [(f"{k:04}", k + 1) for k in range(1001)]
    assert "ExistingRDD" not in physical(made)


@tables
@pytest.mark.parametrize("name", ["strip_topology", "loop_topology", "cabinet_regions", "cabinet_region_terminals"])
def test_conductors_are_dealt_not_their_entities(spark, name):
    """Line items and orders by order, conductors by document; no entity is."""
    plan = physical(planted_queries.QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


@tables
def test_loop_cable_types_read_loops_once(spark):
    plan = physical(planted_queries.loop_cable_types(spark, SF))
    assert plan.count("MapInArrow") == 1 and plan.count("Generate") == 1


@tables
def test_classed_topology_reads_entities_once(spark):
    plan = physical(planted_queries.classed_topology(spark, SF))
    assert plan.count("MapInArrow") == 1


def test_each_class_of_a_document_has_its_analyzer(spark):
    """Records of both classes; the error of one analyzer leaves the other's."""
    from inklattice.operators import topology

    e = spark.createDataFrame([("d", 0, "TEXT", 0.0, 0.0, "AB-1"), ("b", 0, "LINE", None, None, None), ("z", 0, "TEXT", 0.0, 0.0, "AB-2")], "document_hash string, seq long, kind string, x double, y double, text string")
    c = spark.createDataFrame([("d", "cable_schedule"), ("d", "terminal_strip"), ("b", "terminal_strip"), ("b", "cable_schedule"), ("z", "unknown")], "document_hash string, classification string")
    got = [(r.document_hash, r.cable_id, r.error) for r in topology.scan_topology(e, c).collect()]
    assert ("d", "AB-1", None) in got and not [g for g in got if g[0] == "z"]


def test_packed_documents_across_batches(spark):
    """Packed entities come in file order, whole documents at a time, also where a document, or one without a key, fills several batches."""
    from inklattice.operators.grouped import Packed, Part

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = spark.createDataFrame([(f"d{k}" if k else None, s, s % 2 == 1, float("nan") if s == 3 else float(s)) for k in range(4) for s in range(3 * k + 2)], "document_hash string, s long, odd boolean, x double")
        rows = rows.withColumn("later", F.col("s") - 100).coalesce(1).sortWithinPartitions("document_hash", "s")
        packed = Packed(rows, [Part(None, {"seq": "s", "x": "x"}, {"kind": "TEXT"}), Part("odd", {"seq": "later"}, {"kind": "LINE", "closed": True})])
        run = lambda rows: [{"n": len(rows), "shown": ",".join(f"{r['kind'][0]}{r.get('x')}" for r in rows)}]
        got = {r.document_hash: (r.n, r.shown) for r in per_document(packed, run, "document_hash string, n int, shown string, error string", ("kind", "x")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {k: n for k, (n, _) in got.items()} == {None: 3, "d1": 7, "d2": 12, "d3": 16}
    assert got[None][1] == "LNone,T0.0,T1.0" and got["d1"][1] == "LNone,LNone,T0.0,T1.0,T2.0,TNone,T4.0"


@tables
@pytest.mark.parametrize("name", ["loops", "layouts"])
def test_packed_entities_are_the_entities(spark, name):
    made, schema = getattr(planted, name), "document_hash string, shown string, error string"
    fields = ("kind", "x", "y", "text", "tag", "points", "closed", "cx", "cy", "radius", "ltype", "handle")
    run = lambda rows: [{"shown": repr([[list(r[f]) if f == "points" and r.get(f) else r.get(f) for f in fields] for r in rows])}]
    packed, plain = (per_document(made(spark, SF, how), run, schema, fields).toPandas().sort_values("document_hash", ignore_index=True) for how in (planted.packed, planted.entities))
    assert len(packed) and packed.equals(plain)


@tables
@pytest.mark.parametrize("name", ["loop_topology", "loop_cable_types", "cabinet_regions", "cabinet_region_terminals", "layout_nodes"])
def test_entities_reach_python_packed(spark, name):
    """Neither made nor sorted one by one before they get there: rows are numbered once at most, where conductors get their marks."""
    plan = physical(planted_queries.QUERIES[name](spark, SF)).split("MapInArrow")[1]
    assert "row_number" not in plan.split("Window")[0] and plan.count("Window ") <= (name != "layout_nodes") and "explode(array" not in plan


@tables
def test_classed_entities_reach_python_packed(spark):
    """They were made one by one, dealt again and sorted again for their classes and their order."""
    plan = physical(planted_queries.classed_topology(spark, SF)).split("MapInArrow")[1]
    assert "explode(array" not in plan and plan.count("Window ") == 3


@tables
@pytest.mark.parametrize("name", ["strips", "schedules"])
def test_packed_strips_and_schedules_are_the_entities(spark, name):
    made, schema = getattr(planted, name), "document_hash string, shown string, error string"
    fields = ("kind", "x", "y", "text", "tag", "points", "eed")
    run = lambda rows: [{"shown": repr([[list(r[f]) if f == "points" and r.get(f) else r.get(f) for f in fields] for r in rows])}]
    packed, plain = (per_document(made(spark, SF, how), run, schema, fields).toPandas().sort_values("document_hash", ignore_index=True) for how in (planted.packed, planted.entities))
    assert len(packed) and packed.equals(plain)


def test_packed_tables_together(spark):
    """Documents of two kinds, also in one partition, each with its own fields and what its rows tell."""
    from inklattice.operators.grouped import Packed, Part, together

    one = Packed(spark.sql("SELECT * FROM VALUES ('a', 2L, 'x'), ('a', 1L, 'y'), ('b', 1L, NULL) t(document_hash, s, t)").selectExpr("document_hash", "'A' AS told", "s", "t").coalesce(1), [Part(None, {"seq": "s", "text": "t"}, {"kind": "TEXT"})], None, ("told",))
    two = Packed(spark.sql("SELECT * FROM VALUES ('c', 5.0D, true), ('c', 6.0D, false), ('d', 7.0D, false) t(document_hash, r, w)").selectExpr("document_hash", "'C' AS told", "r", "w").coalesce(1), [Part("w", {"cx": "r"}, {"kind": "CIRCLE", "seq": 3})], None, ("told",))
    both = together({"one": one, "two": two})
    run = lambda rows: [{"shown": repr([(r["kind"], r.get("text"), r.get("cx")) for r in rows]) + rows[0]["told"]}]
    want = {"a": "[('TEXT', 'y', None), ('TEXT', 'x', None)]A", "b": "[('TEXT', None, None)]A", "c": "[('CIRCLE', None, 5.0)]C"}
    for p in (both, both._replace(rows=both.rows.coalesce(1))):
        assert {r.document_hash: r.shown for r in per_document(p, run, "document_hash string, shown string, error string").collect()} == want
