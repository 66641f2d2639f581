"""Queries over stored tables, upserts and match tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inklattice.functions import text as T
from inklattice.operators import matching, rows, rules, scan, spatial, store
from inklattice.plans import stand_ins as S
from inklattice.plans.planted import dealt
from inklattice.sources import sinks

CLASSES = ["unknown", "panel_layout", "panel_position", "monitoring_system", "manufacturer_catalog", "protection_diagram"]


def list_cable_topology(spark: SparkSession, d: str) -> DataFrame:
    return store.cable_topology(S.topology(spark, d), document="7")


def list_cabinets(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("document_hash"), F.col("p_name").alias("display_name"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return store.find_cabinets(p, name="A")


def list_unclassified_documents(spark: SparkSession, d: str) -> DataFrame:
    return store.unclassified(S.stored_documents(spark, d), S.texts(spark, d), CLASSES).select("document_hash", "path", "classification", "text_count")


def documents_without_topology(spark: SparkSession, d: str) -> DataFrame:
    return store.unprocessed(S.stored_documents(spark, d), S.topology(spark, d)).select("document_hash", "path")


def documents_by_classification(spark: SparkSession, d: str) -> DataFrame:
    return store.by_classification(S.stored_documents(spark, d))


def search_cabinets(spark: SparkSession, d: str) -> DataFrame:
    return store.cabinet_search(S.topology(spark, d), "cab1")


def list_cables(spark: SparkSession, d: str) -> DataFrame:
    return store.cables(S.topology(spark, d))


def cable_first_conductor(spark: SparkSession, d: str) -> DataFrame:
    return store.first_conductor(S.topology(spark, d))


def documents_tree(spark: SparkSession, d: str) -> DataFrame:
    return store.document_rollup(S.stored_documents(spark, d), S.topology(spark, d), "/EN/")


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    strips = S.topology(spark, d).select("strip_name").distinct()
    cabinets = S.table(spark, d, "part").select((F.col("p_partkey") % 77).cast("string").alias("document_hash"))
    return store.stats(S.stored_documents(spark, d), S.topology(spark, d), strips, cabinets, S.table(spark, d, "supplier"))


def topology_by_source(spark: SparkSession, d: str) -> DataFrame:
    return store.breakdown(S.topology(spark, d), "source_type")


def documents_by_type(spark: SparkSession, d: str) -> DataFrame:
    return S.stored_documents(spark, d).groupBy("document_type").agg(F.count("*").alias("n"))


def count_cabinets(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "part").agg(F.count("*").alias("n"))


def cable_detail(spark: SparkSession, d: str) -> DataFrame:
    docs = S.stored_documents(spark, d).select("document_hash", "path")
    return store.cable_topology(S.topology(spark, d), cable_id="C-7").join(docs, "document_hash", "left").select("cable_id", "conductor_no", "strip_name", "document_hash", "path")


def cabinet_with_terminals(spark: SparkSession, d: str) -> DataFrame:
    cabs = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    terms = S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cabinet_id"), (F.col("l_partkey") % 1000).alias("terminal"), F.col("l_linestatus").alias("kind")).distinct()
    out = store.cabinets_with_terminals(cabs, terms)
    return out.select("id", "name", F.coalesce(F.array_join(F.transform("terminals", lambda t: F.concat(t.terminal.cast("string"), F.lit(":"), t.kind)), ","), F.lit("")).alias("terminals"))


def upsert_cabinets(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return store.last_write_wins(e, ["user_id"], ["event_id"])


def upsert_cabinet_terminals(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return store.last_write_wins(e, ["user_id", "event_type"], ["event_id"])


def upsert_strips(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return store.first_write_fills(e, "user_id", ["event_id"], ["value"])


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    old = store.last_write_wins(e.filter("event_type = 'click'"), ["user_id"], ["event_id"])
    new = store.last_write_wins(e.filter("event_type <> 'click'"), ["user_id"], ["event_id"])
    return store.partial_update(old, new, "user_id", ["event_type"])


def replace_by_document(spark: SparkSession, d: str) -> DataFrame:
    t = S.topology(spark, d).select("cable_id", "document_hash", "source_type")
    new = t.filter("document_hash IN ('1','2','3') AND source_type = 'strip'")
    return store.replace_documents(t, new, new).groupBy("document_hash", "source_type").agg(F.count("*").alias("n"))


def state_lists(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.col("event_type").alias("key"), F.array((F.col("user_id") % 100).cast("string")).alias("values"), "event_id")
    held = spark.createDataFrame([("click", ["7", "x"]), ("none", [])], "key string, values array<string>")
    out = store.append_state(held, e, ["event_id"])
    return out.select("key", F.array_join("values", ",").alias("values"))


def resume_filter(spark: SparkSession, d: str) -> DataFrame:
    done = S.stored_documents(spark, d).filter("classification IS NOT NULL").select("document_hash")
    return S.stored_documents(spark, d).join(done, "document_hash", "left_anti").select("document_hash")


def cable_to_document(spark: SparkSession, d: str) -> DataFrame:
    """For each cable id found in texts, the least document whose text holds it anywhere, also inside a longer word."""
    docs = S.table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc"), "text")
    ids = docs.select(F.explode(F.array_distinct(T.cable_ids(F.col("text")))).alias("k")).distinct()
    return matching.containing(ids, docs).groupBy(F.col("k").alias("cable")).agg(F.min("doc").alias("document_hash"), F.count("*").alias("documents"))


def _stages(spark: SparkSession, d: str) -> list[DataFrame]:
    li = S.table(spark, d, "lineitem")
    out = []
    for k in range(3):
        out.append(
            li.filter(F.col("l_linenumber") % 3 == k).select(
                F.concat(F.lit("C"), F.col("l_partkey") % 500).alias("cable"), F.concat(F.lit("h"), F.col("l_suppkey") % 20).alias("hash"),
                F.element_at(F.array(*map(F.lit, ["exact", "normalized", "confusion", "levenshtein", "", "odd"])), (F.col("l_orderkey") % 6 + 1).cast("int")).alias("match_type"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_ix"),
            )
        )
    return out


STAGES_SQL = """
st AS (SELECT l_linenumber % 3 + 1 AS stage, 'C' || (l_partkey % 500) AS cable, 'h' || (l_suppkey % 20) AS hash,
  (['exact','normalized','confusion','levenshtein','','odd'])[l_orderkey % 6 + 1] AS match_type, l_orderkey * 10 + l_linenumber AS row_ix FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cable, hash ORDER BY CASE match_type WHEN 'exact' THEN 0 WHEN 'normalized' THEN 1 WHEN 'confusion' THEN 2 WHEN 'levenshtein' THEN 3 WHEN '' THEN 4 ELSE 99 END, stage, row_ix) AS r FROM st)"""


def merge_stages(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_of_stages(_stages(spark, d), ["cable", "hash"])


def merge_two_runs(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_of_stages(_stages(spark, d)[:2], ["cable", "hash"])


def merge_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.merge_summary(merge_stages(spark, d))


def diff_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _stages(spark, d)
    return matching.run_diff(a, b, ["cable", "hash"])


def diff_cables(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _stages(spark, d)
    return matching.run_diff(a, b, ["cable"])


def multi_hit_cables(spark: SparkSession, d: str) -> DataFrame:
    return matching.multi_hit(_stages(spark, d)[0], "cable", "hash")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "part").select(F.concat(F.lit("B"), F.col("p_partkey") % 90, F.lit("-"), F.col("p_size")).alias("target")).distinct()


def match_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Ids inside other words, in lower case with other separators, and with a confused character."""
    texts = S.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat(F.lit("xb"), F.col("p_partkey") % 70, F.lit("_"), F.col("p_size"), F.lit("y (8"), F.col("p_partkey") % 80, F.lit("-"), F.col("p_size"), F.lit(")B"), F.col("p_partkey") % 40, F.lit("-"), F.col("p_size"), F.lit("1")).alias("text"))
    return matching.tiered(_targets(spark, d), texts)


def match_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    texts = S.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat(F.lit("B"), F.col("p_partkey") % 70, F.col("p_size")).alias("text"))
    return matching.tiered(_targets(spark, d), texts, fuzzy=True)


def strip_upserts_append(spark: SparkSession, d: str) -> DataFrame:
    """Text entities appended in the stored table's columns, with their defaults."""
    made = store.append_rows(S.texts(spark, d), {"document_hash": "string", "text": "string", "entity_type": "string", "page": "int", "x": "double"}, {"entity_type": "TEXT", "page": 1})
    return made.groupBy("document_hash", "entity_type", "page").agg(F.count("*").alias("n"), F.count("x").alias("placed"))


def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    """Topology and cable types without the documents of one class."""
    t = S.topology(spark, d)
    info = t.select("cable_id", "document_hash").distinct()
    gone = S.stored_documents(spark, d).filter("classification = 'circuit_loop'").select("document_hash")
    left = store.delete_documents({"topology": t.select("cable_id", "document_hash"), "cable_info": info}, gone)
    counts = [df.groupBy("document_hash").agg(F.count("*").alias("n")).withColumn("source", F.lit(name)) for name, df in left.items()]
    return counts[0].unionByName(counts[1])


def stored_trees(spark: SparkSession, d: str) -> DataFrame:
    docs = S.stored_documents(spark, d)
    old = docs.select("document_hash", F.concat(F.lit("old "), "path").alias("tree_json"))
    new = docs.select("document_hash", F.when(F.col("classification").isNotNull(), F.concat(F.lit("new "), "path")).alias("tree_json"))
    return store.upsert_trees(old, new)


def state_values(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    changes = e.select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("key"), F.to_json(F.struct("event_type")).alias("value"), F.col("event_id").alias("seq"))
    held = spark.createDataFrame([("u1", "old"), ("scan", '{"root":"/scan"}')], "key string, value string")
    return store.set_state(held, changes)


def state_value(spark: SparkSession, d: str) -> DataFrame:
    v = store.get_state(state_values(spark, d), "u3", "event_type string", '{"event_type":"none"}')
    return v.select(F.col("value.event_type").alias("event_type"))


def document_folders(spark: SparkSession, d: str) -> DataFrame:
    return store.document_folders(store.document_rollup(S.stored_documents(spark, d), S.topology(spark, d)), "/scan")


def document_detail(spark: SparkSession, d: str) -> DataFrame:
    cabinets = S.table(spark, d, "supplier").select(F.concat(F.lit("c"), "s_suppkey").alias("id"), (F.col("s_suppkey") % 10).cast("string").alias("document_hash"))
    terminals = S.table(spark, d, "lineitem").select(F.concat(F.lit("c"), "l_suppkey").alias("cabinet_id"), (F.col("l_suppkey") % 10).cast("string").alias("document_hash"), (F.col("l_partkey") % 1000).alias("terminal"), F.col("l_linestatus").alias("kind")).distinct()
    return store.document_detail("7", S.stored_documents(spark, d), S.topology(spark, d), cabinets, terminals)


def _loop_topology(spark: SparkSession, d: str) -> DataFrame:
    return S.topology(spark, d).withColumn("source_type", F.when(F.col("source_type") == "loop", "circuit_loop").otherwise(F.col("source_type")))


def _labels(pairs: DataFrame) -> DataFrame:
    """A label and four texts below it for each cable of each document; some labels carry a core's number."""
    ok = F.substring("cable_id", 3, 12).cast("long")
    label = F.when(ok % 3 == 0, F.concat("cable_id", F.lit("(C1)"))).otherwise(F.concat(F.lit(" "), "cable_id"))
    at = lambda k, text, dy: F.struct((ok * 10 + k).alias("seq"), text.alias("text"), F.lit(5.0).alias("x"), (ok * -1000.0 - dy).alias("y"))
    texts = F.array(at(0, label, 0), at(1, F.lit(" KVV "), 10), at(2, F.lit("  "), 15), at(3, F.concat(F.lit("4x"), (ok % 5).cast("string"), F.lit(".5")), 20), at(4, F.lit("9x9"), 30))
    return pairs.select("document_hash", F.explode(texts).alias("t")).select("document_hash", "t.*")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cables of each document, dealt by document."""
    return dealt(S.topology(spark, d).select("cable_id", "document_hash"), F.col("document_hash")).distinct()


def cable_models(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return rows.cable_models(pairs, _labels(pairs))


def cable_cabinets(spark: SparkSession, d: str) -> DataFrame:
    """The export of one row a cable, numbered in order; models are looked for where they count."""
    first = spatial.held(store.first_rows(_loop_topology(spark, d)))
    asked = dealt(store.with_model(first), F.col("document_hash"))
    return store.numbered(store.cable_cabinets(first, rows.cable_models(asked, _labels(_pairs(spark, d)))), "cable_id")


def cabinet_folders(spark: SparkSession, d: str) -> DataFrame:
    li = S.table(spark, d, "lineitem")
    asked = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.concat(F.lit("K"), "o_custkey").alias("cubicle"), F.array(F.concat(F.lit("C"), F.col("o_orderkey") % 300), F.concat(F.lit("C"), F.col("o_custkey"))).alias("cables"))
    held = li.groupBy(F.concat(F.lit("C"), F.col("l_suppkey") * 2).alias("cable")).agg(F.min(F.col("l_orderkey")).cast("string").alias("document_hash"))
    return sinks.cabinet_folders(asked, held)


def copy_targets(spark: SparkSession, d: str) -> DataFrame:
    files = S.stored_documents(spark, d).select("path", F.concat("document_type", F.lit(".pdf")).alias("name"))
    return sinks.unique_targets(files)


def copy_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = S.stored_documents(spark, d)
    return sinks.copy_manifest(docs.select("path", F.concat("document_type", F.lit(".x.pdf")).alias("pdf"), F.sha2("path", 256).alias("hash")))


def text_files(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations")
    pages = c.select(F.concat(F.lit("/t/c"), "conv_id", F.lit(".pdf")).alias("path"), F.col("turn").alias("page"), F.array(F.array("role", F.lit(None).cast("string"), F.lit("x")), F.array(F.lit(" "))).alias("rows"))
    return sinks.text_files(pages)


def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(s[0],) for s in scan.chosen_stages()], "stage string")
    li = S.table(spark, d, "lineitem").select(F.element_at(F.array(*[F.lit(s[0]) for s in scan.STAGES[:5]]), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("stage"), F.col("l_suppkey").cast("string").alias("document_hash"), F.col("l_partkey").cast("string").alias("cable"), F.col("l_returnflag").alias("hash"))
    return scan.stage_progress(names, li, li, 1000)


def chosen_text(spark: SparkSession, d: str) -> DataFrame:
    """Of a line and its turned copy, the one with more CJK characters by far."""
    p = S.table(spark, d, "part").select("p_partkey", F.repeat(F.lit("屏"), F.col("p_size")).alias("a"), F.repeat(F.lit("柜"), (F.col("p_partkey") % 90).cast("int")).alias("b"))
    return p.select("p_partkey", F.length(T.better_text(F.col("a"), F.concat(F.lit("z"), "b"))).alias("n"), F.substring(T.better_text(F.col("a"), F.concat(F.lit("z"), "b")), 1, 1).alias("first"))


def ids_in_json(spark: SparkSession, d: str) -> DataFrame:
    dumps = S.table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("document_hash"), F.concat(F.lit('{"a": [{"text" : "B'), F.col("p_partkey") % 70, F.lit("-"), F.col("p_size"), F.lit(' (C1)"}, {"text": "x"}, {"note": "B1-1"}]}')).alias("content"))
    return matching.ids_in_json(dumps, _targets(spark, d).withColumnRenamed("target", "id"))


def document_path(spark: SparkSession, d: str) -> DataFrame:
    return store.document_path(S.stored_documents(spark, d), "7")


def terminal_strips(spark: SparkSession, d: str) -> DataFrame:
    t = S.topology(spark, d).select("strip_name", "document_hash", F.when(F.col("strip_name").startswith("A"), F.concat(F.lit("n"), "document_hash")).alias("chinese_name"))
    return store.terminal_strips(store.first_write_fills(t.distinct(), "strip_name", ["document_hash"], ["chinese_name"]))


def truncated_cabinets(spark: SparkSession, d: str) -> DataFrame:
    return store.truncated(list_cabinets(spark, d).orderBy("document_hash", "x", "y", "id"), 50)


RULES = {"steel": {"column": 1, "match": "contains:STEEL"}, "brand": {"column": "B", "startswith": "Brand#1"}, "size": {"column": [3], "regex": "^[1-4]$"}, "any": {"column": "1,2", "endswith": "3"}, "none": {"column": 4, "contains": "on"}}
RULE = "(steel | brand) & !size or any and not none | size"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    return p.select("p_partkey", F.array("p_type", "p_brand", F.col("p_size").cast("string"), F.when(F.col("p_size") > 25, F.col("p_name"))).alias("cells"))


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    return rules.Rules(RULES).apply(_cells(spark, d), RULE).select("p_partkey", "matched", "fill_argb")


def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return rules.Rules(RULES).hits(_cells(spark, d))


QUERIES = {f.__name__: f for f in (
    list_cable_topology, list_cabinets, list_unclassified_documents, documents_without_topology, documents_by_classification, search_cabinets, list_cables, cable_first_conductor, documents_tree, store_stats, topology_by_source,
    documents_by_type, count_cabinets, cable_detail, cabinet_with_terminals, upsert_cabinets, upsert_cabinet_terminals, upsert_strips, upsert_documents, replace_by_document, state_lists, resume_filter, cable_to_document,
    merge_stages, merge_two_runs, merge_summary, diff_pairs, diff_cables, multi_hit_cables, match_tiers, match_levenshtein, rule_rows, rule_hits, strip_upserts_append, delete_documents, stored_trees, state_values, state_value, document_folders, document_detail, cable_models, cable_cabinets, cabinet_folders, copy_targets,
    copy_manifest, text_files, stage_progress, chosen_text, ids_in_json, document_path, terminal_strips, truncated_cabinets,
)}

_RULE_SQL = """
c AS (SELECT p_partkey, p_type AS a, p_brand AS b, CAST(p_size AS VARCHAR) AS s, coalesce(CASE WHEN p_size > 25 THEN p_name END, 'None') AS n FROM part),
r AS (SELECT p_partkey, contains(a, 'STEEL') AS steel, starts_with(b, 'Brand#1') AS brand, regexp_matches(s, '^[1-4]$') AS size, (ends_with(a, '3') OR ends_with(b, '3')) AS anyr, contains(n, 'on') AS nonr FROM c)"""

_TARGETS = "t AS (SELECT DISTINCT 'B' || (p_partkey % 90) || '-' || p_size AS target FROM part)"
_CONFUSED = ", ".join(f"('{a}', '{b}')" for a, bs in T.CONFUSED.items() for b in bs)
_NORMAL = "upper(regexp_replace({}, '[_.\\s—-]', '-', 'g'))"
_TIERS = f"""v AS (SELECT DISTINCT target, substr(target, 1, i - 1) || b || substr(target, i + 1) AS k FROM t, generate_series(1, 12) g(i), (VALUES {_CONFUSED}) c(a, b) WHERE i <= length(target) AND substr(target, i, 1) = a),
  m AS (SELECT target, doc, min(tier) AS tier FROM (SELECT target, doc, 0 AS tier FROM t, x WHERE contains(text, target) UNION ALL SELECT target, doc, 1 FROM t, x WHERE contains({_NORMAL.format('text')}, {_NORMAL.format('target')}) UNION ALL SELECT target, doc, 2 FROM v, x WHERE contains(text, k)) m GROUP BY 1, 2)"""
_BEST = "(['exact', 'normalized', 'confusion', 'levenshtein'])[tier + 1] AS match_type FROM m"

ORACLE_SQL = {
    "list_cable_topology": f"WITH {S.TOPOLOGY_SQL} SELECT * FROM topology WHERE document_hash = '7'",
    "list_cabinets": "SELECT p_partkey AS id, p_brand AS document_hash, p_name AS display_name, p_size AS x, p_retailprice AS y FROM part WHERE p_name ILIKE '%A%'",
    "list_unclassified_documents": f"WITH {S.DOCUMENTS_SQL}, {S.TEXTS_SQL} SELECT document_hash, path, classification, (SELECT count(*) FROM texts t WHERE t.document_hash = s.document_hash) AS text_count FROM stored s WHERE classification IS NULL OR classification IN ('unknown','panel_layout','panel_position','monitoring_system','manufacturer_catalog','protection_diagram') ORDER BY classification NULLS FIRST, path LIMIT 500",
    "documents_without_topology": f"WITH {S.DOCUMENTS_SQL}, {S.TOPOLOGY_SQL} SELECT document_hash, path FROM stored s WHERE NOT EXISTS (SELECT 1 FROM topology t WHERE t.document_hash = s.document_hash)",
    "documents_by_classification": f"WITH {S.DOCUMENTS_SQL} SELECT coalesce(classification, 'unclassified') AS classification, count(*) AS n FROM stored GROUP BY 1",
    "search_cabinets": f"WITH {S.TOPOLOGY_SQL} SELECT cabinet_name, cabinet_name_remote, document_hash, count(*) AS conductors, string_agg(DISTINCT cable_id, ',' ORDER BY cable_id) AS cables FROM topology WHERE cabinet_name ILIKE '%cab1%' OR cabinet_name_remote ILIKE '%cab1%' GROUP BY 1, 2, 3",
    "list_cables": f"WITH {S.TOPOLOGY_SQL}, s AS (SELECT cable_id, document_hash, min(coalesce(conductor_no, -1)) AS first FROM topology GROUP BY 1, 2) SELECT cable_id, count(*) AS documents, string_agg(document_hash, ',' ORDER BY first, document_hash) AS hashes FROM s GROUP BY 1",
    "cable_first_conductor": f"WITH {S.TOPOLOGY_SQL} SELECT cable_id, conductor_no, strip_name, terminal_no, n FROM (SELECT *, row_number() OVER (PARTITION BY cable_id ORDER BY coalesce(conductor_no, -1), coalesce(strip_name, ''), coalesce(terminal_no, -1)) AS r, count(*) OVER (PARTITION BY cable_id) AS n FROM topology) WHERE r = 1",
    "documents_tree": f"WITH {S.DOCUMENTS_SQL}, {S.TOPOLOGY_SQL}, p AS (SELECT document_hash, count(DISTINCT cable_id) AS cables, count(*) AS conductors, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types FROM topology GROUP BY 1) SELECT s.document_hash, path, coalesce(cables, 0) AS cables, coalesce(conductors, 0) AS conductors, coalesce(source_types, '') AS source_types FROM stored s LEFT JOIN p ON p.document_hash = s.document_hash WHERE contains(lower(path), '/en/')",
    "store_stats": f"""WITH {S.DOCUMENTS_SQL}, {S.TOPOLOGY_SQL}, b AS (SELECT source_type, count(*) AS n, count(DISTINCT cable_id) AS c FROM topology GROUP BY 1)
      SELECT (SELECT count(*) FROM topology) AS topology_rows, (SELECT count(DISTINCT cable_id) FROM topology) AS cables, (SELECT count(*) FROM topology WHERE conductor_no IS NOT NULL) AS conductors, (SELECT count(DISTINCT CASE WHEN terminal_no IS NOT NULL THEN cable_id END) FROM topology) AS cables_with_terminals,
      (SELECT count(DISTINCT cable_id) - count(DISTINCT CASE WHEN terminal_no IS NOT NULL THEN cable_id END) FROM topology) AS cables_without_terminals, (SELECT count(DISTINCT coalesce(cabinet_name, cabinet_name_remote)) FROM topology) AS cabinet_names, (SELECT count(*) FROM stored) AS documents,
      (SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM stored) AS bytes, (SELECT count(*) FROM stored s WHERE NOT EXISTS (SELECT 1 FROM topology x WHERE x.document_hash = s.document_hash)) AS unprocessed, (SELECT count(*) FROM stored WHERE classification IS NULL OR classification IN ('protection_diagram', 'unknown')) AS unmatched,
      (SELECT count(DISTINCT strip_name) FROM topology) AS strips, (SELECT count(*) FROM part) AS regions, (SELECT count(DISTINCT p_partkey % 77) FROM part) AS documents_with_regions, (SELECT count(*) FROM supplier) AS region_terminals,
      (SELECT string_agg(k || '=' || n, ',' ORDER BY n DESC, k) FROM (SELECT document_type AS k, count(*) AS n FROM stored GROUP BY 1)) AS by_type, (SELECT string_agg(source_type || '=' || n, ',' ORDER BY n DESC, source_type) FROM b) AS rows_by_source, (SELECT string_agg(source_type || '=' || c, ',' ORDER BY c DESC, source_type) FROM b) AS cables_by_source,
      (SELECT string_agg(k || '=' || n, ',' ORDER BY n DESC, k) FROM (SELECT coalesce(classification, 'unclassified') AS k, count(*) AS n FROM stored GROUP BY 1)) AS by_classification""",
    "topology_by_source": f"WITH {S.TOPOLOGY_SQL} SELECT source_type, count(*) AS n, count(DISTINCT cable_id) AS cables FROM topology GROUP BY 1",
    "documents_by_type": f"WITH {S.DOCUMENTS_SQL} SELECT document_type, count(*) AS n FROM stored GROUP BY 1",
    "count_cabinets": "SELECT count(*) AS n FROM part",
    "cable_detail": f"WITH {S.DOCUMENTS_SQL}, {S.TOPOLOGY_SQL} SELECT cable_id, conductor_no, strip_name, t.document_hash, path FROM topology t LEFT JOIN stored s ON s.document_hash = t.document_hash WHERE cable_id = 'C-7'",
    "cabinet_with_terminals": "WITH t AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 1000 AS p, l_linestatus AS s FROM lineitem), g AS (SELECT k, string_agg(p || ':' || s, ',' ORDER BY p, s) AS terminals FROM t GROUP BY k) SELECT s_suppkey AS id, s_name AS name, coalesce(terminals, '') AS terminals FROM supplier LEFT JOIN g ON k = s_suppkey",
    "upsert_cabinets": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "upsert_cabinet_terminals": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "upsert_strips": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) FILTER (event_id % 3 = 0 AND value IS NOT NULL) AS value FROM events GROUP BY 1",
    "upsert_documents": "WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'click') WHERE r = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'click') WHERE r = 1) SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.event_id ELSE o.event_id END AS event_id, CASE WHEN o.user_id IS NOT NULL THEN o.event_type ELSE n.event_type END AS event_type, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value FROM o FULL JOIN n ON o.user_id = n.user_id",
    "replace_by_document": f"WITH {S.TOPOLOGY_SQL}, n AS (SELECT * FROM topology WHERE document_hash IN ('1','2','3') AND source_type = 'strip') SELECT document_hash, source_type, count(*) AS n FROM (SELECT document_hash, source_type FROM topology WHERE document_hash NOT IN (SELECT document_hash FROM n) UNION ALL SELECT document_hash, source_type FROM n) GROUP BY 1, 2",
    "state_lists": "WITH h AS (SELECT * FROM (VALUES ('click', '7', -2), ('click', 'x', -1)) t(key, v, place)), a AS (SELECT key, v, min(place) AS place FROM (SELECT event_type AS key, CAST(user_id % 100 AS VARCHAR) AS v, event_id AS place FROM events UNION ALL SELECT * FROM h) GROUP BY 1, 2) SELECT key, string_agg(v, ',' ORDER BY place) AS values FROM a GROUP BY 1 UNION ALL SELECT 'none', ''",
    "resume_filter": f"WITH {S.DOCUMENTS_SQL} SELECT document_hash FROM stored WHERE classification IS NULL",
    "cable_to_document": "WITH i AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b([A-Za-z0-9]{2,8}-[A-Za-z0-9]{1,8})\\b', 1)) AS cable FROM documents) SELECT cable, min(CAST(doc_id AS VARCHAR)) AS document_hash, count(*) AS documents FROM i JOIN documents d ON contains(d.text, i.cable) GROUP BY 1",
    "merge_stages": f"WITH {STAGES_SQL} SELECT cable, hash, match_type, row_ix, CAST(stage AS INT) AS stage FROM ranked WHERE r = 1",
    "merge_two_runs": f"WITH {STAGES_SQL.replace('FROM lineitem)', 'FROM lineitem WHERE l_linenumber % 3 < 2)')} SELECT cable, hash, match_type, row_ix, CAST(stage AS INT) AS stage FROM ranked WHERE r = 1",
    "merge_summary": f"WITH {STAGES_SQL} SELECT CAST(stage AS INT) AS stage, match_type, count(*) AS n, count(DISTINCT cable) AS cables, count(DISTINCT hash) AS hashes FROM ranked WHERE r = 1 GROUP BY 1, 2",
    "diff_pairs": f"WITH {STAGES_SQL}, a AS (SELECT DISTINCT cable, hash FROM st WHERE stage = 1), b AS (SELECT DISTINCT cable, hash FROM st WHERE stage = 2) SELECT coalesce(a.cable, b.cable) AS cable, coalesce(a.hash, b.hash) AS hash, CASE WHEN a.cable IS NULL THEN 'only_b' WHEN b.cable IS NULL THEN 'only_a' ELSE 'both' END AS side FROM a FULL JOIN b ON a.cable = b.cable AND a.hash = b.hash",
    "diff_cables": f"WITH {STAGES_SQL}, a AS (SELECT DISTINCT cable FROM st WHERE stage = 1), b AS (SELECT DISTINCT cable FROM st WHERE stage = 2) SELECT coalesce(a.cable, b.cable) AS cable, CASE WHEN a.cable IS NULL THEN 'only_b' WHEN b.cable IS NULL THEN 'only_a' ELSE 'both' END AS side FROM a FULL JOIN b ON a.cable = b.cable",
    "multi_hit_cables": f"WITH {STAGES_SQL} SELECT cable, count(DISTINCT hash) AS n FROM st WHERE stage = 1 GROUP BY 1 HAVING count(DISTINCT hash) > 1",
    "match_tiers": f"WITH {_TARGETS}, x AS (SELECT p_partkey AS doc, 'xb' || (p_partkey % 70) || '_' || p_size || 'y (8' || (p_partkey % 80) || '-' || p_size || ')B' || (p_partkey % 40) || '-' || p_size || '1' AS text FROM part), {_TIERS} SELECT target, doc, {_BEST}",
    "match_levenshtein": f"WITH {_TARGETS}, x AS (SELECT p_partkey AS doc, 'B' || (p_partkey % 70) || p_size AS text FROM part), {_TIERS.replace(') m', ' UNION ALL SELECT target, doc, 3 FROM t, x WHERE levenshtein(target, text) <= 1) m')} SELECT target, doc, {_BEST}",
    "strip_upserts_append": f"WITH {S.TEXTS_SQL} SELECT document_hash, 'TEXT' AS entity_type, 1 AS page, count(*) AS n, 0 AS placed FROM texts GROUP BY 1",
    "delete_documents": f"WITH {S.DOCUMENTS_SQL}, {S.TOPOLOGY_SQL}, l AS (SELECT cable_id, document_hash FROM topology WHERE document_hash NOT IN (SELECT document_hash FROM stored WHERE classification = 'circuit_loop')) SELECT document_hash, count(*) AS n, 'topology' AS source FROM l GROUP BY 1 UNION ALL SELECT document_hash, count(DISTINCT cable_id), 'cable_info' FROM l GROUP BY 1",
    "stored_trees": f"WITH {S.DOCUMENTS_SQL} SELECT document_hash, CASE WHEN classification IS NULL THEN 'old ' ELSE 'new ' END || path AS tree_json FROM stored",
    "state_values": "SELECT 'u' || (user_id % 40) AS key, '{\"event_type\":\"' || arg_max(event_type, event_id) || '\"}' AS value FROM events GROUP BY 1 UNION ALL SELECT 'scan', '{\"root\":\"/scan\"}'",
    "state_value": "SELECT coalesce(arg_max(event_type, event_id), 'none') AS event_type FROM events WHERE user_id % 40 = 3",
    "document_folders": f"WITH {S.DOCUMENTS_SQL}, {S.TOPOLOGY_SQL}, p AS (SELECT document_hash, count(*) AS c FROM topology GROUP BY 1), r AS (SELECT string_split(replace(path, '/scan/', ''), '/') AS parts, coalesce(c, 0) AS c FROM stored s LEFT JOIN p ON p.document_hash = s.document_hash), e AS (SELECT parts[1] AS folder, '' AS parent, 1 AS depth, c FROM r UNION ALL SELECT parts[1] || '/' || parts[2], parts[1], 2, c FROM r) SELECT folder, parent, depth, count(*) AS documents, count(*) FILTER (c > 0) AS with_topology, CAST(sum(c) AS BIGINT) AS conductors FROM e GROUP BY 1, 2, 3",
    "document_detail": f"""WITH {S.DOCUMENTS_SQL}, {S.TOPOLOGY_SQL}, t AS (SELECT * FROM topology WHERE document_hash = '7'), x AS (SELECT DISTINCT 'c' || l_suppkey AS id, l_partkey % 1000 AS terminal, l_linestatus AS kind FROM lineitem WHERE l_suppkey % 10 = 7),
      c AS (SELECT 'c' || s_suppkey AS id, (SELECT coalesce(string_agg(terminal, ' ' ORDER BY terminal, kind), '') FROM x WHERE x.id = 'c' || s_suppkey) AS terms FROM supplier WHERE s_suppkey % 10 = 7)
      SELECT document_hash, path, document_type, file_size, (SELECT count(DISTINCT cable_id) FROM t) AS cables, (SELECT count(*) FROM t) AS conductors, (SELECT coalesce(string_agg(DISTINCT source_type, ',' ORDER BY source_type), '') FROM t) AS source_types,
      (SELECT coalesce(string_agg(l, ';' ORDER BY a, n, s, te), '') FROM (SELECT cable_id AS a, coalesce(conductor_no, 0) AS n, strip_name AS s, coalesce(CAST(terminal_no AS VARCHAR), '') AS te, cable_id || ':' || coalesce(conductor_no, 0) || ':' || strip_name || ':' || coalesce(CAST(terminal_no AS VARCHAR), '') AS l FROM t)) AS lines,
      (SELECT count(*) FROM c) AS regions, (SELECT coalesce(string_agg(id || '[' || terms || ']', ';' ORDER BY id || '[' || terms || ']'), '') FROM c) AS cabinets FROM stored WHERE document_hash = '7'""",
    "cable_models": f"WITH {S.TOPOLOGY_SQL} SELECT DISTINCT cable_id, document_hash, 'KVV 4x' || (CAST(substr(cable_id, 3) AS BIGINT) % 5) || '.5' AS model, (CAST(substr(cable_id, 3) AS BIGINT) % 5) || '.5' AS cross_section FROM topology",
    "cable_cabinets": f"""WITH {S.TOPOLOGY_SQL}, f AS (SELECT cable_id, cabinet_name, cabinet_name_remote, source_type, row_number() OVER (PARTITION BY cable_id ORDER BY coalesce(conductor_no, -1), document_hash, coalesce(strip_name, ''), coalesce(terminal_no, -1), coalesce(cabinet_name, ''), coalesce(cabinet_name_remote, '')) AS r, count(*) OVER (PARTITION BY cable_id) AS n, (CAST(substr(cable_id, 3) AS BIGINT) % 5) || '.5' AS x FROM topology)
      SELECT cable_id, CASE WHEN source_type = 'loop' THEN 'KVV 4x' || x ELSE '' END AS model, n AS cable_core_numbers, CASE WHEN source_type = 'loop' THEN x ELSE '' END AS cable_core_cross_section, '' AS cable_core_numbers2, '' AS cable_core_cross_section2, coalesce(cabinet_name, '') AS origin, coalesce(cabinet_name, '') AS origin_cubicle, '' AS origin_device,
      coalesce(cabinet_name_remote, '') AS terminal, coalesce(cabinet_name_remote, '') AS terminal_cubicle, '' AS terminal_device, row_number() OVER (ORDER BY cable_id) AS number FROM f WHERE r = 1""",
    "cabinet_folders": "WITH h AS (SELECT 'C' || (l_suppkey * 2) AS cable, CAST(min(l_orderkey) AS VARCHAR) AS dh FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS row, 'K' || o_custkey AS k, 'C' || (o_orderkey % 300) AS c1, 'C' || o_custkey AS c2 FROM orders) SELECT row, CASE WHEN x.cable IS NOT NULL THEN k || '+' || c1 WHEN y.cable IS NOT NULL THEN k || '+' || c2 END AS folder, coalesce(x.dh, y.dh) AS document_hash, x.cable IS NOT NULL OR y.cable IS NOT NULL AS matched FROM a LEFT JOIN h x ON x.cable = c1 LEFT JOIN h y ON y.cable = c2",
    "copy_targets": f"WITH {S.DOCUMENTS_SQL}, n AS (SELECT path, document_type || '.pdf' AS name, row_number() OVER (PARTITION BY document_type ORDER BY path) - 1 AS k, document_type AS t FROM stored) SELECT path, name, CASE WHEN k = 0 THEN name ELSE t || '_' || k || '.pdf' END AS target FROM n",
    "copy_manifest": f"WITH {S.DOCUMENTS_SQL} SELECT DISTINCT path, document_type || '.x__' || substr(sha256(path), 1, 8) || '.pdf' AS target FROM stored",
    "text_files": "SELECT '/t/c' || conv_id || '.txt' AS target, string_agg(CASE WHEN n > 1 THEN '=== Page ' || turn || ' ===' || chr(10) ELSE '' END || role || chr(9) || chr(9) || 'x', chr(10) ORDER BY turn, role) AS text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id",
    "stage_progress": "WITH s AS (SELECT unnest(['chieng_tess', 'chieng_tess_gauss', 'chisim_tess', 'chisim_tess_gauss', 'chieng_paddle', 'chisim_paddle']) AS stage, generate_series AS k FROM generate_series(0, 0)), l AS (SELECT (['chieng_tess', 'chieng_tess_gauss', 'chisim_tess', 'chisim_tess_gauss', 'chieng_paddle'])[l_linenumber % 5 + 1] AS stage, l_suppkey, l_partkey FROM lineitem) SELECT s.stage, count(DISTINCT l_suppkey) AS done, 1000 AS total, count(l_partkey) AS matches, count(DISTINCT l_partkey) AS cables FROM s LEFT JOIN l ON l.stage = s.stage GROUP BY 1",
    "chosen_text": "SELECT p_partkey, CASE WHEN p_partkey % 90 > 1.3 * p_size AND p_partkey % 90 > 50 THEN p_partkey % 90 + 1 ELSE p_size END AS n, CASE WHEN p_partkey % 90 > 1.3 * p_size AND p_partkey % 90 > 50 THEN 'z' ELSE '屏' END AS first FROM part",
    "ids_in_json": f"WITH {_TARGETS} SELECT target AS id, min(lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS document_hash FROM t JOIN part ON target = 'B' || (p_partkey % 70) || '-' || p_size GROUP BY 1",
    "document_path": f"WITH {S.DOCUMENTS_SQL} SELECT path FROM stored WHERE document_hash = '7'",
    "terminal_strips": f"WITH {S.TOPOLOGY_SQL} SELECT strip_name, min(document_hash) AS document_hash, CASE WHEN starts_with(strip_name, 'A') THEN 'n' || min(document_hash) END AS chinese_name FROM topology GROUP BY 1",
    "truncated_cabinets": "SELECT p_partkey AS id, p_brand AS document_hash, p_name AS display_name, p_size AS x, p_retailprice AS y FROM part WHERE p_name ILIKE '%A%' ORDER BY document_hash, x, y, id LIMIT 50",
    "rule_rows": f"WITH {_RULE_SQL} SELECT p_partkey, m AS matched, CASE WHEN m THEN 'FFFFFF00' END AS fill_argb FROM (SELECT p_partkey, ((steel OR brand) AND NOT size) OR (anyr AND NOT (nonr OR size)) AS m FROM r)",
    "rule_hits": f"WITH {_RULE_SQL} SELECT count(*) FILTER (steel) AS steel, count(*) FILTER (brand) AS brand, count(*) FILTER (size) AS size, count(*) FILTER (anyr) AS any, count(*) FILTER (nonr) AS none FROM r",
}
