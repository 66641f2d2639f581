"""Classification and text functions on the driver's tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inklattice.functions import text as T
from inklattice.operators import classify, graphs, rules, shapes
from inklattice.operators.grouped import per_document
from inklattice.plans import stand_ins as S
from inklattice.sources import sinks, tables

#: Words of the driver's texts in place of drawing keywords.
STAND_IN = {"circuit_loop": (["the of", "tion"], ["license"]), "terminal_strip": (["und"], ["zu und"]), "cable_schedule": (["que"], ["los los"]), "unknown": (["sh"], ["!!"])}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return classify.keyword_scores(S.texts(spark, d), STAND_IN)


def keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.select("document_hash", *[F.round(c, 8).alias(c) for c in STAND_IN])


def composite_classes(spark: SparkSession, d: str) -> DataFrame:
    out = classify.combine(_scores(spark, d), types=list(STAND_IN))
    return out.select("document_hash", "primary", "confidence", F.array_join("secondary", ",").alias("secondary"))


def text_positions(spark: SparkSession, d: str) -> DataFrame:
    p = S.points(spark, d).withColumn("document_hash", (F.col("seq") % 17).cast("string"))
    s = classify.position_scores(p)
    return s.select("document_hash", *[F.round(c, 8).alias(c) for c in s.columns if c != "document_hash"])


def cable_ids_in_text(spark: SparkSession, d: str) -> DataFrame:
    return S.texts(spark, d).select(F.explode(T.cable_ids(F.col("text"))).alias("cable")).distinct()


def parse_strip_terminal(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.lit(":")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string"))).alias("t"))
    s, n = T.strip_and_terminal(F.col("t"))
    return o.select("o_orderkey", s.alias("strip"), n.alias("terminal"))


def normalized_contains(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    return docs.filter(F.lower(T.collapsed(F.col("text"))).contains("and the")).select("doc_id")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.split(F.regexp_replace("path", "^/scan/", ""), "/")
    return S.stored_documents(spark, d).groupBy(p[0].alias("top"), p[1].alias("sub")).agg(F.count("*").alias("n"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    h = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), "doc_id")
    return h.groupBy(F.substring("h", 1, 16).alias("hash16")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def json_state(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def column_roles(spark: SparkSession, d: str) -> DataFrame:
    """The fold over columns of up to six texts whose kinds and order vary with the order."""
    o = S.table(spark, d, "orders")
    number, other = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 50).cast("string")
    texts = F.array(
        F.when(F.col("o_orderkey") % 3 > 0, F.lit("--")), F.when(F.col("o_orderkey") % 4 > 0, number), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("AB-"), number)), other,
        F.when(F.col("o_orderkey") % 2 > 0, F.concat(F.lit("K"), other)), F.col("o_orderstatus"),
    )
    r = T.column_text_roles(F.filter(texts, lambda t: t.isNotNull()))
    return o.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.*")


def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of conversations whose turns are parted by blank lines here and there."""
    t = _joined(spark, d)
    return t.select("conv_id", F.posexplode(T.paragraphs(F.col("text"))).alias("k", "paragraph"))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, F.lit(" \n")).otherwise(F.lit("")), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), F.lit("{")).alias("line"), "role")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "line"))), lambda x: x.line), "\n").alias("text"))


def code_like_texts(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("conv_id", T.code_like(F.col("text")).alias("code"))


def class_by_name(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    kinds = F.array(F.lit("x"), F.lit("端子排图"), F.lit("回路图"), F.lit("端子排"))
    paths = p.select(F.col("p_partkey").alias("document_hash"), F.concat(F.lit("/"), F.when(F.col("p_size") % 7 == 0, F.lit("端子排")).when(F.col("p_size") % 7 == 1, F.lit("回路图")).otherwise(F.lit("q")), F.lit(".dwg")).alias("path"))
    texts = p.select(F.col("p_partkey").alias("document_hash"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"), "p_size").withColumn("text", F.element_at(kinds, ((F.col("p_size") + F.col("seq") * F.col("document_hash")) % 4 + 1).cast("int")))
    return classify.class_by_name(paths, texts)


def classification_json(spark: SparkSession, d: str) -> DataFrame:
    """Class and confidence read back from the JSON form."""
    out = classify.classification_json(classify.combine(_scores(spark, d), types=list(STAND_IN)))
    read = F.from_json("json", "primary string, confidence double, secondary array<string>, signals map<string,double>")
    return out.select("document_hash", read.alias("r")).select("document_hash", F.col("r.primary").alias("primary"), F.col("r.confidence").alias("confidence"), F.array_join("r.secondary", ",").alias("secondary"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers as nodes, line items as edges between them."""
    p = S.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.lit("TAG").alias("type"), F.col("p_brand").alias("layer"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 100).cast("double").alias("y"))
    s = S.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("CABINET").alias("type"), F.lit("Brand#11").alias("layer"), F.lit(0.0).alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    e = S.table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("type"))
    return p.unionByName(s), e


def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graphs.neighbors(nodes, edges, graphs.of_layer(graphs.of_type(nodes, "TAG"), "Brand#11"), "N").groupBy("of", "node_id", "type").agg(F.count("*").alias("n"))


def graph_incoming(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graphs.incoming(nodes, edges, graphs.of_type(nodes, "CABINET")).groupBy("of", "edge_type").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("nodes"))


def graph_within(spark: SparkSession, d: str) -> DataFrame:
    return graphs.within(_graph(spark, d)[0], 10.0, 10.0, 12.5, "TAG").select("node_id")


def rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table as cells, by rules with a Python function."""
    rows = tables.as_cells(S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey")
    r = rules.Rules({"open": {"column": "A", "match": "equals:O"}, "even": {"column": 2, "match": {"type": "py", "function": "even"}}}, functions={"even": lambda cell: int(cell) % 2 == 0})
    return r.apply(rows, "open & even").select("o_orderkey", "matched")


def real_texts(spark: SparkSession, d: str) -> DataFrame:
    t = S.texts(spark, d).withColumn("text", F.when(F.col("seq") == 0, F.concat(F.lit("<"), "text")).otherwise(F.col("text")))
    return t.filter(T.is_real_text(F.col("text"))).groupBy("document_hash").agg(F.count("*").alias("n"))


def organized_files(spark: SparkSession, d: str) -> DataFrame:
    files = S.table(spark, d, "documents").select(F.concat(F.lit("/in/"), "lang", F.lit("/"), "source", F.lit(".pdf")).alias("name"), "doc_id", "text")
    files = files.groupBy(F.col("name").alias("path")).agg(F.min_by("text", "doc_id").alias("text"))
    return sinks.organize_manifest(files, "and  THE", "/in/out", ignore_case=True)


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Free texts of planted position plans that hold a string, and all of them joined."""
    from inklattice.plans import planted as P

    def run(rows: list[dict]) -> list[dict]:
        return [{"found": len(shapes.find_text(rows, "表")), "lines": shapes.document_text(rows).count("\n") + 1, "inside": shapes.count_texts(rows, (599.0, 0.0, 2.0, 400.0)), "short": len(shapes.collected(rows, None, 2)), "near": len(shapes.texts_near(shapes.words_of(rows), 700.0, 250.0, 60.0))}]

    return per_document(P.plans(spark, d), run, "document_hash string, found int, lines int, inside int, short int, near int, error string").drop("error")


QUERIES = {f.__name__: f for f in (keyword_classes, composite_classes, text_positions, cable_ids_in_text, parse_strip_terminal, normalized_contains, path_parts, content_hashes, json_state, column_roles, text_paragraphs, code_like_texts, class_by_name, classification_json, graph_neighbors, graph_incoming, graph_within, rule_table, real_texts, organized_files, document_texts)}


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_SUMS = ", ".join(f"round(least(ln(1 + sum(CASE WHEN {_any(s)} THEN 5 ELSE 0 END + CASE WHEN {_any(w)} THEN 1 ELSE 0 END)) / ln(6.0), 1.0), {{r}}) AS {k}" for k, (w, s) in STAND_IN.items())
_KEY = f"WITH {S.TEXTS_SQL}, k AS (SELECT document_hash, {_SUMS.format(r=15)} FROM texts GROUP BY 1)"
_LINE = "CASE WHEN turn % 2 = 0 THEN ' ' || chr(10) ELSE '' END || replace(coalesce(text, ''), chr(10), ' ') || chr(123)"
_JOINED = f"j AS (SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY turn, role, {_LINE}) AS text FROM conversations GROUP BY 1)"
_POSITIONS = f"""WITH {S.POINTS_SQL}, p AS (SELECT CAST(seq % 17 AS VARCHAR) AS document_hash, x, y FROM points),
  b AS (SELECT document_hash, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT round_even(y, 0)) AS DOUBLE) AS rows FROM p GROUP BY 1),
  m AS (SELECT p.*, b.n, b.rows, x > (x0 + x1) / 2 AS east, y > (y0 + y1) / 2 AS north, x < x0 + 0.2 * (x1 - x0) OR x > x1 - 0.2 * (x1 - x0) OR y < y0 + 0.2 * (y1 - y0) OR y > y1 - 0.2 * (y1 - y0) AS margin FROM p JOIN b ON b.document_hash = p.document_hash),
  q AS (SELECT document_hash, any_value(n) AS n, any_value(rows) AS rows, any_value(rows) / any_value(n) AS rn, count(*) FILTER (east AND NOT north) / any_value(n) AS se, count(*) FILTER (east AND north) / any_value(n) AS ne, count(*) FILTER (NOT east AND NOT north) / any_value(n) AS sw, count(*) FILTER (NOT east AND north) / any_value(n) AS nw, count(*) FILTER (margin) / any_value(n) AS m FROM m GROUP BY 1),
  s AS (SELECT *, 1 - (abs(se - 0.25) + abs(ne - 0.25) + abs(sw - 0.25) + abs(nw - 0.25)) AS bal, greatest(se, ne, sw, nw) AS mq FROM q)
  SELECT document_hash, round(CASE WHEN n >= 5 AND bal > 0.7 THEN least((bal - 0.7) / 0.3, 1.0) ELSE 0 END, 8) AS circuit_loop,
  round(CASE WHEN n >= 5 AND m > 0.55 AND rn < 0.4 THEN least(0.5 * least((m - 0.55) / 0.3, 1.0) + 0.5 * least(rows / 20, 1.0), 1.0) ELSE 0 END, 8) AS terminal_strip,
  round(CASE WHEN n >= 5 AND rn > 0.5 AND n > 20 AND n / rows > 1.5 AND n / rows < 8 THEN least(0.5 * least(rn, 1.0) + 0.5 * least(rows / 50, 1.0), 1.0) ELSE 0 END, 8) AS cable_schedule,
  round(CASE WHEN n >= 5 AND bal > 0.7 THEN least((bal - 0.7) / 0.5, 0.5) ELSE 0 END, 8) AS protection_diagram,
  round(CASE WHEN n >= 5 AND se > 0.45 THEN least((se - 0.45) / 0.3, 1.0) ELSE 0 END, 8) AS panel_layout,
  round(CASE WHEN n < 5 THEN 0 WHEN se > 0.45 THEN least((se - 0.45) / 0.35, 0.7) WHEN n > 50 AND bal > 0.35 AND bal < 0.7 AND rn > 0.15 AND rn < 0.5 THEN least(0.5 * least((bal - 0.35) / 0.2, 1.0) + 0.5 * least(rn / 0.3, 1.0), 1.0) ELSE 0 END, 8) AS panel_position,
  round(CASE WHEN n >= 5 AND bal > 0.7 THEN least((bal - 0.7) / 0.5, 0.6) ELSE 0 END, 8) AS monitoring_system, round(CASE WHEN n >= 5 AND mq > 0.7 THEN least((mq - 0.7) / 0.2, 1.0) ELSE 0 END, 8) AS unknown FROM s"""
ORACLE_SQL = {
    "keyword_classes": f"WITH {S.TEXTS_SQL} SELECT document_hash, {_SUMS.format(r=8)} FROM texts GROUP BY 1",
    "composite_classes": _KEY
    + ", u AS (SELECT document_hash, unnest([{'t': 'circuit_loop', 'o': 0, 's': 0.55 * circuit_loop}, {'t': 'terminal_strip', 'o': 1, 's': 0.55 * terminal_strip}, {'t': 'cable_schedule', 'o': 2, 's': 0.55 * cable_schedule}, {'t': 'unknown', 'o': 3, 's': 0.55 * unknown}], recursive := true) FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY document_hash ORDER BY s DESC, o) AS n, max(s) OVER (PARTITION BY document_hash) AS top FROM u), q AS (SELECT *, CASE WHEN top > 0 THEN s / top ELSE 0 END AS p FROM r) SELECT document_hash, CASE WHEN sum(s) < 0.10 THEN 'unknown' ELSE max(t) FILTER (n = 1) END AS primary, round(CASE WHEN sum(s) < 0.10 THEN 0.0 ELSE least(0.7 * max(p) FILTER (n = 1) + 0.3 * (max(p) FILTER (n = 1) - max(p) FILTER (n = 2)), 1.0) END, 4) AS confidence, CASE WHEN sum(s) < 0.10 THEN '' ELSE coalesce(string_agg(t, ',' ORDER BY n) FILTER (n > 1 AND n <= 4 AND p > 0.05), '') END AS secondary FROM q GROUP BY 1",
    "cable_ids_in_text": f"WITH {S.TEXTS_SQL} SELECT DISTINCT unnest(regexp_extract_all(text, '\\b([A-Za-z0-9]{{2,8}}-[A-Za-z0-9]{{1,8}})\\b', 1)) AS cable FROM texts",
    "parse_strip_terminal": "WITH o AS (SELECT o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ':' END || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS t FROM orders) SELECT o_orderkey, split_part(t, ':', 1) AS strip, CASE WHEN contains(t, ':') AND regexp_full_match(split_part(t, ':', 2), '[0-9]+') THEN CAST(split_part(t, ':', 2) AS INT) END AS terminal FROM o",
    "normalized_contains": "SELECT doc_id FROM documents WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'and the')",
    "path_parts": "SELECT source AS top, lang AS sub, count(*) AS n FROM documents GROUP BY 1, 2",
    "content_hashes": "SELECT substr(sha256(text), 1, 16) AS hash16, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "text_positions": _POSITIONS,
    "text_paragraphs": f"WITH {_JOINED}, g AS (SELECT conv_id, list_filter(string_split_regex(regexp_replace(text, '^( ?\n)+', ''), '\n( ?\n)+'), lambda x: trim(x) <> '') AS p, len(string_split(text, chr(10))) AS n, text FROM j), h AS (SELECT conv_id, CASE WHEN len(p) < 3 AND n > 10 THEN [text] ELSE p END AS p FROM g) SELECT conv_id, CAST(unnest(generate_series(0, len(p) - 1)) AS INT) AS k, unnest(p) AS paragraph FROM h",
    "code_like_texts": f"WITH {_JOINED} SELECT conv_id, len(list_filter(string_split(text, chr(10))[1:20], lambda x: regexp_matches(x, 'import |def |class |function |[{{}};]|//|/\\*|\\*/|#include'))) >= 3 AS code FROM j",
    "class_by_name": "WITH t AS (SELECT p_partkey AS document_hash, p_size, generate_series AS seq, (['x', '端子排图', '回路图', '端子排'])[(p_size + generate_series * p_partkey) % 4 + 1] AS text FROM part, generate_series(0, 2)), f AS (SELECT document_hash, arg_min(CASE WHEN contains(text, '端子排图') THEN 'terminal_strip' ELSE 'circuit_loop' END, seq) AS k FROM t WHERE contains(text, '端子排图') OR contains(text, '回路图') GROUP BY 1) SELECT p_partkey AS document_hash, CASE WHEN p_size % 7 = 0 THEN 'terminal_strip' WHEN p_size % 7 = 1 THEN 'circuit_loop' ELSE coalesce(k, 'unknown') END AS kind FROM part LEFT JOIN f ON f.document_hash = p_partkey",
    "graph_neighbors": "SELECT 'p' || l_partkey AS of, 's' || l_suppkey AS node_id, 'CABINET' AS type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_brand = 'Brand#11' AND l_returnflag = 'N' GROUP BY 1, 2",
    "graph_incoming": "SELECT 's' || l_suppkey AS of, l_returnflag AS edge_type, count(*) AS n, count(DISTINCT l_partkey) AS nodes FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2",
    "graph_within": "SELECT 'p' || p_partkey AS node_id FROM part WHERE (p_size - 10) * (p_size - 10) + (p_partkey % 100 - 10) * (p_partkey % 100 - 10) <= 156.25",
    "rule_table": "SELECT o_orderkey, o_orderstatus = 'O' AND o_custkey % 2 = 0 AS matched FROM orders",
    "real_texts": f"WITH {S.TEXTS_SQL} SELECT document_hash, count(*) AS n FROM texts WHERE seq > 0 AND NOT starts_with(text, '<') GROUP BY 1",
    "organized_files": "WITH f AS (SELECT '/in/' || lang || '/' || source || '.pdf' AS path, source, arg_min(text, doc_id) AS text FROM documents GROUP BY 1, 2), m AS (SELECT path, source, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS k FROM f WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'and the')) SELECT path, '/in/out/' || source || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.pdf' AS target FROM m",
    "document_texts": "SELECT 'R' || p_partkey AS document_hash, 1 AS found, 2 * n + 5 + 3 * n + CASE WHEN p_size > 20 THEN n ELSE 0 END AS lines, n + 1 AS inside, n + 18 AS short, 11 + CASE WHEN p_size > 20 THEN 2 ELSE 0 END AS near FROM (SELECT *, p_size % 8 + 6 AS n FROM part)",
    "json_state": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    # Loop-like texts (AB-<n>, K<n> of one or two digits) fill loop, description, unknown; -- takes unknown first; the status is a description.
    "column_roles": """WITH x AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS n, CAST(o_orderkey % 50 AS VARCHAR) AS t, o_orderstatus AS s FROM orders),
      y AS (SELECT *, CASE WHEN k % 3 > 0 THEN '--' END AS dash, [u FOR u IN [CASE WHEN k % 5 > 0 THEN 'AB-' || n END, CASE WHEN k % 2 > 0 THEN 'K' || t END] IF u IS NOT NULL] AS l FROM x),
      z AS (SELECT *, CASE WHEN len(l) > 1 THEN [l[2], s] ELSE [s] END AS d FROM y)
      SELECT k AS o_orderkey, CASE WHEN k % 4 > 0 THEN n ELSE t END AS terminal_no, l[1] AS loop_id, d[1] AS circuit_desc, CASE WHEN dash IS NOT NULL THEN dash ELSE d[2] END AS unknown FROM z""",
}

ORACLE_SQL["classification_json"] = ORACLE_SQL["composite_classes"]
