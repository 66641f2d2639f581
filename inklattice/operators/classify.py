"""Document classes from keywords, entity counts and text positions, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Business types in the order that breaks ties.
TYPES = ["circuit_loop", "terminal_strip", "cable_schedule", "protection_diagram", "panel_layout", "panel_position", "monitoring_system", "manufacturer_catalog", "unknown"]
# Keywords (+1) and strong markers (+5) of each type.
KEYWORDS = {
    "circuit_loop": (["回路图", "回路", "原理图", "接线图", "WireSerial", "WireDescription", "LoopCode", "WIRENO"], ["回路图", "原理图"]),
    "terminal_strip": (["端子排图", "端子功能", "端子接线"], ["端子排图", "端子功能图"]),
    "cable_schedule": (["电缆清册", "电缆联系", "电缆敷设", "电缆走向", "接线表", "接线清单", "清册"], ["电缆清册", "电缆联系图"]),
    "protection_diagram": (["保护", "测控", "信号回路", "重合闸", "失灵", "差动", "距离", "零序", "监控信号"], ["保护原理图"]),
    "panel_layout": (["屏面布置", "屏柜", "正面", "背面", "前门", "后门"], ["屏面布置图"]),
    "panel_position": (["屏位布置", "屏位图", "屏位编号", "屏位表"], ["屏位布置图", "屏位图"]),
    "monitoring_system": (["状态监测", "在线监测", "监测系统", "通风控制", "SF6", "密度监测", "密度在线", "局放", "温度监测"], ["状态监测系统", "通风控制系统"]),
    "manufacturer_catalog": (["厂家图册", "厂家资料", "产品说明书", "安装使用说明书", "技术资料", "产品样本", "产品目录", "使用手册"], ["厂家图册", "产品说明书", "安装使用说明书"]),
    "unknown": (["目录", "封面", "卷册说明", "总说明", "编制说明", "设计说明", "工艺执行", "材料清册", "设备材料"], ["目录", "卷册说明"]),
}
# Tags that double a text's keyword hit.
TAG_HINTS = {"circuit_loop": ["WireSerial", "WireDescription", "LoopCode", "WIRENO", "InOut"], "terminal_strip": ["NO", "EQUNAME", "TERMINAL"]}
# Weights of the three classifiers.
WEIGHTS = {"keyword": 0.55, "geometry": 0.30, "layout": 0.15}


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w.lower())
    return out


def keyword_scores(texts: DataFrame, keywords: dict | None = None, key: str = "document_hash") -> DataFrame:
    """One score column per type: min(log1p(points) / log1p(5), 1).  texts: key, text, tag (may be missing)."""
    table = KEYWORDS if keywords is None else keywords
    low, sums = F.lower("text"), []
    tag = F.col("tag") if "tag" in texts.columns else F.lit(None).cast("string")
    for name, (words, strong) in table.items():
        one = F.when(F.coalesce(tag.isin(TAG_HINTS.get(name, [])), F.lit(False)), 2).otherwise(1) if TAG_HINTS.get(name) else F.lit(1)
        points = F.when(_any(low, strong), 5).otherwise(0) + F.when(_any(low, words), one).otherwise(0)
        sums.append(F.sum(points).alias(name))
    out = texts.groupBy(key).agg(*sums)
    return out.select(key, *[F.least(F.log1p(F.col(n)) / F.log1p(F.lit(5.0)), F.lit(1.0)).alias(n) for n in table])


def entity_counts(entities: DataFrame) -> DataFrame:
    """One row per document: counts of kinds, horizontal and vertical lines, lines with extended data."""
    span = lambda axis: F.array_max(F.transform("points", lambda p: p[axis])) - F.array_min(F.transform("points", lambda p: p[axis]))
    line = F.col("kind") == "LINE"
    flat, up = line & (span("y") < 1.0), line & ~(span("y") < 1.0) & (span("x") < 1.0)
    n = lambda c, a: F.count_if(F.coalesce(c, F.lit(False))).cast("double").alias(a)
    kind = lambda k: F.col("kind") == k
    return entities.groupBy("document_hash").agg(
        n(F.lit(True), "total"), n(kind("TEXT"), "text"), n(kind("ATTRIB"), "attr"), n(kind("INSERT"), "block"), n(kind("CIRCLE"), "circ"), n(kind("ARC"), "arc"),
        n(line, "line"), n(flat, "h"), n(up, "v"), n(line & (F.size("eed") > 0), "eed"),
    )


def geometry_scores(counts: DataFrame) -> DataFrame:
    """Eight ratio formulas over entity counts, each within 0 and 1."""
    c = F.col
    per_line = lambda x: F.when(c("line") > 0, x / c("line")).otherwise(F.lit(0.0))
    per_all = lambda x: F.when(c("total") > 0, x / c("total")).otherwise(F.lit(0.0))
    cap = lambda x: F.least(x, F.lit(1.0))
    h, v, attr, eed, ac = (per_line(x) for x in (c("h"), c("v"), c("attr"), c("eed"), c("arc") + c("circ")))
    line, text, block = (per_all(c(x)) for x in ("line", "text", "block"))
    rules = {
        "circuit_loop": ((h > 0.7) & (attr > 0.3) & (attr <= 4), 0.4 * h + 0.4 * cap(attr / 3) + 0.2 * cap(c("attr") / 30)),
        "terminal_strip": ((v > 0.5) & (eed > 0.5), 0.4 * v + 0.4 * eed + 0.2 * cap(c("v") / 20)),
        "cable_schedule": ((c("total") >= 20) & (text > 0.85) & (line < 0.05), text),
        "protection_diagram": ((ac > 0.05) & (ac < 0.5) & (c("attr") > 0), 0.5 * cap(4 * ac) + 0.3 * cap(c("attr") / 20) + 0.2 * cap(c("line") / 100)),
        "panel_layout": ((block > 0.3) & (line < 0.4), 0.5 * cap(2 * block) + 0.3 * cap(c("block") / 30) + 0.2 * cap(c("text") / 50)),
        "panel_position": ((c("line") > 0) & (c("total") >= 50) & (line > 0.5) & (text > 0.05) & (h > 0.5) & (c("eed") == 0) & (c("circ") < 5), 0.35 * cap(1.2 * line) + 0.25 * cap(3 * text) + 0.25 * cap(h) + 0.15 * (1 - cap(v))),
        "monitoring_system": ((block > 0.15) & (block < 0.5) & (line > 0.15) & (line < 0.5) & (text > 0.1) & (text < 0.6), 0.5 * F.greatest(1 - F.abs(block - 0.3) - F.abs(line - 0.3), F.lit(0.0)) + 0.5 * cap((c("block") + c("line") + c("text")) / 50)),
        "unknown": ((c("total") < 30) & (c("text") > 5), 0.5 + 0.5 * (1 - cap(c("total") / 30))),
    }
    return counts.select("document_hash", *[F.when(test, cap(score)).otherwise(F.lit(0.0)).alias(k) for k, (test, score) in rules.items()])


def position_scores(points: DataFrame, key: str = "document_hash") -> DataFrame:
    """Scores from where texts stand: quadrants, balance, rows, outer bands.  Fewer than five points give zeros."""
    box = points.groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").cast("double").alias("n"), F.countDistinct(F.bround("y")).cast("double").alias("rows"))
    p = points.select(key, "x", "y").join(box, key)
    east, north = F.col("x") > (F.col("x0") + F.col("x1")) / 2, F.col("y") > (F.col("y0") + F.col("y1")) / 2
    w, hgt = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    outer = (F.col("x") < F.col("x0") + 0.2 * w) | (F.col("x") > F.col("x1") - 0.2 * w) | (F.col("y") < F.col("y0") + 0.2 * hgt) | (F.col("y") > F.col("y1") - 0.2 * hgt)
    share = lambda c, a: (F.count_if(c) / F.first("n")).alias(a)
    q = p.groupBy(key).agg(F.first("n").alias("n"), F.first("rows").alias("rows"), share(east & ~north, "se"), share(east & north, "ne"), share(~east & ~north, "sw"), share(~east & north, "nw"), share(outer, "m"))
    q = q.withColumn("bal", 1 - (F.abs(F.col("se") - 0.25) + F.abs(F.col("ne") - 0.25) + F.abs(F.col("sw") - 0.25) + F.abs(F.col("nw") - 0.25))).withColumn("maxq", F.greatest("se", "ne", "sw", "nw")).withColumn("rn", F.col("rows") / F.col("n"))
    c, cap = F.col, lambda x, t=1.0: F.least(x, F.lit(t))
    lower_right = c("se") > 0.45
    grid = ~lower_right & (c("n") > 50) & (c("bal") > 0.35) & (c("bal") < 0.7) & (c("rn") > 0.15) & (c("rn") < 0.5)
    even = c("bal") > 0.7
    zero = F.lit(0.0)
    scores = {
        "circuit_loop": F.when(even, cap((c("bal") - 0.7) / 0.3)).otherwise(zero),
        "terminal_strip": F.when((c("m") > 0.55) & (c("rn") < 0.4), cap(0.5 * cap((c("m") - 0.55) / 0.3) + 0.5 * cap(c("rows") / 20))).otherwise(zero),
        "cable_schedule": F.when((c("rn") > 0.5) & (c("n") > 20) & (c("n") / c("rows") > 1.5) & (c("n") / c("rows") < 8), cap(0.5 * cap(c("rn")) + 0.5 * cap(c("rows") / 50))).otherwise(zero),
        "protection_diagram": F.when(even, cap((c("bal") - 0.7) / 0.5, 0.5)).otherwise(zero),
        "panel_layout": F.when(lower_right, cap((c("se") - 0.45) / 0.3)).otherwise(zero),
        "panel_position": F.when(lower_right, cap((c("se") - 0.45) / 0.35, 0.7)).when(grid, cap(0.5 * cap((c("bal") - 0.35) / 0.2) + 0.5 * cap(c("rn") / 0.3))).otherwise(zero),
        "monitoring_system": F.when(even, cap((c("bal") - 0.7) / 0.5, 0.6)).otherwise(zero),
        "unknown": F.when(c("maxq") > 0.7, cap((c("maxq") - 0.7) / 0.2)).otherwise(zero),
    }
    return q.select(key, *[F.when(c("n") >= 5, x).otherwise(zero).alias(k) for k, x in scores.items()])


# Texts that mark catalogues and position plans, and the types that a catalogue is not.
CATALOGUE_MARKS, POSITION_MARKS = ("厂家图册", "产品说明书", "安装使用说明书"), ("屏位布置图", "屏位图")
NOT_IN_CATALOGUES = ("circuit_loop", "terminal_strip", "protection_diagram", "panel_position")


def text_marks(texts: DataFrame, key: str = "document_hash", catalogue: tuple[str, ...] = CATALOGUE_MARKS, position: tuple[str, ...] = POSITION_MARKS) -> DataFrame:
    """Whether any text of a document marks a catalogue or a position plan: key, catalogue, position."""
    held = lambda marks: F.coalesce(F.max(_any_exact(F.coalesce("text", F.lit("")), marks)), F.lit(False))
    return texts.groupBy(key).agg(held(catalogue).alias("catalogue"), held(position).alias("position"))


def _any_exact(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def combine(keyword: DataFrame, geometry: DataFrame | None = None, layout: DataFrame | None = None, key: str = "document_hash", types: list[str] | None = None, marks: DataFrame | None = None) -> DataFrame:
    """primary, confidence (4 places), secondary (ranks 2 to 4 over 0.05), signals (type -> weighted sum).

    Weighted sums over their maximum; confidence min(0.7 p + 0.3 margin, 1).  A catalogue's mark adds 5 to that type
    and takes four others to 0, with confidence 1.  Without it, sums of under 0.10 in all are unknown with confidence
    0; a protection diagram with a position plan's mark is a position plan, with confidence 0.8 p + 0.2 and the three best others.
    """
    types = TYPES if types is None else types
    out, parts = keyword.select(key, *[F.col(t).alias(f"keyword_{t}") for t in types if t in keyword.columns]), [("keyword", keyword)]
    for name, df in (("geometry", geometry), ("layout", layout)):
        if df is not None:
            out = out.join(df.select(key, *[F.col(t).alias(f"{name}_{t}") for t in types if t in df.columns]), key, "left")
            parts.append((name, df))
    if marks is not None:
        out = out.join(marks.select(key, "catalogue", "position"), key, "left")
    false = F.lit(False)
    catalogue = F.coalesce("catalogue", false) if marks is not None and "manufacturer_catalog" in types else false
    position = F.coalesce("position", false) if marks is not None and "panel_position" in types else false

    def total(t: str) -> Column:
        s = F.lit(0.0)
        for name, df in parts:
            if t in df.columns:
                s = s + WEIGHTS[name] * F.coalesce(F.col(f"{name}_{t}"), F.lit(0.0))
        return s

    def marked(t: str) -> Column:
        if t == "manufacturer_catalog":
            return F.when(catalogue, total(t) + 5.0).otherwise(total(t))
        return F.when(catalogue, F.lit(0.0)).otherwise(total(t)) if t in NOT_IN_CATALOGUES else total(t)

    raw = F.array(*[F.struct(marked(t).alias("score"), F.lit(-k).alias("ord"), F.lit(t).alias("type")) for k, t in enumerate(types)])
    signals = F.create_map(*[x for t in types for x in (F.lit(t), F.round(total(t), 4))])
    out = out.select(key, catalogue.alias("is_catalogue"), position.alias("is_position"), F.reverse(F.array_sort(raw)).alias("ranked"), signals.alias("signals"))
    top = F.col("ranked")[0]["score"]
    norm = out.withColumn("sum", F.aggregate("ranked", F.lit(0.0), lambda acc, r: acc + r.score)).withColumn("top", top)
    norm = norm.withColumn("ranked", F.transform("ranked", lambda r: F.struct(F.when(F.col("top") > 0, r.score / F.col("top")).otherwise(F.lit(0.0)).alias("score"), r.type.alias("type"))))
    p, second = F.col("ranked")[0]["score"], F.col("ranked")[1]["score"]
    low = (F.col("sum") < 0.10) & ~F.col("is_catalogue")
    plan = ~low & ~F.col("is_catalogue") & F.col("is_position") & (F.col("ranked")[0]["type"] == "protection_diagram")
    own = F.coalesce(F.get(F.filter("ranked", lambda r: r.type == "panel_position"), F.lit(0)).score, F.lit(0.0))
    margin = F.when(p > 0, F.least(0.7 * p + 0.3 * (p - second), F.lit(1.0))).otherwise(p)
    names = lambda c: F.transform(c, lambda r: r.type)
    return norm.select(
        key,
        F.when(low, "unknown").when(plan, "panel_position").otherwise(F.col("ranked")[0]["type"]).alias("primary"),
        F.round(F.when(F.col("is_catalogue"), 1.0).when(low, 0.0).when(plan, F.least(0.8 * own + 0.2, F.lit(1.0))).otherwise(margin), 4).alias("confidence"),
        F.when(low, F.array().cast("array<string>")).when(plan, names(F.slice(F.filter("ranked", lambda r: r.type != "panel_position"), 1, 3))).otherwise(names(F.filter(F.slice("ranked", 2, 3), lambda r: r.score > 0.05))).alias("secondary"),
        "signals",
    )


def classify_documents(entities: DataFrame) -> DataFrame:
    """Classes of whole documents from their entities: keywords, counts, positions and marks.

    One grouping each of texts, entities and points; a document without texts is classified by its shapes.
    """
    texts = entities.filter("kind IN ('TEXT', 'ATTRIB')").select("document_hash", "text", "tag", "x", "y")
    shown = texts.withColumn("text", F.coalesce("text", F.lit(""))).filter(r"NOT (text rlike '^\\s*$' AND coalesce(tag, '') rlike '^\\s*$')")
    words = keyword_scores(shown)
    every = entity_counts(entities)
    keyword = every.select("document_hash").join(words, "document_hash", "left").na.fill(0.0)
    points = texts.filter("x IS NOT NULL AND y IS NOT NULL AND trim(coalesce(text, '')) <> ''")
    return combine(keyword, geometry_scores(every), position_scores(points), marks=text_marks(texts))


# Words of paths and of texts that name a class, in order.
PATH_WORDS, TEXT_WORDS = [("端子排", "terminal_strip"), ("回路图", "circuit_loop")], [("端子排图", "terminal_strip"), ("回路图", "circuit_loop")]


def class_by_name(paths: DataFrame, texts: DataFrame, key: str = "document_hash") -> DataFrame:
    """The class that a path names, else that of the first text that names one, else unknown.  paths: key, path; texts: key, seq, text."""

    def named(c: Column, words: list[tuple[str, str]]) -> Column:
        out = F.lit(None).cast("string")
        for word, kind in reversed(words):
            out = F.when(F.lower(c).contains(word), F.lit(kind)).otherwise(out)
        return out

    first = texts.select(key, "seq", named(F.col("text"), TEXT_WORDS).alias("kind")).filter("kind IS NOT NULL").groupBy(key).agg(F.min_by("kind", "seq").alias("by_text"))
    return paths.join(first, key, "left").select(key, F.coalesce(named(F.col("path"), PATH_WORDS), "by_text", F.lit("unknown")).alias("kind"))


def classification_json(classes: DataFrame, key: str = "document_hash") -> DataFrame:
    """Classes as JSON: primary, confidence, secondary, signals."""
    return classes.select(key, F.to_json(F.struct("primary", F.round("confidence", 4).alias("confidence"), "secondary", "signals")).alias("json"))
