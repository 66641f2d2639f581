"""Upserts, deletes, state and the queries over the stored tables, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inklattice.operators.spatial import held


# --- writes -------------------------------------------------------------------------------------------------
def last_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in order.  Pre-aggregates before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def first_write_fills(rows: DataFrame, key: str, order: list[str], fill: list[str]) -> DataFrame:
    """One row per key: the first in order, whose null ``fill`` columns take the first later value."""
    rest = [c for c in rows.columns if c != key and c not in fill]
    when = F.struct(*order)
    first = [F.min_by(F.struct(*rest), when).alias("_r")]
    filled = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), when)).alias(c) for c in fill]
    out = rows.groupBy(key).agg(*first, *filled)
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest], *fill).select(*rows.columns)


def partial_update(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Upsert that leaves the ``keep`` columns of rows that exist."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    both = o.join(n, key, "full_outer")
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in keep:
            cols.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*cols)


def replace_documents(old: DataFrame, new: DataFrame, processed: DataFrame, key: str = "document_hash") -> DataFrame:
    """Delete by document, then insert: rows of processed documents go, the new ones come."""
    return old.join(processed.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def append_state(state: DataFrame, additions: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Set-like lists by key in order of first insertion: what is held, then additions by ``order`` (columns of additions) and place."""
    held = state.select("key", F.lit(0).alias("_step"), F.lit(None).cast("array<string>").alias("_at"), F.posexplode("values").alias("_pos", "v"))
    at = F.array(*[F.lpad(F.col(c).cast("string"), 20, "0") for c in order]) if order else F.lit(None).cast("array<string>")
    new = additions.select("key", F.lit(1).alias("_step"), at.alias("_at"), F.posexplode("values").alias("_pos", "v"))
    first = held.union(new).groupBy("key", "v").agg(F.min(F.struct("_step", "_at", "_pos")).alias("f"))
    out = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x.v).alias("values"))
    keys = state.select("key").union(additions.select("key")).distinct()
    return keys.join(out, "key", "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def set_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of JSON values by key; the last change of a key wins.  state: key, value; changes: key, value, seq."""
    last = last_write_wins(changes, ["key"], ["seq"]).select("key", "value")
    return state.join(last.select("key"), "key", "left_anti").select("key", "value").unionByName(last)


def get_state(state: DataFrame, key: str, schema: str, default: object = None) -> DataFrame:
    """The value of a key read by a schema; a missing key or bad JSON gives the default (JSON text or None)."""
    value = F.from_json(F.max("value"), schema)
    out = state.filter(F.col("key") == key).agg(value.alias("value"))
    return out if default is None else out.select(F.coalesce("value", F.from_json(F.lit(default), schema)).alias("value"))


def append_rows(rows: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows in a table's columns and types, with defaults (else nulls) for those that they lack; to be written in append mode."""
    given = {**{c: None for c in columns}, **(defaults or {})}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(given[c])).cast(t).alias(c) for c, t in columns.items()])


def delete_documents(tables: dict[str, DataFrame], processed: DataFrame, key: str = "document_hash") -> dict[str, DataFrame]:
    """Tables without the rows of processed documents; where topology goes, cable_info goes with it."""
    gone = processed.select(key).distinct()
    return {name: rows.join(gone, key, "left_anti").select(*rows.columns) for name, rows in tables.items()}


def upsert_trees(stored: DataFrame, trees: DataFrame) -> DataFrame:
    """JSON trees by document: new ones take the place of stored ones; documents without a tree keep theirs."""
    new = trees.filter("tree_json IS NOT NULL").select("document_hash", "tree_json")
    return replace_documents(stored.select("document_hash", "tree_json"), new, new)


def with_missing_columns(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Add the columns of a newer schema as nulls."""
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in schema.items() if c not in rows.columns])


# --- reads --------------------------------------------------------------------------------------------------
def cable_topology(topology: DataFrame, cable_id: str | None = None, document: str | None = None) -> DataFrame:
    out = topology
    if cable_id is not None:
        out = out.filter(F.col("cable_id") == cable_id)
    if document is not None:
        out = out.filter(F.col("document_hash") == document)
    return out.orderBy("cable_id", F.col("conductor_no").asc_nulls_first())


def document_path(documents: DataFrame, document: str) -> DataFrame:
    """The path of one document; no row without one."""
    return documents.filter((F.col("document_hash") == document) & (F.coalesce("path", F.lit("")) != "")).select("path")


def terminal_strips(strips: DataFrame) -> DataFrame:
    return strips.orderBy("strip_name")


def find_cabinets(cabinets: DataFrame, document: str | None = None, name: str | None = None) -> DataFrame:
    out = cabinets
    if document is not None:
        out = out.filter(F.col("document_hash") == document)
    if name:
        out = out.filter(F.col("display_name").ilike(f"%{name}%"))
    return out.orderBy("document_hash", "x", "y")


def unclassified(documents: DataFrame, texts: DataFrame, classes: list[str], limit: int = 500) -> DataFrame:
    """Documents of certain classes or none, with the number of their texts; a report of at most ``limit`` rows."""
    n = texts.groupBy("document_hash").agg(F.count("*").alias("text_count"))
    out = documents.filter(F.col("classification").isNull() | F.col("classification").isin(classes)).join(n, "document_hash", "left")
    return out.withColumn("text_count", F.coalesce("text_count", F.lit(0))).orderBy(F.col("classification").asc_nulls_first(), "path").limit(limit)


def unprocessed(documents: DataFrame, topology: DataFrame) -> DataFrame:
    return documents.join(topology.select("document_hash"), "document_hash", "left_anti")


def by_classification(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.coalesce("classification", F.lit("unclassified")).alias("classification")).agg(F.count("*").alias("n"))


def truncated(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of a sorted report; 0 is no limit."""
    return rows.limit(limit) if limit else rows


def cabinet_search(topology: DataFrame, query: str) -> DataFrame:
    hit = F.col("cabinet_name").ilike(f"%{query}%") | F.col("cabinet_name_remote").ilike(f"%{query}%")
    return topology.filter(hit).groupBy("cabinet_name", "cabinet_name_remote", "document_hash").agg(F.count("*").alias("conductors"), F.expr("listagg(DISTINCT cable_id, ',') WITHIN GROUP (ORDER BY cable_id)").alias("cables"))


def cables(topology: DataFrame) -> DataFrame:
    """Distinct documents of each cable, in the order in which (conductor_no, document) first names them; both counts are equal."""
    seen = topology.groupBy("cable_id", "document_hash").agg(F.min(F.coalesce("conductor_no", F.lit(-1))).alias("first"))
    out = seen.groupBy("cable_id").agg(F.array_sort(F.collect_list(F.struct("first", "document_hash"))).alias("d"))
    return out.select("cable_id", F.size("d").cast("long").alias("documents"), F.array_join(F.transform("d", lambda x: x.document_hash), ",").alias("hashes"))


def first_conductor(topology: DataFrame) -> DataFrame:
    """First row of each cable in (conductor_no with nulls first, strip, terminal) order, and its row count."""
    order = F.struct(F.coalesce("conductor_no", F.lit(-1)), F.coalesce("strip_name", F.lit("")), F.coalesce("terminal_no", F.lit(-1)))
    return topology.groupBy("cable_id").agg(F.min_by(F.struct("conductor_no", "strip_name", "terminal_no"), order).alias("r"), F.count("*").alias("n")).select("cable_id", "r.*", "n")


def document_rollup(documents: DataFrame, topology: DataFrame, query: str = "") -> DataFrame:
    """Per document: distinct cables, conductors, sorted source types; filtered by a substring of the path."""
    # Cables are counted as groups, not by a distinct count beside other sums, which would multiply the rows.
    cables = topology.groupBy("document_hash", "cable_id").agg(F.count("*").alias("n"), F.collect_set("source_type").alias("t"))
    per = cables.groupBy("document_hash").agg(F.count("*").alias("cables"), F.sum("n").alias("conductors"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))), ",").alias("source_types"))
    out = documents.filter(F.lower("path").contains(query.lower())).join(per, "document_hash", "left")
    return out.select("document_hash", "path", F.coalesce("cables", F.lit(0)).alias("cables"), F.coalesce("conductors", F.lit(0)).alias("conductors"), F.coalesce("source_types", F.lit("")).alias("source_types"))


def document_folders(rollup: DataFrame, root: str = "") -> DataFrame:
    """The folders of a document rollup: each folder of each path below ``root``, its parent, depth, and sums over all below it."""
    inner = F.regexp_replace(F.expr(f"replace(path, '{root.rstrip('/')}/', '')") if root else F.col("path"), "^/+", "")
    parts = F.split(inner, "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = rollup.filter(F.size(parts) > 1).select(F.explode(ups).alias("folder"), "cables", "conductors")
    out = each.groupBy("folder").agg(F.count("*").alias("documents"), F.count_if(F.col("conductors") > 0).alias("with_topology"), F.sum("conductors").alias("conductors"))
    parent = F.when(F.instr("folder", "/") > 0, F.regexp_replace("folder", "/[^/]*$", "")).otherwise(F.lit(""))
    return out.select("folder", parent.alias("parent"), F.size(F.split("folder", "/")).alias("depth"), "documents", "with_topology", "conductors")


# Classes without an analyzer.
UNMATCHED = ["protection_diagram", "panel_layout", "panel_position", "monitoring_system", "manufacturer_catalog", "unknown"]


def _listed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row: ``key=value`` of all rows, by falling value, joined."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("o"), F.coalesce(F.col(key), F.lit("")).alias("k"), F.col(value).cast("string").alias("v"))))
    return rows.agg(F.array_join(F.transform(pairs, lambda p: F.concat(p.k, F.lit("="), p.v)), ",").alias(name))


def stats(documents: DataFrame, topology: DataFrame, strips: DataFrame, cabinets: DataFrame, terminals: DataFrame) -> DataFrame:
    """One row with the seventeen totals and breakdowns.

    Topology is grouped once by (cable, source type) and once by cabinet and document, each with few columns, so that
    no distinct count multiplies its rows.
    """
    per = topology.groupBy("cable_id", "source_type").agg(F.count("*").alias("n"), F.count("conductor_no").alias("numbered"), F.max(F.col("terminal_no").isNotNull()).alias("ended"))
    cable = per.groupBy("cable_id").agg(F.sum("n").alias("n"), F.sum("numbered").alias("numbered"), F.max("ended").alias("ended"))
    t = cable.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("topology_rows"), F.count("cable_id").alias("cables"), F.coalesce(F.sum("numbered"), F.lit(0)).alias("conductors"),
        F.count_if("ended").alias("cables_with_terminals"), (F.count("cable_id") - F.count_if("ended")).alias("cables_without_terminals"),
    )
    named = topology.select(F.coalesce("cabinet_name", "cabinet_name_remote").alias("c")).filter("c IS NOT NULL").distinct().agg(F.count("*").alias("cabinet_names"))
    found = topology.select("document_hash").distinct()
    lone = F.col("classification").isNull() | F.col("classification").isin(UNMATCHED)
    d = documents.join(found.withColumn("_t", F.lit(True)), "document_hash", "left")
    d = d.agg(F.count("*").alias("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.count_if(F.col("_t").isNull()).alias("unprocessed"), F.count_if(lone).alias("unmatched"))
    regions = cabinets.groupBy("document_hash").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("regions"), F.count("document_hash").alias("documents_with_regions"))
    by = per.groupBy("source_type").agg(F.sum("n").alias("n"), F.count("cable_id").alias("cables"))
    out = t
    for one in (
        named, d, strips.agg(F.count("*").alias("strips")), regions, terminals.agg(F.count("*").alias("region_terminals")),
        _listed(documents.groupBy("document_type").agg(F.count("*").alias("n")), "document_type", "n", "by_type"), _listed(by, "source_type", "n", "rows_by_source"), _listed(by, "source_type", "cables", "cables_by_source"),
        _listed(by_classification(documents), "classification", "n", "by_classification"),
    ):
        out = out.crossJoin(one)  # one row each
    return out


def first_rows(topology: DataFrame) -> DataFrame:
    """The first row of a cable by (conductor_no, nulls first, document, strip, terminal, cabinets), and its number of rows."""
    none = F.lit("")
    row = F.struct(
        F.coalesce("conductor_no", F.lit(-1)).alias("n"), "document_hash", F.coalesce("strip_name", none).alias("strip"), F.coalesce("terminal_no", F.lit(-1)).alias("t"),
        F.coalesce("cabinet_name", none).alias("cabinet_name"), F.coalesce("cabinet_name_remote", none).alias("cabinet_name_remote"), "source_type",
    )
    first = topology.groupBy("cable_id").agg(F.min(row).alias("r"), F.count("*").alias("cores"))
    return first.select("cable_id", "cores", *[F.col(f"r.{c}").alias(c) for c in ("document_hash", "cabinet_name", "cabinet_name_remote", "source_type")])


def with_model(first: DataFrame) -> DataFrame:
    """The cables whose model counts, with their documents: those whose first row is a circuit loop's."""
    return first.filter("source_type = 'circuit_loop'").select("cable_id", "document_hash")


def cable_cabinets(first: DataFrame, models: DataFrame) -> DataFrame:
    """The export of one row a cable: model and section, cores, both cabinets.

    first: ``first_rows`` of a topology; models (``rows.cable_models``) count for cables whose first row is a circuit loop's.
    """
    one = first.withColumn("document_hash", F.when(F.col("source_type") == "circuit_loop", F.col("document_hash")))
    out = one.join(models.hint("merge"), ["cable_id", "document_hash"], "left")
    near, far, none = F.col("cabinet_name"), F.col("cabinet_name_remote"), F.lit("")
    return out.select(
        "cable_id", F.coalesce("model", none).alias("model"), F.col("cores").alias("cable_core_numbers"), F.coalesce("cross_section", none).alias("cable_core_cross_section"), none.alias("cable_core_numbers2"), none.alias("cable_core_cross_section2"),
        near.alias("origin"), near.alias("origin_cubicle"), none.alias("origin_device"), far.alias("terminal"), far.alias("terminal_cubicle"), none.alias("terminal_device"),
    )


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Numbers from 1 by a distinct key: each range of keys counts its own rows and starts behind those before it, so no task sorts them all."""
    # Written once: ranges are sampled, so a second run might cut them elsewhere.  An id is the range's number and, in 33 bits, the row's.
    ranged = held(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_id", "_before")  # one row a range


def document_detail(document: str, documents: DataFrame, topology: DataFrame, cabinets: DataFrame, terminals: DataFrame) -> DataFrame:
    """One row: a document's path and size, its cables, conductors and source types, its conductors in order, its cabinets with their terminals."""
    own = F.col("document_hash") == document
    line = F.struct(F.coalesce("cable_id", F.lit("")).alias("c"), F.coalesce("conductor_no", F.lit(0)).alias("n"), F.coalesce("strip_name", F.lit("")).alias("s"), F.coalesce(F.col("terminal_no").cast("string"), F.lit("")).alias("t"))
    t = topology.filter(own).agg(
        F.size(F.collect_set("cable_id")).cast("long").alias("cables"), F.count("*").alias("conductors"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat_ws(":", x.c, x.n.cast("string"), x.s, x.t)), ";").alias("lines"),
    )
    with_terms = cabinets_with_terminals(cabinets.filter(own), terminals.filter(own).select("cabinet_id", "terminal", "kind"))
    shown = F.concat("id", F.lit("["), F.array_join(F.transform(F.coalesce("terminals", F.array()), lambda x: x.terminal.cast("string")), " "), F.lit("]"))
    c = with_terms.agg(F.count("*").alias("regions"), F.array_join(F.array_sort(F.collect_list(shown)), ";").alias("cabinets"))
    return documents.filter(own).select("document_hash", "path", "document_type", "file_size").crossJoin(t).crossJoin(c)  # one row each


def breakdown(topology: DataFrame, by: str) -> DataFrame:
    per = topology.groupBy(by, "cable_id").agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.sum("n").alias("n"), F.count("cable_id").alias("cables"))


def cabinets_with_terminals(cabinets: DataFrame, terminals: DataFrame) -> DataFrame:
    """Each cabinet with its terminals in order; one grouped join."""
    per = terminals.groupBy("cabinet_id").agg(F.array_sort(F.collect_list(F.struct("terminal", "kind"))).alias("terminals"))
    return cabinets.join(per, cabinets.id == per.cabinet_id, "left").drop("cabinet_id")


def ranked(by: list[Column], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def stamped(rows: DataFrame, name: str = "updated_at") -> DataFrame:
    """Rows with the time of the statement, as text; the same for all of them."""
    return rows.withColumn(name, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def epoch_seconds(c: Column) -> Column:
    """A timestamp as seconds since 1970, with fractions."""
    return F.unix_micros(c) / 1e6
