"""Line dedup by a log-template tree (operator 1), in DataFrame functions only.

A line's tokens are its runs without white space; tokens that hold an ASCII digit become ``<*>``.  The tree has
a fixed depth: token count, then the ``lead`` first tokens.  A leaf holds the masked lines below it, and any number
of templates: each masked line is one, and each masked line with one more variable field is another, if several
masked lines of the leaf have that form.  Such a field takes one token, or up to ``FIELD_SHARE`` of a longer line's (places behind the
leading tokens are cut into blocks of that width); lines of fewer than ``min_tokens`` tokens get none.  A line belongs to
every template that it fits.

A template recurs when it stands in ``min_docs`` or more documents.  A line is dropped if a recurring template that
it fits stands in an earlier document (one with a smaller id): its first document keeps it, or all of them if they repeat
it.  Lines without tokens always stay.

Nulls: a null text has no lines and stays null; rows with a null id stay as they are and count nowhere.
Repeated rows with one id are one document.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inklattice.llm.common import materialize

LEAD = 4
MIN_DOCS = 2
MIN_TOKENS = 8
#: One token in so many may be a variable field (one at least).
FIELD_SHARE = 10
#: Leaves up to which their hashes are sent to all executors; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000

SPACE = r"[ \t\x0B\f\r]+"
#: A token that holds a digit; possessive, so that very long tokens take linear time.
FIELD = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def masked_lines(text: Column) -> Column:
    """The lines' tokens joined by single spaces, those with digits as ``<*>``.

    Both steps are array transforms, so each line passes once, and regular expressions meet only lines that need
    them.
    """

    def tidy(line: Column) -> Column:
        wide = line.contains("  ")
        for c in "\t\x0b\f\r":
            wide = wide | line.contains(c)
        return F.trim(F.when(wide, F.regexp_replace(line, SPACE, " ")).otherwise(line))

    return F.transform(F.transform(F.split(text, "\n"), tidy), lambda m: F.when(m.rlike("[0-9]"), F.regexp_replace(m, FIELD, "<*>")).otherwise(m))


def identity(m: Column) -> Column:
    """60 bits of a masked line's MD5."""
    return F.conv(F.substring(F.md5(m.cast("binary")), 1, 15), 16, 10).cast("long")


def lines_of(text: Column) -> Column:
    """Distinct (leaf, tmpl, n) of a text's lines that have tokens."""
    shown = F.filter(masked_lines(text), lambda m: m != "")

    def node(m: Column) -> Column:
        n = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
        return F.struct(F.xxhash64(n, F.substring_index(m, " ", LEAD)).alias("leaf"), identity(m).alias("tmpl"), n.alias("n"))

    return F.array_distinct(F.transform(shown, node))


def forms(m: Column, n: Column) -> Column:
    """Hashes of a masked line's templates with one more variable field: one for each block behind the leading tokens."""
    width = F.greatest(F.floor(n / FIELD_SHARE), F.lit(1)).cast("int")
    blocks = F.ceil((n - LEAD) / width).cast("int")

    def without(tokens: Column, k: Column) -> Column:
        at = F.lit(LEAD + 1) + k * width
        return F.xxhash64(n, k, F.slice(tokens, 1, at - 1), F.slice(tokens, at + width, n))

    # The tokens are named once, so that the line is split once.
    return F.flatten(F.transform(F.array(F.split(m, " ")), lambda tokens: F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: without(tokens, k))))


def recurring(docs: DataFrame, seen: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, tmpl, first): the masked lines that fit a recurring template, and the first document of such a one.

    docs: id, text; seen: their distinct (id, leaf, tmpl, n).
    """
    min_tokens = max(min_tokens, LEAD + 1)
    exact = materialize(seen.groupBy("leaf", "tmpl", "n").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.max("id").alias("last")), "templates")
    leaves = materialize(exact.filter(F.col("n") >= min_tokens).groupBy("leaf").agg(F.count("*").alias("k")).filter("k > 1").select("leaf"), "leaves")
    leaves = F.broadcast(leaves) if leaves.count() <= BROADCAST_ROWS else leaves
    # The masked lines of those leaves only, once each.
    text = docs.filter("id is not null and text is not null").select(F.explode(masked_lines(F.col("text"))).alias("m")).filter("m <> ''")
    n = (F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) + 1).cast("int")
    text = text.withColumn("n", n).filter(F.col("n") >= min_tokens).withColumn("leaf", F.xxhash64("n", F.substring_index("m", " ", LEAD))).join(leaves, "leaf")
    fits = text.groupBy("leaf", identity(F.col("m")).alias("tmpl")).agg(F.first(forms(F.col("m"), F.col("n"))).alias("forms"))
    fits = materialize(fits.join(exact, ["leaf", "tmpl"]).select("leaf", "tmpl", "first", F.explode("forms").alias("form")), "forms")
    if min_docs <= 2:  # a line of a template with an earlier document stands in two of them
        shared = fits.groupBy("form").agg(F.min("first").alias("met"), F.count("*").alias("k")).filter("k > 1").select("form", "met")
        own = exact.select("leaf", "tmpl", "last", F.col("first").alias("met"))
    else:
        at = seen.join(fits.select("leaf", "tmpl", "form"), ["leaf", "tmpl"]).select("form", "id").distinct()
        shared = at.groupBy("form").agg(F.min("id").alias("met"), F.count("*").alias("k")).filter(F.col("k") >= min_docs).select("form", "met")
        own = exact.select("leaf", "tmpl", "last", F.when(F.col("docs") >= min_docs, F.col("first")).alias("met"))
    wider = fits.join(shared, "form").groupBy("leaf", "tmpl").agg(F.min("met").alias("wide"))
    found = own.join(wider, ["leaf", "tmpl"], "left").withColumn("first", F.least("met", "wide"))
    return found.filter(F.col("first") < F.col("last")).select("leaf", "tmpl", "first")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with the text's kept lines, and n_lines, n_dropped."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = slim.filter("id is not null and text is not null").select("id", F.explode(lines_of(F.col("text"))).alias("l")).select("id", "l.leaf", "l.tmpl", "l.n")
    seen = materialize(seen.distinct(), "lines")
    repeated = materialize(recurring(slim, seen, min_tokens, min_docs), "recurring")
    drops = seen.join(repeated, ["leaf", "tmpl"]).filter(F.col("id") > F.col("first")).groupBy("id").agg(F.collect_set("tmpl").alias("_gone")).withColumnRenamed("id", "_gone_id")
    marked = docs.join(drops, docs[id_col] == F.col("_gone_id"), "left")
    lines = F.split(F.col(text_col), "\n")
    own = F.transform(masked_lines(F.col(text_col)), lambda m: F.when(m != "", identity(m)))
    pairs = F.zip_with(lines, own, lambda line, t: F.struct(line.alias("line"), t.alias("t")))
    keep = F.transform(F.filter(pairs, lambda p: p.t.isNull() | ~F.array_contains("_gone", p.t)), lambda p: p.line)
    kept = F.when(F.col("_gone").isNull(), F.lit(None).cast("array<string>")).otherwise(keep)
    out = marked.withColumn("_kept", kept).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    out = out.withColumn("n_dropped", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_kept")).cast("long"))
    return out.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n"))).drop("_gone", "_gone_id", "_kept")


def keep_new_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Same columns as ``docs``; texts without recurring lines, their sizes anew, and no document whose lines all went."""
    out = dedup_lines(docs, id_col, text_col)
    out = out.filter((F.col("n_dropped") == 0) | F.col(text_col).rlike(r"[^ \t\x0B\f\r\n]"))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col("n_dropped") > 0, F.length(text_col)).otherwise(F.col(size_col)).cast(docs.schema[size_col].dataType))
    return out.select(*docs.columns)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, i, line, trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS m0
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
t AS (SELECT doc_id, i, line, list_transform(string_split(m0, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM l WHERE m0 <> ''),
n AS (SELECT doc_id, i, line, toks, len(toks) AS n, array_to_string(toks, ' ') AS m, array_to_string(toks[1:4], ' ') AS lead FROM t),
e AS (SELECT n, lead, m, any_value(toks) AS toks, min(doc_id) AS first, greatest(n // 10, 1) AS width FROM n GROUP BY n, lead, m),
f AS (SELECT n, m, first, b, array_to_string(list_concat(toks[1:4 + b * width], toks[5 + (b + 1) * width:]), ' ') AS form
      FROM (SELECT *, unnest(generate_series(0, CAST(ceil((n - 4) / width) AS BIGINT) - 1)) AS b FROM e WHERE n >= 8)),
g AS (SELECT n, b, form, min(first) AS met FROM f GROUP BY n, b, form HAVING count(*) > 1),
x AS (SELECT f.n, f.m, min(met) AS wide FROM f JOIN g ON g.n = f.n AND g.b = f.b AND g.form = f.form GROUP BY f.n, f.m),
r AS (SELECT e.n, e.m, least(first, coalesce(wide, first)) AS first FROM e LEFT JOIN x ON x.n = e.n AND x.m = e.m),
d AS (SELECT n.doc_id, n.i FROM n JOIN r ON r.n = n.n AND r.m = n.m WHERE n.doc_id > r.first),
k AS (SELECT doc_id, count(*) AS n_dropped, list(i) AS gone FROM d GROUP BY doc_id),
a AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
SELECT a.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN n_dropped IS NULL THEN text ELSE array_to_string(list_transform(list_filter(generate_series(1, len(lines)), lambda x: NOT list_contains(gone, x)), lambda x: lines[x]), chr(10)) END AS text
FROM a LEFT JOIN k ON k.doc_id = a.doc_id
"""
