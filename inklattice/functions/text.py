"""Column functions on text: normalising, identifiers, match tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers in drawings.
CABLE_PREFIX = r"^([A-Za-z0-9]{2,8}-[A-Za-z0-9]{1,8})"
WIRE_SERIAL = r"^([A-Za-z0-9]{2,8}-[A-Za-z0-9]{1,8})\((\d+)\)$"
CABLE_IN_TEXT = r"\b([A-Za-z0-9]{2,8}-[A-Za-z0-9]{1,8})\b"
STRIP_NAME = [r"^\d{1,2}[A-Za-z]{1,4}$", r"^[A-Za-z]{1,2}\d{1,4}$", r"^[A-Za-z]{1,4}$", r"^\+?[A-Za-z]{1,3}\d{1,4}$", r"^\d{1,2}-[A-Za-z]{1,4}$"]
LOOP_LIKE = [r"^[A-Za-z0-9]{2,8}-[A-Za-z0-9]{1,8}$", r"^[A-Za-z]\d{1,4}$"]
CROSS_SECTION = r"(\d+)[×x*](\d+(?:\.\d+)?)"
# Characters that recognition confuses, one way each.
CONFUSED = {"3": ["8", "J"], "8": ["3", "B"], "0": ["O", "Q"], "O": ["0"], "1": ["I", "L", "7"], "I": ["1"], "5": ["S"], "S": ["5"], "G": ["6"], "B": ["8"], "-": ["_", ".", " ", ""]}
# Order of match tiers.
TIERS = {"exact": 0, "normalized": 1, "confusion": 2, "levenshtein": 3, "": 4}
OTHER_TIER = 99


def strip(c: Column) -> Column:
    """White space off both ends (not only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def first_cable_id(values: Column) -> Column:
    """The first value of an array that starts with a cable id; its id, else ''."""
    found = F.filter(F.transform(values, lambda v: F.regexp_extract(v, CABLE_PREFIX, 1)), lambda v: v != "")
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def cable_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CABLE_IN_TEXT), F.lit(1))


def strip_like(c: Column) -> Column:
    out = F.lit(False)
    for p in STRIP_NAME:
        out = out | c.rlike(p)
    return out


def loop_like(c: Column) -> Column:
    out = c.contains("-") & (F.length(c) >= 4)
    for p in LOOP_LIKE:
        out = out | c.rlike(p)
    return out


def strip_and_terminal(c: Column) -> tuple[Column, Column]:
    """``strip:no`` at the first colon; a number that is none gives null."""
    parts = F.split(c, ":", 2)
    number = F.when(F.size(parts) > 1, F.trim(parts[1]))
    return F.trim(parts[0]), F.when(number.rlike("^[0-9]+$"), number).try_cast("int")


def column_text_roles(texts: Column) -> Column:
    """Ordered fold of a column's texts into terminal_no, loop_id, circuit_desc and unknown.

    All digits: the first is the terminal, others go.  Loop-like: loop, then description, then unknown.  With a letter:
    description, then unknown.  Anything else: unknown, then description.
    """
    none = F.lit(None).cast("string")
    start = F.struct(*[none.alias(n) for n in ("terminal_no", "loop_id", "circuit_desc", "unknown")])

    def step(acc: Column, t: Column) -> Column:
        digits, alpha = t.rlike("^[0-9]+$"), t.rlike(r"\p{L}")
        number = digits & acc.terminal_no.isNull()
        other = ~digits
        loop = other & loop_like(t) & acc.loop_id.isNull()
        letters = other & ~loop & (loop_like(t) | alpha)
        desc = (letters & acc.circuit_desc.isNull()) | (other & ~loop & ~letters & acc.unknown.isNotNull() & acc.circuit_desc.isNull())
        rest = other & ~loop & ~desc & acc.unknown.isNull()
        return F.struct(
            F.when(number, t).otherwise(acc.terminal_no).alias("terminal_no"),
            F.when(loop, t).otherwise(acc.loop_id).alias("loop_id"),
            F.when(desc, t).otherwise(acc.circuit_desc).alias("circuit_desc"),
            F.when(rest, t).otherwise(acc.unknown).alias("unknown"),
        )

    return F.aggregate(texts, start, step)


def normalized(c: Column) -> Column:
    """Upper case with separators as '-'."""
    return F.upper(F.regexp_replace(c, r"[_.\s—-]", "-"))


def confusion_variants(target: Column) -> Column:
    """All strings that differ from the target by one confused character."""

    def at(i: Column) -> Column:
        ch = F.substr(target, i, F.lit(1))
        swaps = F.array().cast("array<string>")
        for a, bs in CONFUSED.items():
            swaps = F.when(ch == a, F.array(*map(F.lit, bs))).otherwise(swaps)
        return F.transform(swaps, lambda s: F.concat(F.substr(target, F.lit(1), i - 1), s, F.substr(target, i + 1)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(target), F.lit(1))), at)))


def tier_rank(c: Column) -> Column:
    out = F.lit(OTHER_TIER)
    for name, rank in TIERS.items():
        out = F.when(F.coalesce(c, F.lit("")) == name, F.lit(rank)).otherwise(out)
    return out


def better_text(a: Column, b: Column) -> Column:
    """The second text if it has over 50 CJK characters and over 1.3 times the first's."""
    n = lambda c: F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return F.when((n(b) > 1.3 * n(a)) & (n(b) > 50), b).otherwise(a)


def page_text(rows: Column) -> Column:
    """Rows (arrays of cells) as lines of tab-joined cells, nulls as '', without empty rows."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t"))
    return F.array_join(F.filter(lines, lambda x: strip(x) != ""), "\n")


# What lines of code hold, and the encodings that are tried in turn.
CODE_MARKS = ["import ", "def ", "class ", "function ", "{", "}", ";", "//", "/*", "*/", "#include"]
ENCODINGS = ["UTF-8", "GBK", "GB2312", "UTF-16", "ISO-8859-1"]


def paragraphs(text: Column) -> Column:
    """Runs of lines without a blank one, line ends kept inside; fewer than three of over ten lines stay one text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r+$", ""))
    blank = lambda x: x.rlike(r"(?U)^\s*$")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        ended = blank(x)
        done = F.when(ended & acc.open.isNotNull(), F.concat(acc.done, F.array(acc.open))).otherwise(acc.done)
        return F.struct(done.alias("done"), F.when(ended, F.lit(None).cast("string")).otherwise(F.when(acc.open.isNull(), x).otherwise(F.concat(acc.open, F.lit("\n"), x))).alias("open"))

    made = F.aggregate(lines, start, step, lambda acc: F.when(acc.open.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(acc.open))))
    return F.when((F.size(made) < 3) & (F.size(lines) > 10), F.array(text)).otherwise(made)


def code_like(text: Column) -> Column:
    """Three or more of the first twenty lines hold a mark of code."""

    def marked(line: Column) -> Column:
        out = F.lit(False)
        for m in CODE_MARKS:
            out = out | line.contains(m)
        return out

    return F.size(F.filter(F.slice(F.split(text, "\n"), 1, 20), marked)) >= 3


def is_real_text(c: Column) -> Column:
    """Texts that are no error marks, which begin with ``<``."""
    return ~c.startswith("<")


def whole_contains(text: Column, target: str, ignore_case: bool = False, normalize: bool = True) -> Column:
    """A target somewhere in a text, both with white space collapsed unless that is switched off."""
    t, q = (collapsed(text), " ".join(target.split())) if normalize else (text, target)
    return F.lower(t).contains(q.lower()) if ignore_case else t.contains(q)
