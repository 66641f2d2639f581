"""A boolean rule language over row cells, compiled to Column expressions.

Rules: {id: spec} or a list of specs with an ``id``.  A spec has a ``column`` and a ``match``: ``"contains:on"`` or
``{"type": "contains", "value": "on"}`` with equals, contains, startswith, endswith or regex (or the type as a key of the
spec itself), or ``{"type": "py", "function": name}`` with a Python function of a cell.
Expressions: ids with ``| & !``, ``or and not``, parentheses, True, False.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHERS: dict[str, Callable[[Column, str], Column]] = {
    "equals": lambda c, t: c == t,
    "contains": lambda c, t: c.contains(t),
    "startswith": lambda c, t: c.startswith(t),
    "endswith": lambda c, t: c.endswith(t),
    "regex": lambda c, t: c.rlike(t),
}


def column_index(token: object) -> int:
    """A 1-based index from a number or letters (A is 1)."""
    if isinstance(token, bool):
        raise ValueError("a column is not a boolean")
    if isinstance(token, int):
        index = token
    else:
        shown = str(token).strip()
        if shown.isdigit():
            index = int(shown)
        elif re.fullmatch(r"[A-Za-z]+", shown):
            index = 0
            for ch in shown.upper():
                index = index * 26 + ord(ch) - 64
        else:
            raise ValueError(f"bad column: {token!r}")
    if index < 1:
        raise ValueError(f"columns begin at 1: {token!r}")
    return index


def column_spec(spec: object) -> tuple[int, ...]:
    """Distinct indexes in order.  Empty tokens of a string are skipped, of a list are errors."""
    if isinstance(spec, (list, tuple)):
        tokens = list(spec)
    elif isinstance(spec, str):
        tokens = [t for t in spec.split(",") if t.strip()]
    else:
        tokens = [spec]
    if not tokens:
        raise ValueError("no column")
    return tuple(dict.fromkeys(column_index(t) for t in tokens))


class Rules:
    """Compiled rules over an array<string> column of cells."""

    def __init__(self, specs: dict[str, dict] | list[dict], cells: str = "cells", null_text: str = "None", functions: dict[str, Callable] | None = None):
        self.compiled: dict[str, Column] = {}
        named = list(specs.items()) if isinstance(specs, dict) else [(s.get("id") if isinstance(s, dict) else None, s) for s in specs]
        for name, spec in named:
            if not isinstance(name, str) or not name.isidentifier() or name in ("True", "False", "and", "or", "not"):
                raise ValueError(f"bad rule id: {name!r}")
            if name in self.compiled:
                raise ValueError(f"rule id twice: {name!r}")
            if not isinstance(spec, dict) or "columns" in spec or spec.get("column") is None:
                raise ValueError(f"rule {name!r} needs a column: {spec!r}")
            kind, target = self._matcher(spec)
            tests = [self._test(kind, target, F.get(F.col(cells), F.lit(k - 1)), null_text, functions or {}) for k in column_spec(spec["column"])]
            test = tests[0]
            for other in tests[1:]:
                test = test | other
            self.compiled[name] = test

    @classmethod
    def from_json(cls, text: str, **how) -> Rules:
        """Rules of a JSON object {id: spec}; a repeated id is an error."""

        def once(pairs: list[tuple[str, object]]) -> dict:
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError(f"a key stands twice: {[k for k, _ in pairs]}")
            return dict(pairs)

        specs = json.loads(text, object_pairs_hook=once)
        if not isinstance(specs, dict):
            raise ValueError("rules are an object of ids and specs")
        return cls(specs, **how)

    @classmethod
    def from_script(cls, source: str, **how) -> Rules:
        """Rules of a Python source that defines RULES (an object or a list) and the functions that its ``py`` rules name."""
        held: dict[str, object] = {}
        exec(compile(source, "<rules>", "exec"), held)  # the caller's own rules
        if not isinstance(held.get("RULES"), (dict, list)):
            raise ValueError("the script defines no RULES")
        return cls(held["RULES"], functions={k: v for k, v in held.items() if callable(v) and not k.startswith("_")}, **how)

    @staticmethod
    def _test(kind: str, target: str, cell: Column, null_text: str, functions: dict[str, Callable]) -> Column:
        if kind != "py":
            return MATCHERS[kind](F.coalesce(cell, F.lit(null_text)), target)
        if target not in functions:
            raise ValueError(f"no function {target!r}; there are {sorted(functions)}")
        own = functions[target]

        @F.pandas_udf("boolean")
        def called(values: pd.Series) -> pd.Series:
            return pd.Series([bool(own(v)) for v in values], dtype=bool)

        return called(cell)

    @staticmethod
    def _matcher(spec: dict) -> tuple[str, str]:
        match = spec.get("match")
        if isinstance(match, dict):
            kind = str(match.get("type", ""))
            target = match.get("function") if kind == "py" else match.get("value")
            target = "" if target is None else str(target)
        elif match is not None:
            kind, colon, target = str(match).partition(":")
            kind = kind if colon else ""
        else:
            kind = next((k for k in MATCHERS if k in spec), "")
            target = str(spec.get(kind, ""))
        if kind not in MATCHERS and kind != "py":
            raise ValueError(f"no matcher in {spec}")
        return kind, target

    def expression(self, source: str) -> Column:
        """Precedence: ``!``, then ``&``, ``|``, ``not``, ``and``, ``or``; so ``not a & b`` is ``not (a & b)``, and ``a & not b`` an error."""
        tokens = re.findall(r"[A-Za-z_]\w*|[()|&!]|\S", source)
        place = 0

        def peek() -> str:
            return tokens[place] if place < len(tokens) else ""

        def take() -> str:
            nonlocal place
            place += 1
            return tokens[place - 1]

        def unary() -> Column:
            t = peek()
            if t == "!":
                take()
                return ~unary()
            if t == "(":
                take()
                inner = level(0)
                if peek() != ")":
                    raise ValueError("missing )")
                take()
                return inner
            if t in ("True", "False"):
                return F.lit(take() == "True")
            if t in self.compiled:
                return self.compiled[take()]
            raise ValueError(f"unexpected {t or 'end'!r} in {source!r}")

        levels = [("or",), ("and",), ("not",), ("|",), ("&",)]

        def level(k: int) -> Column:
            if k == len(levels):
                return unary()
            if levels[k] == ("not",):
                if peek() == "not":
                    take()
                    return ~level(k)
                return level(k + 1)
            left = level(k + 1)
            while peek() in levels[k]:
                op = take()
                right = level(k + 1)
                left = left | right if op in ("or", "|") else left & right
            return left

        out = level(0)
        if place != len(tokens):
            raise ValueError(f"unexpected {peek()!r} in {source!r}")
        return out

    def apply(self, rows: DataFrame, source: str, color: str = "FFFFFF00") -> DataFrame:
        """Rows with ``matched`` and the fill color of matched ones."""
        hit = self.expression(source)
        return rows.withColumn("matched", hit).withColumn("fill_argb", F.when(F.col("matched"), F.lit(parse_color(color))))

    def hits(self, rows: DataFrame) -> DataFrame:
        """One row: how many rows each rule hits."""
        return rows.agg(*[F.count_if(c).alias(k) for k, c in self.compiled.items()])


def parse_color(value: str) -> str:
    """``#RGB``, ``RRGGBB`` or ``AARRGGBB`` as eight upper-case digits."""
    shown = value.strip().lstrip("#").upper()
    if re.fullmatch(r"[0-9A-F]{3}", shown):
        shown = "".join(c * 2 for c in shown)
    if re.fullmatch(r"[0-9A-F]{6}", shown):
        shown = "FF" + shown
    if not re.fullmatch(r"[0-9A-F]{8}", shown):
        raise ValueError(f"bad color: {value!r}")
    return shown
