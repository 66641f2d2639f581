import pytest

from inklattice.operators import rules


def test_columns():
    assert rules.column_spec("A,c,,2") == (1, 3, 2) and rules.column_spec("AA") == (27,) and rules.column_spec([1, "B", 1]) == (1, 2)
    for bad in (0, True, [], "", [1, ""], "a1", -3):
        with pytest.raises(ValueError):
            rules.column_spec(bad)


def test_expressions(spark):
    rows = spark.createDataFrame([(1, ["steel", "x"]), (2, ["brass", None]), (3, ["steel", "on"])], "k int, cells array<string>")
    r = rules.Rules({"a": {"column": 1, "match": "contains:ee"}, "b": {"column": 2, "contains": "on"}, "c": {"column": "1,2", "regex": "^x$"}})
    got = lambda e: [x.k for x in r.apply(rows, e).filter("matched").orderBy("k").collect()]
    assert got("a & !b") == [1] and got("b") == [2, 3] and got("a | b & c") == [1, 3] and got("not (a or b)") == [] and got("True") == [1, 2, 3] and got("c") == [1]
    assert got("not a & b") == [1, 2] and got("not a and b") == [2] and got("!a & b") == [2] and got("not not a") == [1, 3] and got("c or not a | b") == [1]
    assert r.hits(rows).first().asDict() == {"a": 2, "b": 2, "c": 1}
    for bad in ("d", "a & not b", "a &", "a b", "(a", "a + b", "f(a)", ""):
        with pytest.raises(ValueError):
            r.expression(bad)
    with pytest.raises(ValueError):
        rules.Rules({"a b": {"column": 1, "equals": "x"}})
    assert rules.parse_color("#fa0") == "FFFFAA00" and rules.parse_color("11223344") == "11223344"


def test_loading(spark):
    rows = spark.createDataFrame([(1, ["steel", "x"]), (2, ["brass", None]), (3, ["steel", "on"])], "k int, cells array<string>")
    got = lambda r, e: [x.k for x in r.apply(rows, e).filter("matched").orderBy("k").collect()]
    r = rules.Rules.from_json('{"a": {"column": 1, "match": {"type": "equals", "value": "steel"}}, "n": {"column": "B", "match": "equals:None"}}')
    assert got(r, "a") == [1, 3] and got(r, "n") == [2]
    script = "def odd(cell):\n    return cell is None or len(cell) == 1\nRULES = [{'id': 'o', 'column': 2, 'match': {'type': 'py', 'function': 'odd'}}]"
    assert got(rules.Rules.from_script(script), "o") == [1, 2]
    for bad in ('{"a": {"column": 1, "match": "x"}}', '{"a": {"columns": 1, "match": "equals:x"}}', '{"a": {"match": "equals:x"}}', '[1]', '{"a": {"column": 1, "match": "equals:x"}, "a": {"column": 1, "match": "equals:y"}}', '{"a": {"column": 1, "match": {"type": "py", "function": "gone"}}}'):
        with pytest.raises(ValueError):
            rules.Rules.from_json(bad)
    with pytest.raises(ValueError):
        rules.Rules([{"id": "a", "column": 1, "match": "equals:x"}, {"id": "a", "column": 1, "match": "equals:y"}])
    with pytest.raises(ValueError):
        rules.Rules.from_script("x = 1")
