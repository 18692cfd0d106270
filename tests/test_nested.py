import json

import pytest

from docweave.operators import nested


def brute(row, text):
    out = set()
    try:
        root = json.loads(text, parse_constant=lambda c: int("x"))
    except (TypeError, ValueError):
        return out

    def is_object(x):
        return isinstance(x, dict) and next(iter(x), "")[:1] != "$"

    def walk(x, path, parent):
        if isinstance(x, list):
            for i, y in enumerate(x):
                here = f"{path}.{i}" if path else str(i)
                if is_object(y):
                    out.add((row, parent, here))
                    walk(y, here, here)
                elif isinstance(y, list):
                    walk(y, here, parent)
        elif is_object(x):
            for k, y in x.items():
                walk(y, f"{path}.{k}" if path else k, parent)

    walk(root, "", "")
    return out


def deep(n, inner='{"x":1}'):
    return '{"n":' + "[" * n + inner + "]" * n + "}"


CASES = [
    None, "", "not json", '{"a":[{"b":1}]} x', '{"a":[{"b":1}]}{"a":1}', '{"a":[{"b":1}]}}] x', '{"a":[{"b":NaN}]}', "5", "[]", "{}", '[{"a":1},{"b":[{}]}]', '{"a":[{"b":[{"c":1},null,"x"]},[[{"d":1}],{"e":[{}]}],{"$oid":"x"}]}', '{"a":{"b":[{"c":{"d":[{"e":1}]}}]}}',
    '{"s":"[{\\"a\\":1}]","t":[{"u":"{}"}]}', '{"a":[{"x":1,"$y":[{"z":1}]},{"$y":2,"x":[{"z":1}]}]}', '{"a":[{"it\'s":[{"q\\"uote":[{}]}]}]}', '{"A":[{"b":1}],"a":[{"B":[{}]}]}', '{"n":' + "[" * 30 + '{"x":1}' + "]" * 30 + "}",
    '{"\\u00e9":[{"k.l":[{"m":1}]}]}', '{"a":[{"b":"' + "x" * 200000 + '"}]}',
    '{"a":[{"b":1,"b":[{}]},{"c":[{}],"c":2}],"a":[{"d":[{"e":1,"e":2}]}]}', deep(9), deep(10), deep(11), deep(31), deep(12, '{"y":[{}],"z":{"$oid":1}},{}'), deep(600), '{"o":' * 40 + '[{"p":[{}]}]' + "}" * 40, deep(5, '{"q":1,"q":' + deep(20) + "}"),
]


def test_element_rows_against_brute_force(spark):
    df = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(CASES)], "row_id long, v string, path string")
    got = {tuple(r) for r in nested.element_rows(df, ["row_id"]).collect()}
    assert got == set().union(*(brute(n, t) for n, t in enumerate(CASES)))


def test_element_rows_on_data(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/doc_store.parquet")
    rows = nested.element_rows(df, ["row_id"]).collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got)
    assert got == set().union(*(brute(r.row_id, r.v) for r in df.select("row_id", "v").collect()))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3, "x", '{"a":[{"b":[{"e":1}]}],"d":5}')], "d long, e long, m long, path string, v string")
    keep = ["d", "e", "m", "path"]
    assert sorted(tuple(r) for r in nested.element_rows(df, keep).collect()) == [(1, 2, 3, "x", "", "a.0"), (1, 2, 3, "x", "a.0", "a.0.b.0")]
    tables = nested.flat_tables(df, keep)
    assert [tuple(r) for r in tables["a.[].b.[]"].collect()] == [(1, 2, 3, "x", "a.0", "a.0.b.0", [0, 0], "1")] and [tuple(r) for r in tables[""].collect()] == [(1, 2, 3, "x", "", "", [], "5")]


def test_flat_tables(spark):
    df = spark.createDataFrame([(1, '{"_id":7,"a":[{"b":"x","c":[{"d":1},{"d":{"$date":5}}]},{"B":true}]}'), (2, None)], "row_id long, v string")
    tables = nested.flat_tables(df, ["row_id"])
    assert set(tables) == {"", "a.[]", "a.[].c.[]"}
    assert [tuple(r) for r in tables[""].collect()] == [(1, "", "", [], "7")]
    assert tables["a.[]"].columns == ["row_id", "parent_path", "child_path", "positions", "f:B", "f:b#2"]
    rows = [tuple(r) for r in tables["a.[].c.[]"].orderBy("child_path").collect()]
    assert [tuple(r) for r in nested.flat_table(df, ["row_id"], "a.[]", ["B", "none"]).collect()] == [(1, "", "a.0", None, None), (1, "", "a.1", "true", None)]
    assert nested.flat_table(df, ["row_id"], "no.[]", ["x"]).count() == 0
    assert rows == [(1, "a.0", "a.0.c.0", [0, 0], "1"), (1, "a.0", "a.0.c.1", [0, 1], '{"$date":5}')]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, '{"a":1}')]])
def test_without_elements(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, v string")
    out = nested.element_rows(df, ["row_id"])
    assert out.columns == ["row_id", "parent_path", "child_path"] and out.count() == 0


def test_unreadable(spark):
    df = spark.createDataFrame([(1, "{"), (2, '{"a":1,"a":2}'), (3, "{}"), (4, None)], "row_id long, v string")
    assert sorted(r.row_id for r in nested.unreadable(df, ["row_id"]).collect()) == [1]


def test_very_deep_documents_and_repeated_names(spark):
    # deeper than the parsers of JSON reach by themselves
    texts = [deep(20_000), '{"a":[{"b":1}],"c":1,"c":[{"d":2}]}', '{"a":[{"b":3}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, v string")
    rows = [tuple(r) for r in nested.element_rows(df, ["row_id"]).collect()]
    assert sorted(rows) == [(0, "", "n" + ".0" * 20_000), (1, "", "a.0"), (1, "", "c.0"), (2, "", "a.0")]
    assert sorted(r.child_path for r in nested.flat_tables(df, ["row_id"])["c.[]"].collect()) == ["c.0"]


def test_many_kinds_and_more_shapes_than_are_projected(spark, monkeypatch):
    texts = [(n, f"k{n % 50}" if n % 7 else None, json.dumps({f"f{n % 45}": [{"x": [{"y": n}]}]})) for n in range(120)]
    df = spark.createDataFrame(texts, "row_id long, coll string, v string")
    expected = set().union(*(brute(n, t) for n, _, t in texts))
    assert {tuple(r) for r in nested.element_rows(df, ["row_id"], kind="coll").collect()} == expected
    catalogue = nested.find_shapes(df, limit=10)
    assert not catalogue.whole and {tuple(r) for r in nested.element_rows(df, ["row_id"], known=catalogue).collect()} == expected


def test_plan_reads_two_columns_and_does_not_shuffle(spark, data_dir):
    df = nested.element_rows(spark.read.parquet(f"{data_dir}/doc_store.parquet"), ["row_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<row_id:bigint,v:string>" in plan and "Python" not in plan
