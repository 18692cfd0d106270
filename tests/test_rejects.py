import csv
import json

import pytest

from docweave.operators import rejects
from docweave.operators.rejects import Layout, LayoutField

CSV = Layout("delimited", ",", tuple(LayoutField(*f) for f in [("a", "int", False), ("b", "string", False), ("c", "number", True), ("d", "bool", True), ("e", "date", True), ("f", "oid", True)]))
JSON = Layout("ndjson", "", CSV.fields)
OID = "0123456789abcdefABCDEF01"


@pytest.mark.parametrize(
    "line, reason",
    [
        (f"1,x,2.5,TRUE,2024-02-29,{OID}", None), ("1,,,,,", None), ('+1,"x, ""y""",-1e5,false,,', None), ('"1","x","2",,"2020-01-01",', None),
        ('1,x"y,,,,', "quoting"), ('1,"x,,,,', "quoting"), ('1,"x"y,,,,', "quoting"), ('1, "x",,,,', "quoting"), ('1,"x""",,,,"', "quoting"), ('1,"x"",,,,', "quoting"),
        ("1,x", "column_count"), ("1,x,,,,,", "column_count"), ("", "column_count"), ('1,"x,y",,,', "column_count"),
        (",x,,,,", "bad_value"), ("1.0,x,,,,", "bad_value"), ("9223372036854775808,x,,,,", "bad_value"), ("-9223372036854775808,x,,,,", None), ("1,x,1_0,,,", "bad_value"), ("1,x,inf,,,", "bad_value"),
        ("1,x,NaN,,,", "bad_value"), ("1,x,1e,,,", "bad_value"), ("1,x,,yes,,", "bad_value"), ("1,x,,,2023-02-29,", "bad_value"), ("1,x,,,2023-2-9,", "bad_value"), ("1,x,,,,xyz", "bad_value"),
        ("1,x, 5,,,", "bad_value"), ("١,x,,,,", "bad_value"),
    ],
)
def test_delimited(line, reason):
    assert rejects.judge_delimited([line], CSV)[0][0] == reason
    # neighbours don't matter
    assert [r for r, _ in rejects.judge_delimited(['1,"x,,,,', line, "1,é,,,,", line], CSV)] == ["quoting", reason, None, reason]


def test_quotes_against_csv_module():
    import itertools

    for cells in itertools.product(['"', "a", ",", '""', '"a"'], repeat=4):
        line = "".join(cells)
        layout = Layout("delimited", ",", tuple(LayoutField(str(n), "string", True) for n in range(line.count(",") + 1)))
        reason, values = rejects.judge_delimited([line], layout)[0]
        try:
            strict = next(csv.reader([line], strict=True, doublequote=True))
        except csv.Error:
            strict = None
        if reason is None:
            assert strict == values, line


@pytest.mark.parametrize(
    "value, reason",
    [
        ({"a": 1, "b": "x", "c": None, "d": None, "e": None, "f": None}, None), ({"f": {"$oid": OID}, "a": -5, "b": "", "c": 1.5, "d": True, "e": "2020-01-01"}, None),
        ({"a": 1, "b": "x"}, "column_count"), ({"a": 1.0, "b": "x", "c": None, "d": None, "e": None, "f": None}, "bad_value"), ({"a": True, "b": "x", "c": None, "d": None, "e": None, "f": None}, "bad_value"),
        ({"a": 1, "b": None, "c": None, "d": None, "e": None, "f": None}, "bad_value"), ({"a": 1, "b": "x", "c": "1", "d": None, "e": None, "f": None}, "bad_value"),
        ({"a": 1, "b": "x", "c": 1, "d": 1, "e": None, "f": None}, "bad_value"), ({"a": 1, "b": "x", "c": 1, "d": None, "e": "2020-13-01", "f": None}, "bad_value"),
        ({"a": 1, "b": "x", "c": 1, "d": None, "e": None, "f": {"$oid": OID, "x": 1}}, "bad_value"), ({"a": 1, "b": "x", "c": 1, "d": None, "e": None, "f": OID}, "bad_value"),
        ({"a": 1, "b": "x", "c": 1, "d": None, "e": None, "g": None}, None), ([1], "quoting"), ("x", "quoting"),
    ],
)
def test_json_values(value, reason):
    assert rejects.judge_json(json.dumps(value), JSON)[0] == reason


@pytest.mark.parametrize("line", ["", "{", "{}{}", "{'a':1}", '{"a":1,}', '{"a":NaN}', '{"a":1} x', '{"a":"\t"}', '{"a":01}', "﻿{}", '{"a":+1}', '{"a":.5}'])
def test_broken_json(line):
    assert rejects.judge_json(line, JSON)[0] == "quoting"


def test_deep_and_long_json():
    assert rejects.judge_json('{"a":' + "[" * 100000 + "]" * 100000 + "}", JSON)[0] in ("bad_value", "column_count")
    assert rejects.judge_json('{"a":' + "9" * 5000 + ',"b":"' + "x" * 100000 + '","c":1,"d":null,"e":null,"f":null}', JSON)[0] == "bad_value"
    assert rejects.judge_json('{"a":1,"a":2,"b":"x","c":1,"d":null,"e":null}', JSON)[0] == "column_count"


def test_operator(spark):
    rows = [
        (1, "f", 1, "l", "a;b", "x"), (2, "f", 2, "l", "  7;y \r", "x"), (3, "f", 3, "l", None, "x"), (4, "f", 4, "nope", "7;y", "x"), (5, "g", None, "l", "7", "x"), (6, "j", 1, "j", ' {"a":1,"b":"c"}\r', "x"),
        (7, "j", 2, "j", '\t{"a":1,"b":"c"}\t', "x"), (8, "t", 2, "t", "1\t", "x"), (9, "t", 3, "t", " 1 \r ", "x"),
    ]
    df = spark.createDataFrame(rows, "line_id long, file string, line_no int, layout string, raw_line string, reason string")
    fields = [("a", "int", False), ("b", "string", True)]
    layouts = spark.createDataFrame([(n, f, d, i, *x) for n, f, d in [("l", "delimited", ";"), ("j", "ndjson", ""), ("t", "delimited", "\t")] for i, x in enumerate(fields)], "layout string, fmt string, delim string, pos int, field_name string, field_type string, null_ok boolean")
    judged = rejects.judge_lines(df, rejects.read_layouts(layouts), ["line_id", "layout"]).cache()
    assert {r.line_id: r.reason for r in rejects.rejected_rows(judged, ["line_id"]).collect()} == {3: "quoting", 4: "unknown_layout", 5: "column_count", 9: "column_count"}
    good = rejects.valid_rows(judged.where("layout = 'l'"), rejects.read_layouts(layouts)["l"], ["line_id"])
    assert [tuple(r) for r in good.collect()] == [(2, 7, "y")]
    assert sorted(r.line_id for r in judged.where("reason IS NULL AND NOT is_header").collect()) == [2, 6, 7, 8]
    assert rejects.judge_lines(df.where("false"), rejects.read_layouts(layouts), ["line_id"]).count() == 0
