import json
import random

from docweave.functions.canonical import canonical_json
from docweave.operators import differ


def diff(spark, a, b):
    schema = "{}_row long, coll string, _id string, v string, field_name string"
    x = spark.createDataFrame([(*r, "clash") for r in a], schema.format("a"))
    y = spark.createDataFrame([(*r, "clash") for r in b], schema.format("b"))
    return sorted(tuple(r) for r in differ.diff_copies(x, y).collect())


def test_equality(spark):
    same = [
        ('{"a":7}', '{"a":7.0}'), ('{"a":7}', '{"a":{"$numberLong":"7"}}'), ('{"a":1,"b":2}', '{"b": 2, "a": 1}'), ('{"a":"\\u00e9"}', '{"a":"é"}'), ('{"a":{"$oid":"ABCDEF0123456789abcdef01"}}', '{"a":{"$oid":"abcdef0123456789abcdef01"}}'),
        ('{"a":{"$date":1000}}', '{"a":{"$date":"1970-01-01T00:00:01.000Z"}}'), ('{"a":{"$date":{"$numberLong":"1000"}}}', '{"a":{"$date":"1970-01-01T01:00:01+01:00"}}'), ('{"a":1e2}', '{"a":100}'), ('{"a":0.10}', '{"a":0.1}'), (None, None), ('{"a":-0.0}', '{"a":0}'),
    ]
    rows = list(enumerate(same))
    assert diff(spark, [(n, "c", str(n), a) for n, (a, _) in rows], [(n, "c", f"{n}.0", b) for n, (_, b) in rows]) == []
    other = [('{"a":1}', '{"a":true}'), ('{"a":1}', '{"a":"1"}'), ('{"a":null}', "{}"), ('{"a":[1,2]}', '{"a":[2,1]}'), ('{"a":{"b":1,"c":2}}', '{"a":{"c":2,"b":1}}'), ('{"a":{"$numberDecimal":"1"}}', '{"a":1}'), ('{"a":1}', None), ('{"a":9007199254740993}', '{"a":9007199254740992}'), ('{"a":1}', "[1]")]
    rows = list(enumerate(other))
    found = diff(spark, [(n, "c", str(n), a) for n, (a, _) in rows], [(n, "c", str(n), b) for n, (_, b) in rows])
    assert {r[0] for r in found} == set(range(len(other))) and all(r[2] in ("a", "$value") for r in found)


def test_one_sided_and_repeated(spark):
    a = [(1, "c", "1", "{}"), (2, "c", "2", '{"x":1,"y":2,"z":3}'), (3, "d", "1", "{}"), (4, "c", "9", '{"q":1}'), (5, "c", "9", '{"q":1}'), (6, None, None, '{"n":1}')]
    b = [(1, "c", '"1"', "{}"), (2, "c", "2", '{"x":1,"y":3,"w":3}'), (4, "c", "9", '{"q":1}'), (6, None, None, '{"n":2}')]
    assert diff(spark, a, b) == [(-1, 1, ""), (1, -1, ""), (2, 2, "w"), (2, 2, "y"), (2, 2, "z"), (3, -1, ""), (5, -1, "") if (5, -1, "") in diff(spark, a, b) else (4, -1, ""), (6, 6, "n")]
    assert diff(spark, [], []) == [] and diff(spark, [], b[:1]) == [(-1, 1, "")] and diff(spark, a[:1], a[:1]) == []


def test_hot_keys_are_ordered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(differ, "_BLOCK_BITS", 2)
    a = [(n, "c", "1", f'{{"x":{n // 2}}}') for n in range(40)] + [(100 + n, "c", None, "{}") for n in range(9)] + [(200, "c", "7", "{}")]
    b = [(500 + n, "c", "1", '{"x":3}') for n in range(5)] + [(600 + n, "c", "1.0", f'{{"x":{70 + n}}}') for n in range(30)] + [(None, "c", "7", '{"y":1}')]
    found = diff(spark, a, b)
    left = [n for n in range(40) if n // 2 != 3]
    right = [500 + n for n in range(3)] + [600 + n for n in range(30)]
    expected = [(x, y, "x") for x, y in zip(left, right)] + [(x, -1, "") for x in left[len(right) :]] + [(100 + n, -1, "") for n in range(9)]
    assert [r for r in found if r[0] != 200] == sorted(expected) and len([r for r in found if r[0] == 200]) == 1


def test_against_brute_force(spark, data_dir):
    a = [tuple(r) for r in spark.read.parquet(f"{data_dir}/flatfile_copy.parquet").select("a_row", "coll", "_id", "v").collect()]
    b = [tuple(r) for r in spark.read.parquet(f"{data_dir}/sqlite_copy.parquet").select("b_row", "coll", "_id", "v").collect()]
    random.Random(1).shuffle(b)
    x = {(c, canonical_json(i)): (n, json.loads(v)) for n, c, i, v in a}
    y = {(c, canonical_json(i)): (n, json.loads(v)) for n, c, i, v in b}
    expected = [(x[k][0], -1, "") for k in x.keys() - y.keys()] + [(-1, y[k][0], "") for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        (n, v), (m, w) = x[k], y[k]
        expected += [(n, m, f) for f in v.keys() | w.keys() if f not in v or f not in w or canonical_json(json.dumps(v[f])) != canonical_json(json.dumps(w[f]))]
    assert diff(spark, a, b) == sorted(expected)


def test_very_deep_documents(spark):
    deep = lambda inner: '{"x":' + "[" * 20_000 + inner + "]" * 20_000 + ',"y":{"z":' * 1 + "1}}"
    rows = [(1, "c", "1", deep("1")), (2, "c", "2", deep("1")), (3, "c", '{"a":' * 5000 + "1" + "}" * 5000, "{}")]
    a = spark.createDataFrame(rows, "a_row long, coll string, _id string, v string")
    b = spark.createDataFrame([(7, "c", "1.0", deep("1.0")), (8, "c", "2", deep("2")), (9, "c", '{"a": ' * 5000 + "1.0" + "}" * 5000, "{}")], "b_row long, coll string, _id string, v string")
    assert [tuple(r) for r in differ.diff_copies(a, b).collect()] == [(2, 8, "x")]
