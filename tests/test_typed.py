import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.documents.match import compile_filter
from docweave.documents.project import Projection, compile_projection
from docweave.documents.update import Update, Updater
from docweave.errors import OperationFailure, WriteError
from docweave.functions.bsontypes import Regex
from docweave.plans import reshape, typed
from docweave.plans.regexes import to_java
from docweave.plans.spec import parse_filter

ITEM = T.StructType([T.StructField("b", T.LongType()), T.StructField("c", T.StringType()), T.StructField("n", T.ArrayType(T.LongType()))])
SCHEMA = T.StructType(
    [
        T.StructField("_id", T.LongType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("t", T.BooleanType()),
        T.StructField("o", T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])), T.StructField("l", T.ArrayType(T.LongType())), T.StructField("m", T.ArrayType(ITEM)),
        T.StructField("ll", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def random_value(rng, dtype, depth=0):
    if rng.random() < 0.2:
        return None
    if isinstance(dtype, T.LongType):
        return rng.randint(-3, 5)
    if isinstance(dtype, T.DoubleType):
        return rng.choice([-1.5, 0.0, 2.0, 2.5, float("nan"), 4.0])
    if isinstance(dtype, T.StringType):
        return rng.choice(["", "a", "ab", "B", "é"])
    if isinstance(dtype, T.BooleanType):
        return rng.random() < 0.5
    if isinstance(dtype, T.ArrayType):
        return [random_value(rng, dtype.elementType, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f.name: random_value(rng, f.dataType, depth + 1) for f in dtype.fields}


def without_nulls(value):
    """The document that a typed row stands for: null fields are missing."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [without_nulls(v) for v in value]
    return value


PATHS = ["i", "f", "s", "t", "o.x", "o.y", "l", "m.b", "m.c", "l.0", "l.1", "m.0.b", "m.n", "m.n.0", "ll", "ll.0", "nope", "o.nope", "i.x", "m.nope", "o"]


def random_literal(rng):
    return rng.choice([0, 1, 2, -1, 2.0, 2.5, "a", "ab", "B", True, False, 4.5, 10**20])


def random_test(rng):
    op = rng.choice(["eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$mod", "$size", "$regex", "null", "$all", "$not", "$elemMatch", "$type"])
    x = random_literal(rng)
    if op == "eq":
        return x
    if op == "null":
        return None
    if op in ("$in", "$nin"):
        return {op: [random_literal(rng) for _ in range(rng.randint(0, 3))] + ([None] if rng.random() < 0.3 else [])}
    if op == "$exists":
        return {op: rng.random() < 0.5}
    if op == "$mod":
        return {op: [rng.choice([2, 3, -2]), rng.choice([0, 1, -1])]}
    if op == "$size":
        return {op: rng.randint(0, 2)}
    if op == "$regex":
        return {op: rng.choice(["a", "^B", "b$"]), "$options": rng.choice(["", "i"])}
    if op == "$all":
        return {op: [random_literal(rng) for _ in range(rng.randint(1, 2))]}
    if op == "$not":
        return {"$not": {"$gt": x}}
    if op == "$type":
        return {op: rng.choice(["string", "bool", "array", "object", ["double", "string"]])}
    if op == "$elemMatch":
        return {op: rng.choice([{"$gte": 0, "$lt": 3}, {"b": {"$gt": 0}, "c": "a"}, {"b": {"$ne": 1}}, {"c": None}, {"n": 2}, {"$in": [1, 2]}, {"$or": [{"b": 1}, {"c": "a"}]}])}
    return {op: x}


def random_filter(rng, depth=0):
    if depth < 2 and rng.random() < 0.25:
        return {rng.choice(["$and", "$or", "$nor"]): [random_filter(rng, depth + 1) for _ in range(rng.randint(1, 2))]}
    return {p: random_test(rng) for p in rng.sample(PATHS, rng.randint(1, 2))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [{"_id": n} | {f.name: random_value(rng, f.dataType) for f in SCHEMA.fields[1:]} for n in range(120)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_filters_agree_with_the_document_engine(table, rows):
    rng = random.Random(7)
    filters = [random_filter(rng) for _ in range(350)]
    compiler = typed.Typed(SCHEMA)
    columns, kept = [], []
    for f in filters:
        try:
            p = compiler.filter(f)
        except OperationFailure:
            continue
        columns += [F.coalesce(p.pos, F.lit(False)).alias(f"p{len(kept)}"), F.coalesce(p.neg, F.lit(False)).alias(f"n{len(kept)}")]
        kept.append(f)
    got: dict[int, dict] = {}
    for at in range(0, len(columns), 100):
        for r in table.select("_id", *columns[at : at + 100]).collect():
            got.setdefault(r["_id"], {}).update(r.asDict())
    docs = {r["_id"]: without_nulls(r) for r in rows}
    for n, f in enumerate(kept):
        holds = compile_filter(parse_filter(f))
        for i, doc in docs.items():
            expected = holds(doc, {})
            assert got[i][f"p{n}"] == expected, (f, doc)
            assert got[i][f"n{n}"] == (not expected), ("complement", f, doc)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return (a != a and b != b) or a == b
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return a == b


def plain(row):
    return without_nulls(row.asDict(recursive=True))


UPDATES = [
    {"$inc": {"i": 2, "f": 0.5, "o.x": 1, "new": 3}}, {"$mul": {"i": 3, "f": 2}}, {"$min": {"i": 1, "s": "aa"}}, {"$max": {"f": 2.25, "o.y": "b"}}, {"$set": {"i": 9, "o.z": "q", "p.q": 1}}, {"$unset": {"s": "", "o.x": ""}},
    {"$rename": {"s": "r"}}, {"$rename": {"o.y": "moved"}}, {"$push": {"l": 7}}, {"$push": {"l": {"$each": [9, 0], "$position": 1}}}, {"$push": {"l": {"$each": [4], "$position": -1, "$slice": 3}}}, {"$push": {"l": {"$each": [2], "$sort": -1}}},
    {"$addToSet": {"l": {"$each": [1, 2]}}}, {"$pop": {"l": 1}}, {"$pop": {"l": -1}}, {"$pull": {"l": {"$gt": 1}}}, {"$pull": {"l": 2}}, {"$pull": {"m": {"c": "a"}}}, {"$pullAll": {"l": [1, 2, 5]}},
]


@pytest.mark.parametrize("update", UPDATES)
def test_updates_agree_with_the_document_engine(table, rows, update):
    filter = {"l": {"$exists": True}, "o": {"$exists": True}}
    holds = compile_filter(parse_filter(filter))
    got = {r["_id"]: plain(r) for r in reshape.update_rows(table, filter, update).collect()}
    for row in rows:
        doc = without_nulls(row)
        expected = Updater(Update(update)).apply(doc, {}) if holds(doc, {}) else doc
        assert same(without_nulls(expected), got[row["_id"]]), (update, doc)


@pytest.mark.parametrize(
    "filter, update, array_filters",
    [
        ({"l": {"$gt": 1}}, {"$inc": {"l.$": 10}}, None), ({"m.b": {"$gte": 1}}, {"$set": {"m.$.c": "hit"}}, None), ({"m": {"$elemMatch": {"b": {"$gt": 0}, "c": "a"}}}, {"$inc": {"m.$.b": 5}}, None), ({"l.0": {"$exists": True}}, {"$inc": {"l.0": 10}}, None),
    ],
)
def test_positional_updates(table, rows, filter, update, array_filters):
    got = {r["_id"]: plain(r) for r in reshape.update_rows(table, filter, update, array_filters).collect()}
    for row in rows:
        doc, hit = without_nulls(row), {}
        if compile_filter(parse_filter(filter))(doc, hit):
            try:
                doc = Updater(Update(update, array_filters)).apply(doc, hit)
            except WriteError:
                continue  # an element of another type; typed tables have none
        assert same(without_nulls(doc), got[row["_id"]])


@pytest.mark.parametrize("spec", [{"i": 1, "o.x": 1}, {"m.b": 1}, {"m.c": 0, "l": 0}, {"o.y": 0, "_id": 0}, {"l": {"$slice": 1}}, {"l": {"$slice": -2}, "i": 1}, {"l": {"$slice": [1, 1]}}, {"l": {"$slice": [-2, 1]}}, {"l": {"$elemMatch": {"$gt": 1}}}, {"m": {"$elemMatch": {"b": 1}}}])
def test_projections_agree_with_the_document_engine(table, rows, spec):
    reduce_ = compile_projection(Projection(spec))
    got = {}
    for r, i in zip(reshape.project(table.orderBy("_id"), spec).collect(), range(len(rows))):
        got[i] = plain(r)
    for row in rows:
        expected = without_nulls(reduce_(without_nulls(row), {}))
        # documents left without fields, and null elements that the rebuilding drops, have no typed counterpart
        drop = lambda v: {k: drop(x) for k, x in v.items() if drop(x) not in ({}, None)} if isinstance(v, dict) else [drop(x) for x in v if x is not None] if isinstance(v, list) else v
        assert same(drop(expected), drop(got[row["_id"]])), (spec, row)


def test_positional_projection(table, rows):
    out = typed.find(table, {"l": {"$gt": 2}}, {"l.$": 1}).collect()
    docs = {r["_id"]: without_nulls(r) for r in rows}
    assert out and all(r["l"] == [next(x for x in docs[r["_id"]]["l"] if x is not None and x > 2)] for r in out)


@pytest.mark.parametrize("pairs", [[("i", 1)], [("i", -1)], [("f", 1)], [("f", -1)], [("l", 1)], [("l", -1)], [("m.b", 1)], [("m.b", -1)], [("s", -1), ("f", 1)], [("o.x", 1), ("l", -1)]])
def test_sorting_agrees_with_the_document_engine(table, rows, pairs):
    from docweave.documents.frames import path_key

    def key(row):
        return [path_key(without_nulls(row), p, d) for p, d in pairs]

    order = sorted(rows, key=lambda r: r["_id"])
    for (p, d) in reversed(pairs):
        order.sort(key=lambda r: path_key(without_nulls(r), p, d), reverse=d == -1)
    got = [r["_id"] for r in typed.find(table, {}, ["_id"], [*pairs, ("_id", 1)]).collect()]
    by = {r["_id"]: key(r) for r in rows}
    assert [by[i] for i in got] == [key(r) for r in order]


def test_distinct_and_count(table, rows):
    values = {r["value"] for r in typed.distinct(table, "m.b", {"i": {"$gt": 0}}).collect()}
    expected = {x["b"] for r in rows if (r["i"] or 0) > 0 for x in r["m"] or [] if x and x["b"] is not None}
    assert values == expected
    assert typed.count_documents(table, {"i": {"$gt": 0}}, limit=5).first().n == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(spark, data_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    li = spark.read.parquet(f"{data_dir}/lineitem.parquet")
    text = plan(typed.find(li, {"l_quantity": {"$gt": 45}, "l_returnflag": {"$ne": "N"}, "l_orderkey": {"$not": {"$lt": 10}}}, ["l_orderkey", "l_quantity"], [("l_extendedprice", -1)], limit=10))
    assert "GreaterThan(l_quantity,45.0)" in text and "Not(EqualNullSafe(l_returnflag,N))" in text and "GreaterThanOrEqual(l_orderkey,10)" in text
    assert "TakeOrderedAndProject" in text and "Python" not in text and "l_comment" not in text and "l_tax" not in text.split("ReadSchema")[1]
    assert "In(l_linenumber, [1,2])" in plan(typed.find(li, {"l_linenumber": {"$in": [1, 2]}}, ["l_orderkey"]))
    assert "Exchange" not in plan(reshape.update_rows(li, {"l_returnflag": "N"}, {"$inc": {"l_quantity": 1}}))


def test_type_changes_are_refused(table):
    for update in ({"$set": {"i": "x"}}, {"$push": {"l": "x"}}, {"$set": {"o": 5}}):
        with pytest.raises(OperationFailure):
            reshape.update_rows(table, {}, update)
    for update, code in (({"$inc": {"s": 1}}, 14), ({"$push": {"i": 1}}, 2), ({"$set": {"l.x": 1}}, 28), ({"$set": {"i.x": 1}}, 28)):
        with pytest.raises(WriteError) as e:
            reshape.update_rows(table, {}, update)
        assert e.value.code == code


@pytest.mark.parametrize("pattern, flags", [("a.b", ""), ("^x", "m"), (r"(?P<q>a)(?P=q)", ""), (r"\bé\w", "i"), ("[[a]", ""), ("[]a]+", ""), (r"a\Z", ""), ("a#b", "x"), (r"[^&&]", ""), (r"É", "i"), (r"x$", "m"), (r"(?#note)ab", "")])
def test_regexes_find_the_same(spark, pattern, flags):
    texts = ["aab", "acb", "a\nb", "x\ny", "y\nx", "aa", "é1", "É1", "[", "]a", "&", "a", "a\n", "ab", "x\r", "xé"]
    java = to_java(Regex(pattern, flags))
    got = [r.m for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(F.col("t").rlike(java).alias("m")).collect()]
    compiled = re.compile(pattern, sum((getattr(re, f.upper()) for f in flags), re.NOFLAG))
    assert got == [compiled.search(t) is not None for t in texts]


def test_streaming(spark, data_dir, tmp_path):
    from docweave.queries.reference import QUERIES

    got = {tuple(r) for r in QUERIES["stream_find"](spark, data_dir).collect()}
    expected = {(r.event_id, r.user_id, r.value) for r in spark.read.parquet(f"{data_dir}/events.parquet").where("value > 50 AND event_type IN ('view', 'click')").collect()}
    assert got == expected and got


def test_nan_and_large_numbers(spark):
    df = spark.createDataFrame([(1, 9007199254740993, 9007199254740992.0), (2, 3, math.nan), (3, None, None)], "_id long, i long, f double")
    ids = lambda f: [r["_id"] for r in typed.find(df, f).orderBy("_id").collect()]
    assert ids({"i": 9007199254740992.0}) == [] and ids({"i": {"$gt": 9007199254740992.0}}) == [1] and ids({"f": 9007199254740993}) == [] and ids({"f": {"$lt": 9007199254740993}}) == [1]
    assert ids({"f": math.nan}) == [2] and ids({"f": {"$gt": 0}}) == [1] and ids({"f": {"$not": {"$gt": 0}}}) == [2, 3] and ids({"i": {"$lt": math.inf}}) == [1, 2] and ids({"i": "3"}) == []


def test_first_match_forms(spark):
    ships = spark.createDataFrame([(1, "tug", 5), (2, "tug", 9), (3, None, 9), (4, "brig", None)], "no long, kind string, tons long")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    whole = rows(ships)
    assert rows(reshape.replace_rows(ships, {"kind": "tug"}, {"kind": "raft"}, "no")) == [(1, "raft", None), *whole[1:]]
    assert rows(reshape.replace_rows(ships, {"kind": "tug"}, {"kind": "raft"}, "no", [("no", -1)])) == [whole[0], (2, "raft", None), *whole[2:]]
    assert rows(reshape.update_first(ships, {"tons": 9}, {"$inc": {"tons": 1}}, [("kind", 1), ("no", 1)])) == [*whole[:2], (3, None, 10), whole[3]]
    assert rows(reshape.update_first(ships, {"tons": 77}, {"$inc": {"tons": 1}}, [("no", 1)])) == whole and rows(reshape.update_first(ships, None, {"$set": {"kind": "x"}}, [("no", -1)]))[3] == (4, "x", None)
    assert rows(reshape.delete_first(ships, {"tons": None}, [("no", 1)])) == whole[:3] and rows(reshape.delete_first(ships, {"no": 9}, [("no", 1)])) == whole
    before, table = reshape.find_and_update(ships, {"kind": "tug"}, {"$set": {"kind": "ship"}}, [("tons", -1)])
    assert rows(before) == [whole[1]] and rows(table) == [whole[0], (2, "ship", 9), *whole[2:]]
    after, _ = reshape.find_and_update(ships, {"kind": "tug"}, {"$set": {"kind": "ship"}}, [("tons", -1)], return_new=True)
    assert rows(after) == [(2, "ship", 9)]
    none, same = reshape.find_and_update(ships, {"no": 9}, {"$set": {"kind": "ship"}}, [("no", 1)], return_new=True)
    assert rows(none) == [] and rows(same) == whole
    assert rows(reshape.upsert_rows(ships, {"no": 9, "kind": "yawl"}, {"$set": {"tons": 2}, "$setOnInsert": {"unknown": 1}})) == [*whole, (9, "yawl", 2)]
    assert rows(reshape.upsert_rows(ships, {"kind": "tug"}, {"$set": {"tons": 2}, "$setOnInsert": {"no": 1}}, [("no", 1)])) == [(1, "tug", 2), *whole[1:]]
    assert rows(reshape.upsert_rows(ships, {"kind": "tug"}, {"$setOnInsert": {"tons": 1}})) == whole
    empty = ships.where("false")
    assert rows(reshape.upsert_rows(empty, {}, {"$set": {"no": 5}})) == [(5, None, None)] and rows(reshape.replace_rows(empty, {"no": 1}, {}, "no")) == []
