import json
import random

import pytest
from pyspark.sql import functions as F

from docweave.documents import frames, prefilter
from docweave.documents.match import compile_filter
from docweave.plans.spec import parse_filter

TEXTS = [
    "{}", '{"a":1}', '{"a":1.0}', '{"a":"1"}', '{"a":null}', '{"a":true}', '{"a":[1,2]}', '{"a":[]}', '{"a":{"b":1}}', '{"a":[{"b":1},{"b":"x"}]}', '{"a":{"b":[1,null]}}', '{"a":{"$numberLong":"5"}}', '{"a":{"$date":0}}',
    '{"a":{"$oid":"0123456789abcdef01234567"}}', '{"a":1e300}', '{"a":9007199254740993}', '{"a":12345678901234567890123}', '{"a":0.1}', '{"a":-3}', '{"a":"it\'s \\\\ \\u00e9"}', '{"a":1,"a":"x"}', '{"b":{"c":{"d":2}}}',
    '{"b":{"c":[{"d":2},5]}}', '{"b":[{"c":{"d":"x"}}]}', '{"a":1} x', '{"a":1}{"a":2}', "[1]", '[{"a":1}]', "not json", "", '{"a":', ' \n{ "a" : 1 }', '{"$oid":"0123456789abcdef01234567"}', '{"a":1,"$b":2}', '{"a":{"b":{"$numberDouble":"NaN"}}}', "5", "null",
    '{"a":"x","b":null}', '{"a":{"b":null}}', '{"a":[[1],[2]]}', '{"a":{}}', '{"a":2.5}', '{"a":"' + "x" * 70_000 + '"}',
]
FILTERS = [
    {"a": 1}, {"a": {"$gt": 0}}, {"a": {"$gte": 1}}, {"a": {"$lt": 2.5}}, {"a": {"$lte": -3}}, {"a": "1"}, {"a": "it's \\ é"}, {"a": None}, {"a": {"$ne": None}}, {"a": {"$ne": 1}}, {"a": {"$exists": True}}, {"a": {"$exists": False}}, {"a.b": 1},
    {"a.b": None}, {"a.b": {"$exists": True}}, {"a.b": {"$not": {"$gt": 0}}}, {"b.c.d": 2}, {"b.c.d": {"$exists": False}}, {"b.c.d": None}, {"a": {"$size": 2}}, {"a": {"$size": 0}}, {"a": {"$not": {"$size": 2}}}, {"a": {"$type": "string"}},
    {"a": {"$type": "number"}}, {"a": {"$type": ["null", "bool"]}}, {"a": {"$type": "int"}}, {"a": {"$not": {"$type": "string"}}}, {"a": {"$in": [1, "x", None]}}, {"a": {"$nin": [1, "1"]}}, {"a": {"$regex": "x"}}, {"a": {"$not": {"$regex": "x"}}},
    {"$or": [{"a": 1}, {"b": {"$exists": True}}]}, {"$nor": [{"a": 1}, {"a": "x"}]}, {"a": {"$gt": 0, "$lt": 2}}, {"a": 1, "b": None}, {"a": True}, {"a.0": 1}, {"a": {"$mod": [2, 1]}}, {"a": {"$gt": float("nan")}}, {"a": 9007199254740993},
]


def expected(texts, spec):
    holds = compile_filter(parse_filter(spec))
    docs = [(n, frames.read_document(t)) for n, t in enumerate(texts)]
    return [n for n, d in docs if d is not None and holds(d, {})]


def test_the_same_as_reading_every_document(spark):
    df = frames.from_column(spark.createDataFrame(list(enumerate(TEXTS)), "n long, doc string"), "n", "doc").cache()
    for spec in FILTERS:
        assert sorted(r.seq for r in frames.matching(df, spec).collect()) == expected(TEXTS, spec), spec


def test_random_documents(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.randrange(9 if depth else 6)
        if kind < 6:
            return [1, 2.5, "x", None, False, {"$numberInt": "2"}][kind]
        return [value(depth - 1) for _ in range(rng.randint(0, 2))] if kind == 6 else {k: value(depth - 1) for k in rng.sample("abc", rng.randint(0, 3))}

    texts = [json.dumps({k: value(3) for k in rng.sample("abc", rng.randint(0, 3))}) for _ in range(400)]
    df = frames.from_column(spark.createDataFrame(list(enumerate(texts)), "n long, doc string"), "n", "doc").cache()
    for spec in [{"a": 2}, {"a.b": {"$gte": 1}}, {"a.b.c": None}, {"b": {"$not": {"$lt": 2}}}, {"a.c": {"$exists": True}}, {"c": {"$size": 1}}, {"$nor": [{"a.b": "x"}, {"c": None}]}, {"a.b": {"$type": "bool"}}]:
        assert sorted(r.seq for r in frames.matching(df, spec).collect()) == expected(texts, spec), spec


def test_what_is_settled_without_reading(spark):
    df = frames.from_column(spark.createDataFrame([(1, '{"a":5}'), (2, '{"a":"x"}'), (3, '{"b":1}'), (4, '{"a":[5]}'), (5, '{"a":{"$numberLong":"5"}}')], "n long, doc string"), "n", "doc")
    told = {r.seq: r.sure for r in prefilter.judged(df, parse_filter({"a": {"$gt": 2}})).select("seq", "sure").collect()}
    assert told == {1: True, 2: False, 3: False, 4: None, 5: None}
    assert {r.seq for r in prefilter.candidates(df, parse_filter({"a": {"$gt": 2}})).collect()} == {1, 4, 5}
    plan = prefilter.candidates(df, parse_filter({"a": {"$gt": 2}}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_parse_json") <= 1 or plan.count("parse_json") <= 2


@pytest.mark.parametrize("spec", [{"a": {"$gt": 2}}, {"a": {"$size": 1}}])
def test_updates_and_distinct_values(spark, spec):
    texts = ['{"_id":1,"a":5}', '{"_id":2,"a":1}', '{"_id":3,"a":[7]}', '{"_id":4}']
    df = spark.createDataFrame([(n, b"", t) for n, t in enumerate(texts)], frames.ROWS)
    done = {r.seq: (r.matched, r.modified) for r in frames.updated(df, spec, {"a": 0}).collect()}
    assert done == {n: (n in expected(texts, spec),) * 2 for n in range(4)}
    assert frames.distinct_values(df, "_id", spec).count() == len(expected(texts, spec))
    assert frames.matching(df, spec, [("a", 1)]).where(F.col("s0").isNotNull()).count() == len(expected(texts, spec))
