import re

import pytest

from docweave.compat import CompatProfile
from docweave.documents.match import compile_filter
from docweave.errors import OperationFailure
from docweave.functions.bsontypes import Decimal128, Int64, MaxKey, MinKey, ObjectId, Regex
from docweave.plans.spec import parse_filter


def hits(docs, spec, compat=CompatProfile()):
    holds = compile_filter(parse_filter(spec, compat), compat)
    return [n for n, d in enumerate(docs) if holds(d, {})]


#: Ships whose legs and cargo are there, null, missing, or of another shape.
SHIPS = [
    {"_id": 0, "name": "Petrel", "draft": 4, "legs": [{"to": "Skerry", "miles": 40, "cargo": [{"item": "salt", "qty": 9}]}, {"to": "Holm", "miles": 75}], "crew": ["mate", "cook"], "berth": {"pier": 3, "side": "east"}},
    {"_id": 1, "name": "Dunlin", "draft": 6.5, "legs": [], "crew": ["cook"], "berth": {"side": "east", "pier": 3}},
    {"_id": 2, "name": "heron", "draft": None, "legs": [{"to": None, "miles": 12}, {"miles": 90, "cargo": []}], "crew": "mate"},
    {"_id": 3, "draft": "deep", "legs": None, "crew": [["mate", "boy"], "cook"], "berth": {}},
    {"_id": 4, "name": ["Gannet", "Solan"], "draft": [2, 11], "legs": [None, {"to": "Holm"}, 7], "berth": {"pier": [1, 3]}},
    {"_id": 5, "name": "Ternlet", "draft": Decimal128("6.5"), "legs": {"to": "Skerry", "miles": 5}, "crew": []},
    {"_id": 6, "name": True, "draft": Int64(-3), "legs": [[{"to": "Holm"}], {"0": "first"}], "crew": [None, 4]},
]


@pytest.mark.parametrize(
    "spec, expected",
    [
        # equality: of fields in any order, of documents in theirs
        ({"name": "Petrel", "draft": 4}, [0]),
        ({"draft": 4, "name": "Petrel"}, [0]),
        ({"berth": {"pier": 3, "side": "east"}}, [0]),
        ({"berth": {"side": "east", "pier": 3}}, [1]),
        ({"berth": {}}, [3]),
        ({"draft": 6.5}, [1, 5]),
        ({"name": True}, [6]),
        ({"name": 1}, []),
        # null and missing
        ({"draft": None}, [2]),
        ({"draft": {"$ne": None}}, [0, 1, 3, 4, 5, 6]),
        ({"name": None}, [3]),
        ({"crew": None}, [4, 6]),
        ({"crew": {"$ne": None}}, [0, 1, 2, 3, 5]),
        ({"legs": None}, [3, 4]),
        ({"legs.to": None}, [2, 3, 6]),
        ({"legs.to": {"$ne": None}}, [0, 1, 4, 5]),
        ({"legs.cargo.item": None}, [0, 2, 3, 4, 5, 6]),
        ({"legs.0": None}, [0, 2, 3, 4, 5]),
        ({"legs.1.to": None}, [0, 2, 3, 4, 5, 6]),
        ({"berth.pier": None}, [2, 3, 5, 6]),
        ({"berth.pier.deep": None}, [0, 1, 2, 3, 5, 6]),
        # arrays: by element, as a whole, by position
        ({"crew": "mate"}, [0, 2]),
        ({"crew": ["mate", "boy"]}, [3]),
        ({"crew": ["mate", "cook"]}, [0]),
        ({"crew.0": "mate"}, [0]),
        ({"crew.0.0": "mate"}, [3]),
        ({"crew.1": "cook"}, [0, 3]),
        ({"berth.pier": 3}, [0, 1, 4]),
        ({"berth.pier.1": 3}, [4]),
        ({"legs.to": "Holm"}, [0, 4]),
        ({"legs.0.to": "Holm"}, [6]),
        ({"legs.0": "first"}, [6]),
        ({"legs.miles": {"$gt": 80}}, [2]),
        ({"draft": {"$gt": [2, 5]}}, [4]),
        ({"draft": {"$gt": [3]}}, []),
        ({"draft": {"$lt": [3]}}, [4]),
        # orders stay within a type
        ({"draft": {"$gt": 5}}, [1, 4, 5]),
        ({"draft": {"$gte": 6.5}}, [1, 4, 5]),
        ({"draft": {"$lt": 0}}, [6]),
        ({"draft": {"$lte": 2}}, [4, 6]),
        ({"draft": {"$lt": "e"}}, [3]),
        ({"draft": {"$gt": 5, "$lt": 3}}, [4]),
        # elements
        ({"legs": {"$elemMatch": {"to": "Skerry", "miles": {"$lt": 50}}}}, [0]),
        ({"legs": {"$elemMatch": {"to": "Holm", "miles": 40}}}, []),
        ({"legs.to": "Holm", "legs.miles": 40}, [0]),
        ({"draft": {"$elemMatch": {"$gte": 10, "$lt": 12}}}, [4]),
        ({"draft": {"$elemMatch": {"$gt": 2, "$lt": 11}}}, []),
        ({"crew": {"$elemMatch": {"1": "boy"}}}, [3]),
        ({"crew": {"$all": ["cook", "mate"]}}, [0]),
        ({"crew": {"$all": ["mate"]}}, [0, 2]),
        ({"crew": {"$all": []}}, []),
        ({"legs": {"$all": [{"$elemMatch": {"miles": 40}}, {"$elemMatch": {"miles": 75}}]}}, [0]),
        ({"crew": {"$size": 2}}, [0, 3, 6]),
        ({"legs": {"$size": 0}}, [1]),
        ({"legs.cargo": {"$size": 0}}, [2]),
        # presence, type, arithmetic, patterns
        ({"name": {"$exists": False}}, [3]),
        ({"draft": {"$exists": True}}, [0, 1, 2, 3, 4, 5, 6]),
        ({"legs.2": {"$exists": True}}, [4]),
        ({"draft": {"$type": "number"}}, [0, 1, 4, 5, 6]),
        ({"draft": {"$type": ["string", "null"]}}, [2, 3]),
        ({"crew": {"$type": "array"}}, [0, 1, 3, 5, 6]),
        ({"draft": {"$mod": [4, 0]}}, [0]),
        ({"draft": {"$mod": [5, 2]}}, [4, 6]),
        ({"name": {"$regex": "^H", "$options": "i"}}, [2]),
        ({"name": re.compile("an")}, [4]),
        ({"crew": {"$in": [4, re.compile("^co")]}}, [0, 1, 3, 6]),
        ({"name": {"$in": [None, "Dunlin"]}}, [1, 3]),
        ({"name": {"$nin": ["Dunlin", True]}}, [0, 2, 3, 4, 5]),
        # logic
        ({"draft": {"$not": {"$gt": 5}}}, [0, 2, 3, 6]),
        ({"$nor": [{"crew": "cook"}, {"draft": {"$lt": 5}}]}, [2, 5]),
        ({"$or": [{"draft": 4}, {"berth.pier": 1}]}, [0, 4]),
        ({"$and": [{"crew": "cook"}, {"berth.pier": 3}]}, [0, 1]),
    ],
)
def test_filters(spec, expected):
    assert hits(SHIPS, spec) == expected


def test_numbers_that_are_none():
    tide = [{"h": float("nan")}, {"h": 2.0}, {"h": Decimal128("NaN")}, {"h": Decimal128("-Infinity")}, {"h": Decimal128("0.5")}, {"h": Int64(-7)}]
    assert hits(tide, {"h": {"$lt": Decimal128("Infinity")}}) == [1, 3, 4, 5]
    assert hits(tide, {"h": {"$lt": Decimal128("NaN")}}) == [] and hits(tide, {"h": {"$gte": float("nan")}}) == [2]
    assert hits(tide, {"h": {"$gt": -7}}) == [1, 4] and hits(tide, {"h": {"$lt": -7}}) == [3]


def test_the_ends_of_the_order():
    assert hits([{"a": MinKey()}, {"a": 1}, {"a": MaxKey()}], {"a": {"$gt": 0}}) == [1, 2]


@pytest.mark.parametrize(
    "spec",
    [
        {"$and": []}, {"$and": {}}, {"$or": [1]}, {"$where": "x"}, {"$expr": {}}, {"a": {"$foo": 1}}, {"a": {"$in": 1}}, {"a": {"$in": [{"$gt": 1}]}},
        {"a": {"$options": "i"}}, {"a": {"$regex": "(", "$options": ""}}, {"a": {"$regex": Regex("x", "i"), "$options": "m"}}, {"a": {"$size": 1.5}}, {"a": {"$size": "x"}},
        {"a": {"$mod": [2]}}, {"a": {"$mod": [2, 1, 0]}}, {"a": {"$mod": ["x", 1]}}, {"a": {"$mod": [2, "x"]}}, {"a": {"$type": "foo"}}, {"a": {"$type": 55}},
        {"a": {"$not": {}}}, {"a": {"$not": 5}}, {"a": {"$all": 5}}, {"a": {"$all": [{"$elemMatch": {"b": 1}}, 3]}}, {"a": {"$elemMatch": 5}}, {"a": {"$gt": re.compile("x")}},
        {"a": {"$ne": re.compile("x")}}, {"a": {"$jsonSchema": {}}},
    ],
)
def test_malformed_filters(spec):
    with pytest.raises(OperationFailure):
        parse_filter(spec)


def test_versions():
    old, new = CompatProfile.of("3.6"), CompatProfile.of("4.4")
    assert hits([{"a": MaxKey()}, {"a": 3}], {"a": {"$gt": 1}}, old) == [1]
    with pytest.raises(OperationFailure):
        parse_filter({"a": {"$not": {"$regex": "x"}}}, old)
    assert hits([{"a": 4}], {"a": {"$mod": [2, "x"]}}, old) == [0]
    assert hits([{"a": "B"}], {"a": {"$regex": Regex("b", "i"), "$options": "i"}}, new) == [0]


def test_object_ids():
    a = ObjectId()
    assert ObjectId(str(a)) == a and ObjectId.is_valid(str(a)) and not ObjectId.is_valid("xyz")
    assert hits([{"_id": a}, {"_id": str(a)}], {"_id": a}) == [0]
    assert ObjectId.from_datetime(a.generation_time) <= a
