import pytest

from docweave.compat import CompatProfile
from docweave.documents.match import compile_filter
from docweave.documents.project import Projection, compile_projection
from docweave.documents.update import Update, Updater
from docweave.errors import OperationFailure, WriteError
from docweave.plans.spec import parse_filter


def update(doc, spec, filter=None, array_filters=None, inserting=False, compat=CompatProfile()):
    hit = {}
    assert compile_filter(parse_filter(filter or {}), compat)(doc, hit)
    return Updater(Update(spec, array_filters, compat)).apply(doc, hit, inserting)


@pytest.mark.parametrize(
    "doc, spec, expected",
    [
        ({"tons": 12}, {"$inc": {"tons": -5, "trips": 1}}, {"tons": 7, "trips": 1}),
        ({"tons": 8}, {"$mul": {"tons": 0.5, "trips": 4}}, {"tons": 4.0, "trips": 0.0}),
        ({"draft": 9}, {"$min": {"draft": 6, "beam": 2}}, {"draft": 6, "beam": 2}),
        ({"draft": None}, {"$min": {"draft": 6}}, {"draft": None}),
        ({"draft": 9}, {"$max": {"draft": "none"}}, {"draft": "none"}),
        ({"name": "Petrel"}, {"$set": {"berth.pier.no": 4}}, {"name": "Petrel", "berth": {"pier": {"no": 4}}}),
        ({"tides": [3, 4]}, {"$set": {"tides.4": 8}}, {"tides": [3, 4, None, None, 8]}),
        ({"legs": []}, {"$set": {"legs.1.to": "Holm"}}, {"legs": [None, {"to": "Holm"}]}),
        ({"legs": ["x", {"to": "Holm", "miles": 2}]}, {"$unset": {"legs.0": "", "legs.1.miles": ""}}, {"legs": [None, {"to": "Holm"}]}),
        ({"name": "Petrel"}, {"$unset": {"berth.pier": ""}}, {"name": "Petrel"}),
        ({"port": "Skerry", "draft": 2}, {"$rename": {"port": "home.port"}}, {"draft": 2, "home": {"port": "Skerry"}}),
        ({"flags": ["red"]}, {"$addToSet": {"flags": "red"}}, {"flags": ["red"]}),
        ({"flags": ["red", "red"]}, {"$addToSet": {"flags": {"$each": ["red", "blue", "blue"]}}}, {"flags": ["red", "red", "blue"]}),
        ({"flags": ["red", "blue", "buff"]}, {"$pop": {"flags": 1}}, {"flags": ["red", "blue"]}),
        ({"flags": ["red", "blue", "buff"]}, {"$pop": {"flags": -1}}, {"flags": ["blue", "buff"]}),
        ({"tides": [2, 6, 11]}, {"$pull": {"tides": {"$gte": 5, "$lte": 10}}}, {"tides": [2, 11]}),
        ({"cargo": [{"item": "salt", "qty": 3}, {"item": "rope"}]}, {"$pull": {"cargo": {"item": "salt"}}}, {"cargo": [{"item": "rope"}]}),
        ({"tides": [4, 7, 4, 9]}, {"$pullAll": {"tides": [4, 9]}}, {"tides": [7]}),
        ({}, {"$push": {"flags": "red"}}, {"flags": ["red"]}),
        ({"tides": [8, 1]}, {"$push": {"tides": {"$each": [5, 3], "$sort": -1}}}, {"tides": [8, 5, 3, 1]}),
        ({"flags": ["red", "buff"]}, {"$push": {"flags": {"$each": ["blue"], "$position": 1}}}, {"flags": ["red", "blue", "buff"]}),
        ({"tides": [8, 1]}, {"$push": {"tides": {"$each": [5], "$slice": -1}}}, {"tides": [5]}),
        ({"cargo": [{"qty": 7}, "crate"]}, {"$push": {"cargo": {"$each": [{"qty": 2}], "$sort": {"qty": 1}}}}, {"cargo": ["crate", {"qty": 2}, {"qty": 7}]}),
        ({"cargo": [{"qty": 7}, {"qty": 1}]}, {"$inc": {"cargo.$[].qty": 10}}, {"cargo": [{"qty": 17}, {"qty": 11}]}),
        ({"name": "Petrel"}, {"$setOnInsert": {"draft": 1}}, {"name": "Petrel"}),
    ],
)
def test_updates(doc, spec, expected):
    assert update(doc, spec) == expected


def test_positional_and_filtered():
    ship = {"cargo": [{"qty": 6, "wet": True}, {"qty": 6, "wet": False}, {"qty": 1, "wet": True}]}
    filters = [{"damp.wet": True}, {"dry.wet": False}]
    assert update(ship, {"$inc": {"cargo.$[damp].qty": 100, "cargo.$[dry].qty": -6}}, array_filters=filters) == {"cargo": [{"qty": 106, "wet": True}, {"qty": 0, "wet": False}, {"qty": 101, "wet": True}]}
    assert update({"cargo": [{"qty": 2}, {"qty": 9}, {"qty": 12}]}, {"$set": {"cargo.$.qty": 0}}, {"cargo.qty": {"$gt": 5}}) == {"cargo": [{"qty": 2}, {"qty": 0}, {"qty": 12}]}
    with pytest.raises(WriteError):
        update(ship, {"$inc": {"cargo.$.qty": 1}}, {})
    with pytest.raises(WriteError):  # two filters meet in one element
        update(ship, {"$set": {"cargo.$[x].qty": 1, "cargo.$[y].qty": 2}}, array_filters=[{"x.qty": 6}, {"y.wet": True}])


def test_slice_and_sort_order():
    spec = {"$push": {"a": {"$each": [5], "$sort": 1, "$slice": 2}}}
    assert update({"a": [9, 7]}, spec) == {"a": [7, 9]}
    assert update({"a": [9, 7]}, spec, compat=CompatProfile(slice_before_sort=False)) == {"a": [5, 7]}


@pytest.mark.parametrize(
    "spec",
    [
        {"$foo": {"a": 1}}, {"$inc": {"a": "x"}}, {"$set": {"a": 1}, "$inc": {"a.b": 1}}, {"$set": {"": 1}}, {"$set": {"a..b": 1}}, {"$set": {"a.$x": 1}}, {"$pop": {"a": 2}},
        {"$rename": {"a": "a"}}, {"$rename": {"a": 5}}, {"$pullAll": {"a": 1}}, {"$push": {"a": {"$each": 1}}}, {"$push": {"a": {"$each": [], "$foo": 1}}}, {"$set": {"a.$.$": 1}},
        {"$set": {"a.$[x]": 1}}, {"$currentDate": {"a": 5}},
    ],
)
def test_malformed_updates(spec):
    with pytest.raises(WriteError):
        Update(spec)


def test_data_dependent_errors():
    for doc, spec, code in [({"a": "x"}, {"$inc": {"a": 1}}, 14), ({"a": 1}, {"$push": {"a": 1}}, 2), ({"a": [1]}, {"$set": {"a.b": 1}}, 28), ({"a": 1}, {"$set": {"a.b": 1}}, 28), ({"a": [1]}, {"$rename": {"a.0": "b"}}, 2)]:
        with pytest.raises(WriteError) as e:
            update(doc, spec)
        assert e.value.code == code
    with pytest.raises(ValueError):
        Update({"a": 1})
    with pytest.raises(OperationFailure):
        Update({"$set": {"a": 1}}, [{"x.b": 1}])


def project(doc, spec, filter=None):
    hit = {}
    assert compile_filter(parse_filter(filter or {}))(doc, hit)
    return compile_projection(Projection(spec, filter))(doc, hit)


DOC = {"_id": 3, "name": "Petrel", "legs": [{"to": "Holm", "miles": 8}, "lost", [{"to": "Skerry"}], {"to": "Ness", "miles": 30}], "berth": {"pier": 2, "side": "west"}}


@pytest.mark.parametrize(
    "spec, expected",
    [
        ({"name": 1}, {"_id": 3, "name": "Petrel"}),
        ({"name": 1, "_id": 0}, {"name": "Petrel"}),
        ({"legs.to": 1}, {"_id": 3, "legs": [{"to": "Holm"}, [{"to": "Skerry"}], {"to": "Ness"}]}),
        ({"berth.pier": 0, "legs": 0}, {"_id": 3, "name": "Petrel", "berth": {"side": "west"}}),
        ({"legs.to": 0, "berth": 0, "name": 0}, {"_id": 3, "legs": [{"miles": 8}, "lost", [{}], {"miles": 30}]}),
        (["name", "berth"], {"_id": 3, "name": "Petrel", "berth": {"pier": 2, "side": "west"}}),
        ({"_id": 0, "legs": 0, "berth": 0}, {"name": "Petrel"}),
        ({"_id": 1}, {"_id": 3}),
        ({"_id": 0}, {k: v for k, v in DOC.items() if k != "_id"}),
    ],
)
def test_projections(spec, expected):
    assert project(DOC, spec) == expected


def test_array_projections():
    doc = {"_id": 5, "tides": [11, 22, 33, 44, 55], "port": "Ness"}
    assert project(doc, {"tides": {"$slice": [-4, 2]}})["tides"] == [22, 33]
    assert project(doc, {"tides": {"$slice": -2}}) == {"_id": 5, "tides": [44, 55], "port": "Ness"}
    assert project(doc, {"tides": {"$slice": [-9, 3]}})["tides"] == [11, 22, 33]
    assert project(doc, {"tides": {"$slice": 1}, "port": 0}) == {"_id": 5, "tides": [11]}
    assert project(doc, {"tides": {"$elemMatch": {"$gt": 30}}}) == {"_id": 5, "tides": [33]}
    assert project(doc, {"tides": {"$elemMatch": {"$gt": 90}}}) == {"_id": 5}
    assert project(DOC, {"legs.$": 1}, {"legs.miles": 30}) == {"_id": 3, "legs": [{"to": "Ness", "miles": 30}]}
    with pytest.raises(OperationFailure):
        project(DOC, {"legs.$": 1}, {"name": "Petrel"})
    for bad in [{"a": 1, "b": 0}, {"a": {"$foo": 1}}, {"a": {"$slice": [1, 0]}}, {"c.d": {"$elemMatch": {}}}, {"a": {"$slice": 1, "$elemMatch": {}}}]:
        with pytest.raises(OperationFailure):
            Projection(bad)
    with pytest.raises(NotImplementedError):
        Projection({"a": {"$meta": "x"}})
