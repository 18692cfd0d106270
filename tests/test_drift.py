import json
from collections import Counter, defaultdict

from docweave.functions.canonical import canonical, parse
from docweave.operators import drift


def brute(docs, files):
    """The definition, file by file."""
    by = defaultdict(list)
    for row, file, k, v in sorted(docs, key=lambda d: d[0]):
        if v is not None:
            pairs = []
            drift.walk_paths(parse(v), pairs)
            by[file].append((k, pairs))
    out = set()
    names = {(feed, no): file for file, feed, no in files}

    def profile(rows):
        held, types = Counter(), defaultdict(Counter)
        for _, pairs in rows:
            for p in {p for p, _ in pairs}:
                held[p] += 1
            for p, x in pairs:
                t = drift.type_name(x)
                if t:
                    types[p][t] += 1
        return {p: min(types[p], key=lambda t: (-types[p][t], t)) if types[p] else None for p, n in held.items() if n * 10 >= len(rows)}

    def lists(rows, path):
        found = {}
        for k, pairs in rows:
            held = [x for p, x in pairs if p == path]
            if held and k is not None:
                found.setdefault(k, canonical(held))
        return found

    for (feed, no), file in names.items():
        before = names.get((feed, no - 1))
        if before is None or not by[file] or not by[before]:
            continue
        a, b = profile(by[before]), profile(by[file])
        kinds = {p: "removed" for p in a.keys() - b.keys()} | {p: "added" for p in b.keys() - a.keys()}
        kinds |= {p: "retyped" for p in a.keys() & b.keys() if a[p] and b[p] and a[p] != b[p]}
        kinds = {p: k for p, k in kinds.items() if not any(".".join(p.split(".")[:n]) in kinds for n in range(1, len(p.split("."))))}
        gone, new = [[p for p, k in kinds.items() if k == kind] for kind in ("removed", "added")]
        for p in gone:
            for q in new:
                if p.rpartition(".")[0] == q.rpartition(".")[0]:
                    x, y = lists(by[before], p), lists(by[file], q)
                    both = x.keys() & y.keys()
                    if len(both) >= 5 and sum(x[k] == y[k] for k in both) >= 0.9 * len(both):
                        out.add((file, "renamed", p, q))
                        kinds.pop(p, None), kinds.pop(q, None)
        for p, k in kinds.items():
            out.add((file, k, "" if k == "added" else p, "" if k == "removed" else p))
    return out


def found(spark, docs, files):
    d = spark.createDataFrame(docs, "row_id long, file string, k string, v string")
    f = spark.createDataFrame(files, "file string, feed string, file_no int")
    rows = [tuple(r) for r in drift.schema_drift(d, f).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_on_data(spark, data_dir):
    d = [tuple(r) for r in spark.read.parquet(f"{data_dir}/doc_store.parquet").select("row_id", "file", "k", "v").collect()]
    f = [tuple(r) for r in spark.read.parquet(f"{data_dir}/export_files.parquet").select("file", "feed", "file_no").collect()]
    assert found(spark, d, f) == brute(d, f)


def test_kinds(spark):
    def rows(file, start, make):
        return [(start + n, file, str(n), json.dumps(make(n))) for n in range(10)]

    docs = rows("a1", 0, lambda n: {"_id": n, "x": n, "t": 1, "o": {"p": 1}, "z": None, "l": [{"m": n}], "gone": 1})
    docs += rows("a2", 100, lambda n: {"_id": n, "X": n, "t": "1", "z": 5, "l": [{"mm": n}, 3], "d": {"$date": 5}, "q": {"r": 1}})
    docs += [(500, "a2", "0", None), (501, "b1", "1", "{}"), (502, "a1", "3", docs[3][3]), (503, None, "1", "{}")]
    files = [("a1", "a", 1), ("a2", "a", 2), ("b1", "b", 1), ("c9", "c", 9)]
    expected = {("a2", "renamed", "x", "X"), ("a2", "retyped", "t", "t"), ("a2", "removed", "o", ""), ("a2", "removed", "gone", ""), ("a2", "renamed", "l.m", "l.mm"), ("a2", "added", "", "d"), ("a2", "added", "", "q")}
    assert found(spark, docs, files) == expected == brute(docs, files)


def test_rare_paths_and_returning_columns(spark):
    docs = [(n, "f1", str(n), json.dumps({"a": 1} if n else {"a": 1, "rare": 1})) for n in range(11)]
    docs += [(50 + n, f"f{n}", "k", json.dumps({"a": 1} | ({"b": 1} if n in (3, 5, 6) else {}))) for n in range(2, 7)]
    files = [(f"f{n}", "f", n) for n in range(1, 7)]
    assert found(spark, docs, files) == {("f3", "added", "", "b"), ("f4", "removed", "b", ""), ("f5", "added", "", "b")} == brute(docs, files)
    spans = drift.lifespans(drift.file_catalogue(spark.createDataFrame(docs, "row_id long, file string, k string, v string"), spark.createDataFrame(files, "file string, feed string, file_no int")))
    assert {(r.first_no, r.last_no) for r in spans.where("path = 'b'").collect()} == {(3, 3), (5, 6)}


def test_empty(spark):
    assert found(spark, [], []) == set() and found(spark, [(1, "f", "k", "not json")], [("f", "x", 1)]) == set()


def test_unified(spark, data_dir):
    d, f = spark.read.parquet(f"{data_dir}/doc_store.parquet"), spark.read.parquet(f"{data_dir}/export_files.parquet")
    log = drift.schema_drift(d, f)
    aliases = drift.alias_table(log)
    table = drift.unified_table(d, drift.file_catalogue(d, f), aliases, ["row_id"])
    assert table.count() == d.count() and len({c.lower() for c in table.columns}) == len(table.columns)
    assert not {a for a in aliases if "." not in a} & set(table.columns)


def test_alias_chains(spark):
    log = spark.createDataFrame([("f", "renamed", "a", "b"), ("f", "renamed", "b", "c"), ("f", "renamed", "x", "y"), ("f", "renamed", "y", "x")], "file string, drift_kind string, old_path string, new_path string")
    aliases = drift.alias_table(log)
    assert aliases["a"] == aliases["b"] == "c" and aliases["x"] == "y"


def test_renames_count_within_their_feed_and_file(spark):
    shapes = {("a", 1): "tons", ("a", 2): "weight", ("a", 3): "load", ("b", 1): "tons", ("b", 2): "Tons", ("c", 1): "tons", ("c", 2): "tons", ("d", 1): "weight", ("d", 2): "tons"}
    docs = [(100 * i + n, f"{feed}{no}", str(n), json.dumps({"_id": n, name: n + 0.5})) for i, ((feed, no), name) in enumerate(shapes.items()) for n in range(20)]
    docs.append((5000, "a3", "99", '{"_id": 99, "tons": 7}'))
    files = spark.createDataFrame([(f"{feed}{no}", feed, no) for feed, no in shapes], "file string, feed string, file_no int")
    d = spark.createDataFrame(docs, "row_id long, file string, k string, v string")
    aliases = drift.file_aliases(drift.schema_drift(d, files), files)
    table = drift.unified_table(d, drift.file_catalogue(d, files), aliases, ["row_id", "file"])
    newest = {"a": "load", "b": "Tons", "c": "tons", "d": "tons"}
    held = {"load": "load", "Tons": "Tons", "tons": "tons#2"}
    assert table.columns == ["row_id", "file", "Tons", "_id", "load", "tons#2", "rest"]
    for r in table.collect():
        expected = 7.0 if r.row_id == 5000 else r["_id"] + 0.5
        assert {c: r[c] for c in held.values() if r[c] is not None} == {held[newest[r.file[0]]]: expected}


def test_names_given_up_and_taken_again():
    lives = {"x": [(3, False, "y"), (5, True, ""), (6, False, "")], "y": [(3, True, ""), (7, False, "x2")], "x2": [(7, True, "")]}
    assert [drift._newest(lives, "x", no) for no in range(1, 8)] == ["x2", "x2", "x2", "x2", "x", "x", "x"]
    assert drift._newest(lives, "y", 2) == drift._newest(lives, "y", 9) == "x2" and drift._newest(lives, "z", 1) == "z"


def test_unified_keeps_rare_fields_and_values_that_do_not_fit(spark):
    docs = [(n, "f", str(n), json.dumps({"n": n, "ok": True, "t": "a"})) for n in range(40)]
    special = ['{"n": "five", "rare": {"b": 1, "a": [2.50]}, "no": null}', '{"n": {"$numberLong": "7"}, "ok": "yes", "x.y": 1}', '{"n": 9007199254740993, "t": "1", "u": "2"}', '["no object"]', '{"broken', '{"n": 1, "n": 2}']
    docs += [(100 + i, "f", None, v) for i, v in enumerate(special)] + [(200, "f", None, None), (201, "unlisted", "k", '{"z": null, "n": 3}')]
    files = spark.createDataFrame([("f", "feed", 1)], "file string, feed string, file_no int")
    d = spark.createDataFrame(docs, "row_id long, file string, k string, v string")
    catalogue = drift.file_catalogue(d, files, present=0).cache()
    assert {tuple(r) for r in drift.schema_drift(d, files, catalogue=catalogue).collect()} == set()
    table = drift.unified_table(d, catalogue, {"u": "t"}, ["row_id"])
    assert table.dtypes == [("row_id", "bigint"), ("n", "double"), ("no", "string"), ("ok", "boolean"), ("rare", "string"), ("t", "string"), ("rest", "string")]
    rows = {r.row_id: tuple(r)[1:] for r in table.collect()}
    assert all(rows[n] == (float(n), None, True, None, "a", None) for n in range(40))
    assert rows[100] == (None, None, None, '{"b":1,"a":[2.5]}', None, '{"n":"five"}') and rows[101] == (7.0, None, None, None, None, '{"x.y":1,"ok":"yes"}')
    assert rows[102] == (None, None, None, None, "1", '{"u":"2","n":9007199254740993}') and rows[103][5] == '["no object"]' and rows[104][5] == '{"broken'
    assert rows[105] == (2.0, None, None, None, None, '{"n":1}') and rows[200] == (None,) * 6 and rows[201] == (3.0, None, None, None, None, '{"z":null}')


def test_fields_of_equal_values_renamed_together(spark):
    docs = [(100 * i + n, f"f{i}", str(n), json.dumps(v)) for i, v in ((1, {"a": 1, "b": 1, "c": None, "d": 1}), (2, {"x": 1, "y": 1, "z": None})) for n in range(6)]
    got = found(spark, docs, [("f1", "f", 1), ("f2", "f", 2)])
    assert got == {("f2", "renamed", "a", "x"), ("f2", "renamed", "b", "y"), ("f2", "renamed", "c", "z"), ("f2", "removed", "d", "")}


def test_very_deep_documents(spark):
    deep = "[" * 20_000 + "1" + "]" * 20_000
    docs = [(n, "f1", str(n), '{"a":' + deep + "}") for n in range(6)] + [(10 + n, "f2", str(n), '{"b":' + deep + "}") for n in range(6)]
    assert found(spark, docs, [("f1", "f", 1), ("f2", "f", 2)]) == {("f2", "renamed", "a", "b")}
