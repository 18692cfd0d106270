import numpy as np
import pytest

from docweave.functions.canonical import canonical_json
from docweave.llm.bloom import BloomChain, BloomLayer
from docweave.llm.seen import SeenKeys, key_digest, seen_before


def digests(n, seed):
    return np.random.default_rng(seed).integers(0, 2**63, (2, n), dtype=np.uint64)


def test_layer_forgets_nothing_and_keeps_its_error():
    layer = BloomLayer(10_000, 0.01)
    a, b = digests(10_000, 1)
    layer.add(a, b)
    assert layer.contains(a, b).all() and layer.full and 0.4 < layer.fill < 0.6
    x, y = digests(100_000, 2)
    assert layer.contains(x, y).mean() < 0.02


@pytest.mark.parametrize("bound", [0.05, 0.001])
def test_chain_keeps_its_bound_as_it_grows(bound):
    chain = BloomChain(capacity=256, bound=bound)
    a, b = digests(60_000, 3)
    for at in range(0, 60_000, 7_000):
        chain.add(a[at : at + 7_000], b[at : at + 7_000])
    assert len(chain.layers) > 5 and chain.contains(a, b).all() and chain.compounded_error <= bound
    sizes = [x.capacity for x in chain.layers]
    assert all(q == 2 * p for p, q in zip(sizes, sizes[1:])) and all(q.error < p.error for p, q in zip(chain.layers, chain.layers[1:]))
    x, y = digests(100_000, 4)
    assert chain.contains(x, y).mean() <= bound


def test_chain_state_round_trip():
    chain = BloomChain(capacity=64, bound=0.01)
    a, b = digests(5_000, 5)
    chain.add(a, b)
    other = BloomChain(capacity=64, bound=0.01)
    for piece in chain.pieces(size=1 << 22):
        other.restore(**piece)
    assert [x.n_set for x in other.layers] == [x.n_set for x in chain.layers] and other.contains(a, b).all()
    assert all((x.bits == y.bits).all() for x, y in zip(chain.layers, other.layers))


def test_spellings():
    equal = [("7", "7.0"), ("7", '{"$numberLong":"7"}'), ("7", '{"$numberInt": "7"}'), ('"\\u00e9"', '"é"'), ('{"$oid":"' + "AB" * 12 + '"}', '{"$oid": "' + "ab" * 12 + '"}'), ('{"$date":0}', '{"$date":"1970-01-01T00:00:00Z"}'), ('{"a":1,"b":2}', '{ "a":1.0, "b": 2 }')]
    assert all(key_digest("c", a) == key_digest("c", b) for a, b in equal)
    other = [("7", '"7"'), ("1", "true"), ('"' + "ab" * 12 + '"', '{"$oid":"' + "ab" * 12 + '"}'), ('{"a":1,"b":2}', '{"b":2,"a":1}'), ("null", '""')]
    assert all(key_digest("c", a) != key_digest("c", b) for a, b in other)
    assert key_digest("c", "1") != key_digest("d", "1") != key_digest(None, "1")


def brute(writes, known):
    seen = {(c, canonical_json(k)) for c, k in known if k is not None}
    out = []
    for seq, c, k in sorted(writes):
        if k is not None:
            key = (c, canonical_json(k))
            if key in seen:
                out.append(seq)
            seen.add(key)
    return out


def test_on_data(spark, data_dir):
    w, s = spark.read.parquet(f"{data_dir}/kv_writes.parquet"), spark.read.parquet(f"{data_dir}/seen_keys.parquet")
    got = [r.seq for r in seen_before(w, s, shards=4).collect()]
    expected = brute([tuple(r) for r in w.select("seq", "coll", "k").collect()], [tuple(r) for r in s.select("coll", "k").collect()])
    assert sorted(got) == expected


def test_hot_key_nulls_and_wrong_answers(spark):
    # a loose bound makes the filter err; the exact check has to undo it
    rows = [(n, "c", str(n % 900) if n % 3 else '"hot"', "clash") for n in range(3000)] + [(5000, "c", None, "x"), (5001, "c", None, "x"), (5002, None, "1", "x"), (5003, None, "1.0", "x"), (5004, "c", "no json", "x")]
    w = spark.createDataFrame(rows, "seq long, coll string, k string, kind string").repartition(7)
    k = spark.createDataFrame([("c", "2.0"), ("c", None)], "coll string, k string")
    keys = SeenKeys(w, k, shards=2, capacity=16, bound=0.5, block_rows=32)
    assert sorted(r.seq for r in keys.found().collect()) == brute([r[:3] for r in rows], [("c", "2.0")])
    rate = keys.rate().first()
    loose = {r.seq for r in keys.found(exact=False).collect()}
    assert rate.n_wrong == len(loose - {r.seq for r in keys.found().collect()}) and rate.n_wrong > 0 and rate.wrong_rate <= rate.error_bound and rate.n_layers > 2


def test_state_carries_on(spark):
    first = spark.createDataFrame([(n, "c", str(n)) for n in range(500)], "seq long, coll string, k string")
    then = spark.createDataFrame([(1000 + n, "c", str(n)) for n in range(400, 700)], "seq long, coll string, k string")
    state = SeenKeys(first, shards=3, capacity=32).state
    later = SeenKeys(then, state=state, shards=3, capacity=32).found(exact=False)
    got = {r.seq for r in later.collect()}
    assert set(range(1400, 1500)) <= got and len(got) <= 103


@pytest.mark.parametrize("checked", [True, False])
def test_state_is_honoured_by_the_check_and_the_rate(spark, checked):
    first = SeenKeys(spark.createDataFrame([(n, "c", str(n)) for n in range(300)], "seq long, coll string, k string"), capacity=32, block_rows=50)
    again = spark.createDataFrame([(n, "c", str(n - 1000)) for n in range(1000, 1100)] + [(2000 + n, "c", f'"x{n}"') for n in range(50)] + [(3000, "c", '"x7"')], "seq long, coll string, k string")
    later = SeenKeys(again, state=first.state, history=first.history if checked else None)
    got = {r.seq for r in later.found().collect()}
    rate = later.rate().first()
    assert {*range(1000, 1100), 3000} <= got and rate.n_wrong <= rate.error_bound * rate.n_new + 1 and rate.wrong_rate <= 0.02
    if checked:
        assert got == {*range(1000, 1100), 3000} and rate.n_new == 50 and rate.n_unverified == 0
    else:
        assert rate.n_unverified >= 100
    third = SeenKeys(again, state=later.state, history=later.history if checked else None).found()
    assert third.count() == again.count()


def test_state_of_many_pieces(spark, monkeypatch):
    from docweave.llm import seen

    monkeypatch.setattr(seen, "_PIECE", 64)
    monkeypatch.setattr(seen, "_PIECES", 3)
    rows = spark.createDataFrame([(n, "c", str(n)) for n in range(2000)], "seq long, coll string, k string")
    state = SeenKeys(rows, capacity=32).state
    assert state.where("piece > 0").count() > 0 and SeenKeys(rows, state=state).found(exact=False).count() == 2000


def test_most_rows_are_answered_by_the_chain(spark):
    rows = [(n, "c", str(n * 7919 % 4000)) for n in range(8000)] + [(8000 + n, "c", '"hot"') for n in range(2000)]
    keys = SeenKeys(spark.createDataFrame(rows, "seq long, coll string, k string").repartition(2), capacity=64)
    kinds = {r.kind: r["count"] for r in keys.answers.groupBy("kind").count().collect()}
    assert kinds["filter"] >= 4000 and kinds["new"] + kinds["filter"] <= 8000 + 20 and keys.rate().first().n_layers >= 3
    assert keys.found().count() == 4000 + 1999


def test_negative_equal_and_missing_order(spark):
    rows = [(-5, "c", "1", 0), (-2, "c", "1.0", 0), (None, "c", "1", 0), (3, "c", "2", 0), (3, "c", "2", 0), (4, "c", "2", 0), (9, "c", "3", 0)]
    w = spark.createDataFrame(rows, "seq long, coll string, k string, shard int")
    k = spark.createDataFrame([("c", "3")], "coll string, k string")
    assert sorted(r.seq for r in seen_before(w, k).collect()) == [-2, 4, 9]


def test_empty(spark):
    w = spark.createDataFrame([], "seq long, coll string, k string")
    assert seen_before(w, w.select("coll", "k"), shards=2).count() == 0
    assert SeenKeys(w, shards=2).rate().first().wrong_rate == 0.0
