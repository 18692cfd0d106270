import pytest

from docweave.llm.mixing import Mixture
from docweave.llm.tokens import VOCABULARY, count_tokens, encoding, SPLIT

DOCS = "doc_id long, source string, text string, n_tokens string"


def docs(spark, rows):
    return spark.createDataFrame([(n, s, t, "clash") for n, (s, t) in enumerate(rows)], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_token_counts(spark):
    texts = ["", None, "Hello world", "1\n00:00:01,000 --> 00:00:02,000\nÇa va ?", "x" * 50_000, "é" * 1000]
    got = [r.n_tokens for r in count_tokens(docs(spark, [("a", t) for t in texts]), ["doc_id"]).orderBy("doc_id").collect()]
    assert got[:3] == [0, None, 2] and got[3:] == [len(encoding(VOCABULARY, SPLIT).encode_ordinary(t)) for t in texts[3:]]


def test_counts_agree_with_another_library(spark, data_dir):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rows = count_tokens(spark.read.parquet(f"{data_dir}/documents.parquet").limit(40), ["text"]).collect()
    assert [r.n_tokens for r in rows] == [len(t.encode(r.text, add_special_tokens=False)) for r in rows]


def test_shares_and_repeats(spark):
    rows = [("big", "word " * (n % 50 + 1)) for n in range(3000)] + [("small", "tiny text here " * (n % 7 + 1)) for n in range(90)] + [("mid", "some words " * 20)] * 200
    mix = Mixture(docs(spark, rows), targets(spark, [("big", 0.5, 1), ("small", 0.2, 4), ("mid", 0.3, 2)]), block_rows=400)
    report = {r.source: r for r in mix.report().collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in report.values())
    assert report["big"].most_copies == 1 and report["small"].most_copies <= 4 and report["mid"].most_copies <= 2
    used = mix.rows().collect()
    assert len(used) == sum(r.n_copies for r in report.values()) and len({(r.doc_id, r.copy_no) for r in used}) == len(used)
    total = sum(r.n_tokens for r in used)
    assert abs(total - mix.total) < 0.02 * mix.total
    # one source is used to its limit: no larger mixture has these shares
    assert any(r.n_docs * 1.0 == 0 or abs(r.n_copies - {"big": 3000, "small": 360, "mid": 400}[r.source]) <= 2 for r in report.values())


def test_against_brute_force(spark):
    rows = [("a" if n % 3 else "b", "w " * (n % 11 + 1)) for n in range(500)]
    mix = Mixture(docs(spark, rows), targets(spark, [("a", 0.6, 3), ("b", 0.4, 2)]), total=1500.0, block_rows=10**6)
    plan = {r.source: r for r in mix.plan.collect()}
    sizes = sorted((r.source, r.n_tokens, r.doc_id) for r in mix.sizes.collect())
    expected, at = {}, {"a": 0, "b": 0}
    for s, _, d in sizes:
        at[s] += 1
        low, high = (int(plan[s].offset + plan[s].rate * x) for x in (at[s] - 1, at[s]))
        if high > low:
            expected[d] = high - low
    assert {r.doc_id: r.copies for r in mix.copies().collect()} == expected


def test_odd_inputs(spark):
    rows = [("a", "one two three"), ("a", None), (None, "x"), ("z", "not wanted"), ("e", ""), ("a", "one two three")]
    mix = Mixture(docs(spark, rows), targets(spark, [("a", 0.5, 2), ("missing", 0.2, 1), ("e", 0.1, 1), (None, 0.1, 1), ("zero", 0.0, 5), ("none", 0.1, 0)]))
    assert {(r.source, r.actual_share) for r in mix.report().collect()} == {("a", 1.0)}
    assert sorted((r.doc_id, r.copy_no) for r in mix.rows().collect()) == [(0, 1), (0, 2), (5, 1), (5, 2)]
    empty = Mixture(docs(spark, []), targets(spark, []))
    assert empty.rows().count() == 0 and empty.report().count() == 0
    assert Mixture(docs(spark, rows), targets(spark, [("a", 1.0, 1)]), total=10**9).copies().count() == 2
