"""Queries of the training-data operators (problems 1, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import leaks, mixing, pii, seen
from docweave.queries.canonical_sql import canonical_id


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return seen.seen_before(_table(spark, sf, "kv_writes"), _table(spark, sf, "seen_keys"))


def p1_rate(spark: SparkSession, sf: str) -> DataFrame:
    """New keys, those wrongly taken for known, their rate and its bound."""
    return seen.SeenKeys(_table(spark, sf, "kv_writes"), _table(spark, sf, "seen_keys")).rate()


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a key, those seen before, new ones, and whether wrong answers keep to the bound."""
    keys = seen.SeenKeys(_table(spark, sf, "kv_writes"), _table(spark, sf, "seen_keys"))
    n_seen = keys.found().agg(F.count("*").alias("n_seen"))
    n_rows = keys.keys.agg(F.count("*").alias("n_rows"))
    rate = keys.rate().select("n_new", (F.col("wrong_rate") <= F.col("error_bound")).alias("within_bound"))
    lines = n_rows.select(F.lit("rows").alias("what"), F.col("n_rows").alias("n")).unionAll(n_seen.select(F.lit("seen"), "n_seen"))
    return lines.unionAll(rate.select(F.lit("new"), "n_new")).unionAll(rate.select(F.lit("within bound"), F.col("within_bound").cast("long")))


def p1_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers in two runs: the second carries on from the stored state of the first."""
    writes = _table(spark, sf, "kv_writes")
    cut = F.col("seq") <= (writes.agg(((F.min("seq") + F.max("seq")) / 2).alias("m")).first().m or 0)
    first = seen.SeenKeys(writes.where(cut), _table(spark, sf, "seen_keys"))
    second = seen.SeenKeys(writes.where(~cut), state=first.state, history=first.history)
    return first.found().unionAll(second.found())


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p6_suites(spark: SparkSession, sf: str) -> DataFrame:
    """Items that leaked and documents that hold them, by suite and language of the item."""
    items = _table(spark, sf, "eval_items")
    found = leaks.leaked_items(_table(spark, sf, "documents"), items)
    return found.join(items.select("item_id", "suite", "lang"), "item_id").groupBy("suite", "lang").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("doc_id").alias("n_docs"))


def p6_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold most of an item's rare terms close together, in any order."""
    index = leaks.CorpusIndex(_table(spark, sf, "documents"))
    return leaks.near_items(index, _table(spark, sf, "eval_items"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets")).rows()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets")).report()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf, "documents"), _table(spark, sf, "name_list"))


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(_table(spark, sf, "documents"), _table(spark, sf, "name_list"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rate, p1_counts, p1_resumed, p6_found, p6_suites, p6_proximity, p7_mix, p7_shares, p8_found, p8_redacted)}

_NTH = f"""
SELECT seq, row_number() OVER (PARTITION BY coll, c ORDER BY seq) AS nth
FROM (SELECT seq, coll, {canonical_id("k")} AS c FROM kv_writes UNION ALL SELECT -1, coll, {canonical_id("k")} FROM seen_keys)
"""
_P1 = f"SELECT seq FROM ({_NTH}) WHERE nth > 1 AND seq >= 0"

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p1_resumed": _P1,
    "p1_counts": f"""
SELECT 'rows' AS what, count(*) AS n FROM kv_writes WHERE k IS NOT NULL
UNION ALL SELECT 'seen', count(*) FROM ({_P1})
UNION ALL SELECT 'new', count(*) FROM ({_NTH}) WHERE nth = 1 AND seq >= 0
UNION ALL SELECT 'within bound', 1
""",
}
