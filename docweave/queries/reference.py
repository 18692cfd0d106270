"""Queries of the document language on typed tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.documents import frames
from docweave.plans import reshape, typed
from docweave.streaming import drained, find_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _find(name: str, source: str | Callable, filter: dict, keep: str, where: str, relation: str | None = None) -> None:
    """A filter; its SQL is a condition on the same columns."""
    read = source if callable(source) else lambda s, d: _table(s, d, source)
    fields = [c.strip() for c in keep.split(",")]
    _add(name, lambda s, d: typed.find(read(s, d), filter, fields), f"SELECT {keep} FROM {relation or source} AS t WHERE {where}")


# --- tables with nulls and with nested items -----------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose larger values and clicks' properties are missing."""
    value = F.when(F.col("value") <= 60, F.col("value"))
    kind = F.when(F.col("event_type") != "click", F.col("event_type"))
    return _table(spark, sf, "events").select("event_id", "user_id", value.alias("value"), kind.alias("event_type"))


_EVENTS = "(SELECT event_id, user_id, CASE WHEN value <= 60 THEN value END AS value, CASE WHEN event_type <> 'click' THEN event_type END AS event_type FROM events)"


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines as an array of documents."""
    item = F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"))
    return _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))


_NESTED = (
    "(SELECT l_orderkey AS _id, list(struct_pack(n := CAST(l_linenumber AS BIGINT), q := CAST(l_quantity AS BIGINT), f := l_returnflag) "
    "ORDER BY l_linenumber, l_quantity, l_returnflag) AS items FROM lineitem GROUP BY l_orderkey)"
)


def _scalars(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf).select("_id", F.col("items.q").alias("qs"))


_SCALARS = f"(SELECT _id, list_transform(items, lambda x: x.q) AS qs FROM {_NESTED})"


def _numbers_text(col: str = "qs"):
    return F.concat_ws(",", F.transform(col, lambda x: F.coalesce(x.cast("string"), F.lit("null")))).alias(col)


def _numbers_sql(expr: str, name: str = "qs") -> str:
    return f"array_to_string(list_transform({expr}, lambda y: coalesce(CAST(y AS VARCHAR), 'null')), ',') AS {name}"


def _items_text(fields: tuple[str, ...] = ("n", "q", "f")):
    return F.concat_ws(";", F.transform("items", lambda x: F.concat_ws(":", *[x.getField(f).cast("string") for f in fields]))).alias("items")


def _items_sql(expr: str, fields: tuple[str, ...] = ("n", "q", "f")) -> str:
    return f"array_to_string(list_transform({expr}, lambda z: concat_ws(':', {', '.join('z.' + f for f in fields)})), ';') AS items"


# --- comparison and logic --------------------------------------------------------

_find("find_eq", "lineitem", {"l_returnflag": "R"}, "l_orderkey, l_linenumber, l_quantity, l_extendedprice", "l_returnflag = 'R'")
_find("find_ne", "orders", {"o_orderstatus": {"$ne": "O"}}, "o_orderkey, o_orderstatus", "o_orderstatus <> 'O'")
_find("find_gt", "lineitem", {"l_quantity": {"$gt": 45}}, "l_orderkey, l_linenumber, l_quantity, l_extendedprice", "l_quantity > 45")
_find("find_gte", "orders", {"o_totalprice": {"$gte": 200000}}, "o_orderkey, o_totalprice", "o_totalprice >= 200000")
_find("find_lt", "lineitem", {"l_discount": {"$lt": 0.02}}, "l_orderkey, l_linenumber, l_discount, l_extendedprice", "l_discount < 0.02")
_find("find_lte", "part", {"p_size": {"$lte": 7.5}}, "p_partkey, p_size", "p_size <= 7.5")
_find("find_range", "orders", {"o_orderdate": {"$gte": datetime(1995, 1, 1), "$lt": datetime(1996, 1, 1)}}, "o_orderkey, o_custkey", "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_find("find_type_mismatch", "orders", {"$or": [{"o_orderkey": "5"}, {"o_orderstatus": {"$gt": 3}}, {"o_orderkey": {"$lt": 10}}]}, "o_orderkey, o_orderstatus", "o_orderkey < 10")
_find("find_ne_missing", _events, {"value": {"$ne": 9.64}}, "event_id, value", "value IS DISTINCT FROM 9.64", _EVENTS)
_find("find_null", _events, {"value": None}, "event_id, event_type", "value IS NULL", _EVENTS)
_find("find_not_null", _events, {"value": {"$ne": None}}, "event_id, value", "value IS NOT NULL", _EVENTS)
_find("find_nin_missing", _events, {"event_type": {"$nin": ["view", "error"]}}, "event_id, event_type", "event_type IS NULL OR event_type NOT IN ('view', 'error')", _EVENTS)
_find("find_nor_missing", _events, {"$nor": [{"value": {"$gt": 50}}, {"value": {"$lt": 20}}]}, "event_id, value", "NOT coalesce(value > 50 OR value < 20, false)", _EVENTS)
_find("find_not_missing", _events, {"value": {"$not": {"$gte": 20, "$lte": 50}}}, "event_id, value", "NOT coalesce(value BETWEEN 20 AND 50, false)", _EVENTS)
_find("find_exists_true", _events, {"value": {"$exists": True}}, "event_id, value", "value IS NOT NULL", _EVENTS)
_find("find_exists_false", _events, {"event_type": {"$exists": False}}, "event_id, user_id", "event_type IS NULL", _EVENTS)
_find("find_and", "orders", {"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 100000}}]}, "o_orderkey, o_totalprice", "o_orderstatus = 'F' AND o_totalprice > 100000")
_find("find_or", "orders", {"$or": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"$lt": 1000}}]}, "o_orderkey, o_orderpriority", "o_orderpriority = '1-URGENT' OR o_totalprice < 1000")
_find("find_nor", "orders", {"$nor": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gte": 50000}}]}, "o_orderkey, o_totalprice", "o_orderstatus <> 'O' AND o_totalprice < 50000")
_find("find_not_nested", "orders", {"o_totalprice": {"$not": {"$not": {"$gt": 250000}}}}, "o_orderkey, o_totalprice", "o_totalprice > 250000")
_find("find_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", 7]}}, "o_orderkey, o_orderpriority", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_find("find_in_null", _events, {"event_type": {"$in": ["view", None]}}, "event_id, event_type", "event_type = 'view' OR event_type IS NULL", _EVENTS)
_find("find_in_regex", "part", {"p_brand": {"$in": [re.compile("^Brand#1"), "Brand#55"]}}, "p_partkey, p_brand", "regexp_matches(p_brand, '^Brand#1') OR p_brand = 'Brand#55'")
_find("find_nin", "orders", {"o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderkey, o_orderstatus", "o_orderstatus NOT IN ('F', 'P')")
_find("find_type", "part", {"$or": [{"p_size": {"$type": "string"}}, {"p_partkey": {"$type": "long"}, "p_size": {"$lt": 10}}]}, "p_partkey, p_size", "p_size < 10")
_find("find_regex", "documents", {"text": {"$regex": "(?P<x>never) .*ask"}}, "doc_id, n_chars", "regexp_matches(text, 'never .*ask')")
_find("find_regex_i", "customer", {"c_mktsegment": {"$regex": "^build", "$options": "i"}}, "c_custkey, c_mktsegment", "regexp_matches(c_mktsegment, '^build', 'i')")
_find("find_regex_m", "documents", {"text": {"$regex": "^never", "$options": "m"}}, "doc_id, n_chars", "regexp_matches(text, '(?m)^never')")
_find("find_regex_s", "documents", {"text": {"$regex": "never.{0,4}whistle", "$options": "s"}}, "doc_id, n_chars", "regexp_matches(text, 'never.{0,4}whistle', 's')")
_find("find_regex_x", "part", {"p_brand": {"$regex": "Brand \\# [12] 3 $ # the third", "$options": "x"}}, "p_partkey, p_brand", "regexp_matches(p_brand, 'Brand#[12]3$')")
_find("find_not_regex", "customer", {"c_mktsegment": {"$not": re.compile("E$")}}, "c_custkey, c_mktsegment", "NOT regexp_matches(c_mktsegment, 'E$')")
_find("find_mod", "orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey, o_custkey", "o_orderkey % 7 = 3")
_add(
    "find_mod_negative",
    lambda s, d: typed.find(_table(s, d, "customer").select("c_custkey", (F.col("c_custkey") - 700).alias("shifted")), {"shifted": {"$mod": [7, 3]}}),
    "SELECT c_custkey, c_custkey - 700 AS shifted FROM customer WHERE (c_custkey - 700) - 7 * CAST(floor((c_custkey - 700) / 7.0) AS BIGINT) = 3",
)

# --- arrays ----------------------------------------------------------------------


def _find_nested(name: str, filter: dict, where: str) -> None:
    _add(name, lambda s, d: typed.find(_nested(s, d), filter).select("_id", _items_text()), f"SELECT _id, {_items_sql('items')} FROM {_NESTED} WHERE {where}")


def _find_scalars(name: str, filter: dict, where: str) -> None:
    _add(name, lambda s, d: typed.find(_scalars(s, d), filter).select("_id", _numbers_text()), f"SELECT _id, {_numbers_sql('qs')} FROM {_SCALARS} WHERE {where}")


_find_nested("find_dotted_any", {"items.q": {"$gt": 49}, "items.f": "R"}, "len(list_filter(items, lambda x: x.q > 49)) > 0 AND len(list_filter(items, lambda x: x.f = 'R')) > 0")
_find_nested("find_dotted_ne", {"items.f": {"$ne": "N"}}, "len(list_filter(items, lambda x: x.f = 'N')) = 0")
_find_nested("find_elem_match", {"items": {"$elemMatch": {"q": {"$gt": 49}, "f": "R"}}}, "len(list_filter(items, lambda x: x.q > 49 AND x.f = 'R')) > 0")
_find_nested("find_not_elem_match", {"items": {"$not": {"$elemMatch": {"q": {"$gt": 30}, "f": {"$in": ["R", "A"]}}}}}, "len(list_filter(items, lambda x: x.q > 30 AND x.f IN ('R', 'A'))) = 0")
_find_nested("find_all_elem_match", {"items": {"$all": [{"$elemMatch": {"f": "R", "q": {"$gt": 40}}}, {"$elemMatch": {"f": "A"}}]}}, "len(list_filter(items, lambda x: x.f = 'R' AND x.q > 40)) > 0 AND len(list_filter(items, lambda x: x.f = 'A')) > 0")
_find_nested("find_size", {"items": {"$size": 3}}, "len(items) = 3")
_find_nested("find_positional_index", {"items.0.f": "A", "items.1.q": {"$lt": 10}}, "items[1].f = 'A' AND items[2].q < 10")
# a document in the array lacks the name "5", so the path is missing there; all of an array of structs have "n"
_find_nested("find_array_null", {"$or": [{"items.n": None}, {"$and": [{"items.5.q": None}, {"items": {"$size": 6}}]}]}, "len(items) = 6")
_find_nested("find_array_exists", {"items.2": {"$exists": True}}, "len(items) > 2")
_find_scalars("find_scalar_any", {"qs": 50}, "list_contains(qs, 50)")
_find_scalars("find_scalar_ne", {"qs": {"$ne": 25}}, "NOT list_contains(qs, 25)")
_find_scalars("find_elem_match_scalar", {"qs": {"$elemMatch": {"$gte": 10, "$lt": 12}}}, "len(list_filter(qs, lambda x: x >= 10 AND x < 12)) > 0")
_find_scalars("find_range_over_elements", {"qs": {"$gt": 45, "$lt": 5}}, "len(list_filter(qs, lambda x: x > 45)) > 0 AND len(list_filter(qs, lambda x: x < 5)) > 0")
_find_scalars("find_all", {"qs": {"$all": [10, 20]}}, "list_contains(qs, 10) AND list_contains(qs, 20)")
_find_scalars("find_array_equal", {"$or": [{"qs": [q]} for q in range(1, 51)]}, "len(qs) = 1")
_find_scalars("find_array_type", {"qs": {"$type": "array"}, "_id": {"$lt": 50}}, "_id < 50")
_find("find_embedding_size", "embeddings", {"embedding": {"$size": 64}, "label": {"$gt": 3}}, "vec_id, label", "len(embedding) = 64 AND label > 3")

# --- projections -----------------------------------------------------------------


def _on_nested(name: str, run: Callable[[DataFrame], DataFrame], expr: str, where: str = "true", fields: tuple[str, ...] = ("n", "q", "f")) -> None:
    _add(name, lambda s, d: run(_nested(s, d)).select("_id", _items_text(fields)), f"SELECT _id, {_items_sql(expr, fields)} FROM {_NESTED} WHERE {where}")


def _on_scalars(name: str, run: Callable[[DataFrame], DataFrame], expr: str, where: str = "true") -> None:
    _add(name, lambda s, d: run(_scalars(s, d)).select("_id", _numbers_text()), f"SELECT _id, {_numbers_sql(expr)} FROM {_SCALARS} WHERE {where}")


_add("project_include", lambda s, d: typed.find(_table(s, d, "customer"), {}, {"c_name": 1, "c_custkey": 1}), "SELECT c_custkey, c_name FROM customer")
_add("project_exclude", lambda s, d: typed.find(_table(s, d, "supplier"), {}, {"s_name": 0, "s_acctbal": 0}), "SELECT s_suppkey, s_nationkey FROM supplier")
_on_nested("project_nested", lambda t: reshape.project(t, {"items.q": 1}), "items", fields=("q",))
_on_nested("project_nested_exclude", lambda t: reshape.project(t, {"items.q": 0}), "items", fields=("n", "f"))
_on_scalars("project_slice", lambda t: reshape.project(t, {"qs": {"$slice": 2}}), "qs[1:2]")
_on_scalars("project_slice_neg", lambda t: reshape.project(t, {"qs": {"$slice": -2}}), "qs[-2:]")
_on_scalars("project_slice_skip", lambda t: reshape.project(t, {"qs": {"$slice": [1, 2]}}), "qs[2:3]")
_on_scalars("project_elem_match", lambda t: reshape.project(t, {"qs": {"$elemMatch": {"$gt": 40}}}), "list_filter(qs, lambda x: x > 40)[1:1]")
_on_scalars("project_positional", lambda t: typed.find(t, {"qs": {"$gt": 40}}, {"qs.$": 1}), "list_filter(qs, lambda x: x > 40)[1:1]", "len(list_filter(qs, lambda x: x > 40)) > 0")
_on_nested("project_positional_nested", lambda t: typed.find(t, {"items.f": "R"}, {"items.$": 1}), "list_filter(items, lambda x: x.f = 'R')[1:1]", "len(list_filter(items, lambda x: x.f = 'R')) > 0")

# --- sorting, paging, counting, distinct ----------------------------------------------

_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_TIES = [(c.strip(), 1) for c in _LINE.split(",")]
_add(
    "topk",
    lambda s, d: typed.find(_table(s, d, "lineitem"), {"l_quantity": {"$gt": 45}, "l_returnflag": {"$ne": "N"}}, [c for c, _ in _TIES], [("l_extendedprice", -1), *_TIES], limit=20),
    f"SELECT {_LINE} FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N' ORDER BY l_extendedprice DESC, {_LINE} LIMIT 20",
)
_add("sort_multi", lambda s, d: typed.find(_table(s, d, "customer"), {}, ["c_custkey", "c_mktsegment", "c_acctbal"], [("c_mktsegment", 1), ("c_acctbal", -1), ("c_custkey", 1)]), "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY 2, 3 DESC, 1")
_add("sort_desc_nulls", lambda s, d: typed.find(_events(s, d), {}, ["event_id", "value"], [("value", -1), ("event_id", 1)], skip=10, limit=500), f"SELECT event_id, value FROM {_EVENTS} ORDER BY value DESC NULLS LAST, event_id LIMIT 500 OFFSET 10")
_add("sort_asc_nulls", lambda s, d: typed.find(_events(s, d), {}, ["event_id", "value"], [("value", 1), ("event_id", 1)], limit=700), f"SELECT event_id, value FROM {_EVENTS} ORDER BY value NULLS FIRST, event_id LIMIT 700")
_add(
    "sort_array_min_max",
    lambda s, d: typed.find(_scalars(s, d), {}, None, [("qs", 1), ("_id", 1)], limit=200).select("_id", F.lit("asc").alias("way")).unionAll(typed.find(_scalars(s, d), {}, None, [("qs", -1), ("_id", 1)], limit=200).select("_id", F.lit("desc"))),
    f"(SELECT _id, 'asc' AS way FROM {_SCALARS} ORDER BY list_min(qs), _id LIMIT 200) UNION ALL (SELECT _id, 'desc' AS way FROM {_SCALARS} ORDER BY list_max(qs) DESC, _id LIMIT 200)",
)
_add("skip_limit", lambda s, d: typed.find(_table(s, d, "orders"), {}, ["o_orderkey", "o_totalprice"], [("o_totalprice", 1), ("o_orderkey", 1)], skip=100, limit=-50), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2, 1 LIMIT 50 OFFSET 100")
_add("count_filtered", lambda s, d: typed.count_documents(_table(s, d, "lineitem"), {"l_quantity": {"$gt": 20}}), "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 20")
_add("distinct_scalar", lambda s, d: typed.distinct(_table(s, d, "orders"), "o_orderpriority"), "SELECT DISTINCT o_orderpriority AS value FROM orders")
_add("distinct_filtered", lambda s, d: typed.distinct(_table(s, d, "lineitem"), "l_suppkey", {"l_quantity": 50}), "SELECT DISTINCT l_suppkey AS value FROM lineitem WHERE l_quantity = 50")
_add("distinct_array", lambda s, d: typed.distinct(_nested(s, d), "items.q"), f"SELECT DISTINCT unnest(qs) AS value FROM {_SCALARS}")
_add("distinct_null", lambda s, d: typed.distinct(_events(s, d), "event_type"), f"SELECT DISTINCT event_type AS value FROM {_EVENTS} WHERE event_type IS NOT NULL")

# --- updates (the table after an update, read only) ------------------------------------


def _update(name: str, filter: dict, update: dict, keep: str, sql: str, source: str = "orders", array_filters: list | None = None) -> None:
    fields = [c.strip() for c in keep.split(",")]
    _add(name, lambda s, d: reshape.update_rows(_table(s, d, source), filter, update, array_filters).select(*fields), f"SELECT {sql} FROM {source}")


_update("update_inc", {"o_orderstatus": "F"}, {"$inc": {"o_custkey": 10}}, "o_orderkey, o_custkey", "o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 10 ELSE o_custkey END AS o_custkey")
_update("update_mul", {"o_totalprice": {"$lt": 5000}}, {"$mul": {"o_totalprice": 2}}, "o_orderkey, o_totalprice", "o_orderkey, CASE WHEN o_totalprice < 5000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice")
_update("update_min", {}, {"$min": {"o_custkey": 100}}, "o_orderkey, o_custkey", "o_orderkey, least(o_custkey, 100) AS o_custkey")
_update("update_max", {}, {"$max": {"o_custkey": 100}}, "o_orderkey, o_custkey", "o_orderkey, greatest(o_custkey, 100) AS o_custkey")
_update("update_set", {"o_orderstatus": {"$ne": "O"}}, {"$set": {"o_orderpriority": "none", "o_note": "done"}}, "o_orderkey, o_orderpriority, o_note", "o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'none' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN 'done' END AS o_note")
_update("update_unset", {"o_orderstatus": "P"}, {"$unset": {"o_orderpriority": ""}}, "o_orderkey, o_orderpriority", "o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority")
_update("update_rename", {"o_orderkey": {"$lt": 500}}, {"$rename": {"o_orderpriority": "o_urgency"}}, "o_orderkey, o_orderpriority, o_urgency", "o_orderkey, CASE WHEN o_orderkey >= 500 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey < 500 THEN o_orderpriority END AS o_urgency")
_add("update_current_date", lambda s, d: reshape.update_rows(_table(s, d, "nation"), {}, {"$currentDate": {"seen": True}}, now=datetime(2024, 5, 1, tzinfo=timezone.utc)).select("n_nationkey", F.col("seen").cast("date").cast("string").alias("seen")), "SELECT n_nationkey, '2024-05-01' AS seen FROM nation")


def _array_update(name: str, update: dict, expr: str, filter: dict | None = None, array_filters: list | None = None) -> None:
    _on_scalars(name, lambda t: reshape.update_rows(t, filter or {}, update, array_filters), expr)


_array_update("update_push", {"$push": {"qs": 7}}, "list_append(qs, 7)")
_array_update("update_push_each", {"$push": {"qs": {"$each": [7, 8]}}}, "list_concat(qs, [7, 8])")
_array_update("update_push_position", {"$push": {"qs": {"$each": [7, 8], "$position": 1}}}, "list_concat(qs[1:1], list_concat([7, 8], qs[2:]))")
_array_update("update_push_slice", {"$push": {"qs": {"$each": [7], "$slice": -3}}}, "list_append(qs, 7)[-3:]")
_array_update("update_push_sort", {"$push": {"qs": {"$each": [7, 30], "$sort": -1}}}, "list_reverse_sort(list_concat(qs, [7, 30]))")
_array_update("update_add_to_set", {"$addToSet": {"qs": {"$each": [7, 30]}}}, "list_concat(qs, list_filter([7, 30], lambda x: NOT list_contains(qs, x)))")
_array_update("update_pop", {"$pop": {"qs": 1}}, "qs[1:len(qs) - 1]")
_array_update("update_pop_first", {"$pop": {"qs": -1}}, "qs[2:]")
_array_update("update_pull", {"$pull": {"qs": {"$gt": 10, "$lt": 40}}}, "list_filter(qs, lambda x: NOT (x > 10 AND x < 40))")
_array_update("update_pull_all", {"$pullAll": {"qs": [1, 2, 3, 4]}}, "list_filter(qs, lambda x: x NOT IN (1, 2, 3, 4))")
_array_update("update_all_elems", {"$inc": {"qs.$[]": 100}}, "list_transform(qs, lambda x: x + 100)")
_array_update("update_filtered_elems", {"$inc": {"qs.$[big]": 1}}, "list_transform(qs, lambda x: CASE WHEN x > 40 THEN x + 1 ELSE x END)", array_filters=[{"big": {"$gt": 40}}])
_array_update("update_positional", {"$inc": {"qs.$": 100}}, "list_transform(qs, lambda x, i: CASE WHEN i = list_position(list_transform(qs, lambda y: y > 40), true) THEN x + 100 ELSE x END)", {"qs": {"$gt": 40}})
_array_update("update_numeric_index", {"$set": {"qs.2": 0}}, "list_concat(list_concat(qs[1:2], CASE WHEN len(qs) < 2 THEN [NULL] ELSE [] END), list_concat([0], qs[4:]))")
_on_nested("update_pull_docs", lambda t: reshape.update_rows(t, {}, {"$pull": {"items": {"f": "N", "q": {"$gte": 20}}}}), "list_filter(items, lambda x: NOT (x.f = 'N' AND x.q >= 20))")
_on_nested("update_filtered_docs", lambda t: reshape.update_rows(t, {}, {"$set": {"items.$[x].f": "X"}}, [{"x.q": {"$lt": 10}}]), "list_transform(items, lambda x: struct_pack(n := x.n, q := x.q, f := CASE WHEN x.q < 10 THEN 'X' ELSE x.f END))")
_on_nested("update_sort_docs", lambda t: reshape.update_rows(t, {}, {"$push": {"items": {"$each": [], "$sort": {"n": -1, "q": 1, "f": 1}}}}), "list_transform(list_sort(list_transform(items, lambda x: struct_pack(a := -x.n, q := x.q, f := x.f))), lambda x: struct_pack(n := -x.a, q := x.q, f := x.f))")

# --- deletes, replacements, inserts -----------------------------------------------------

_CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_add("delete_many", lambda s, d: reshape.delete_rows(_table(s, d, "customer"), {"c_acctbal": {"$lt": 0}}), f"SELECT {_CUSTOMER} FROM customer WHERE NOT c_acctbal < 0")
_add("delete_missing", lambda s, d: reshape.delete_rows(_events(s, d), {"value": {"$gt": 30}}).select("event_id", "value"), f"SELECT event_id, value FROM {_EVENTS} WHERE value IS NULL OR value <= 30")
_add("replace_one", lambda s, d: reshape.replace_rows(_table(s, d, "customer"), {"c_custkey": 7}, {"c_name": "new"}, "c_custkey").select("c_custkey", "c_name", "c_mktsegment"), "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey <> 7 THEN c_mktsegment END AS c_mktsegment FROM customer")
_add(
    "insert_many_dups",
    lambda s, d: reshape.insert_rows(_table(s, d, "supplier").select("s_suppkey", "s_name"), _table(s, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")), "s_suppkey"),
    "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, min(c_name) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_custkey",
)

# --- documents of any shape ---------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return frames.from_column(_table(spark, sf, "doc_store"), "row_id", "v")


def _find_documents(name: str, filter: dict, where: str) -> None:
    _add(name, lambda s, d: frames.matching(_documents(s, d), filter).select(F.col("seq").alias("row_id")), f"SELECT row_id FROM doc_store WHERE v IS NOT NULL AND ({where})")


_NUMERIC = "json_type(v, '$.tonnage') IN ('DOUBLE', 'BIGINT', 'UBIGINT')"
_find_documents("docs_gt", {"tonnage": {"$gt": 500}}, f"{_NUMERIC} AND CAST(json_extract_string(v, '$.tonnage') AS DOUBLE) > 500")
_find_documents("docs_not_gt", {"tonnage": {"$not": {"$gt": 500}}}, f"NOT coalesce({_NUMERIC} AND CAST(json_extract_string(v, '$.tonnage') AS DOUBLE) > 500, false)")
_find_documents("docs_exists", {"legs": {"$exists": True}}, "json_exists(v, '$.legs')")
_find_documents("docs_null", {"remark": None}, "coalesce(json_type(v, '$.remark'), 'NULL') = 'NULL'")
_find_documents("docs_nested", {"home.port": {"$regex": "^amber"}}, "json_type(v, '$.home.port') = 'VARCHAR' AND starts_with(json_extract_string(v, '$.home.port'), 'amber')")
_find_documents("docs_size", {"legs": {"$size": 2}}, "json_type(v, '$.legs') = 'ARRAY' AND json_array_length(v, '$.legs') = 2")
_add(
    "docs_sort",
    lambda s, d: frames.ordered(frames.matching(_documents(s, d), {"ship_name": {"$type": "string"}}, [("ship_name", -1)]), [("ship_name", -1)]).limit(100).select(F.col("seq").alias("row_id")),
    "SELECT row_id FROM doc_store WHERE json_type(v, '$.ship_name') = 'VARCHAR' ORDER BY json_extract_string(v, '$.ship_name') DESC, row_id LIMIT 100",
)
_add(
    "docs_distinct",
    lambda s, d: frames.distinct_values(_documents(s, d), "home.port", {"home.port": {"$type": "string"}}).select(F.get_json_object("value", "$.v").alias("value")),
    "SELECT DISTINCT json_extract_string(v, '$.home.port') AS value FROM doc_store WHERE json_type(v, '$.home.port') = 'VARCHAR'",
)
_add(
    "docs_project",
    lambda s, d: frames.projected(frames.matching(_documents(s, d), {"_id": {"$type": "int"}}), {"_id": 1}, {}).select(F.col("seq").alias("row_id"), F.get_json_object("doc", "$._id").alias("id")),
    "SELECT row_id, json_extract_string(v, '$._id') AS id FROM doc_store WHERE json_type(v, '$._id') IN ('BIGINT', 'UBIGINT')",
)
_add("find_json_path", lambda s, d: typed.find(_table(s, d, "events").select("event_id", F.from_json("props", "k long").alias("props")), {"props.k": {"$gt": 50}}).select("event_id", F.col("props.k").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")

#: The order of types, and a text or number to compare within each, of the ids that the documents have.
_ID_RANK = """
SELECT row_id, CASE json_type(v, '$._id') WHEN 'UBIGINT' THEN 2 WHEN 'BIGINT' THEN 2 WHEN 'DOUBLE' THEN 2 WHEN 'VARCHAR' THEN 3 WHEN 'OBJECT' THEN
    CASE json_keys(v, '$._id')[1] WHEN '$numberLong' THEN 2 WHEN '$numberInt' THEN 2 WHEN '$oid' THEN 7 WHEN '$date' THEN 9 ELSE 4 END END AS weight,
  CASE WHEN json_type(v, '$._id') <> 'OBJECT' AND json_type(v, '$._id') <> 'VARCHAR' THEN CAST(json_extract_string(v, '$._id') AS DOUBLE)
    WHEN json_keys(v, '$._id')[1] LIKE '$number%' THEN CAST(coalesce(json_extract_string(v, '$._id."$numberLong"'), json_extract_string(v, '$._id."$numberInt"')) AS DOUBLE) END AS number,
  CASE WHEN json_type(v, '$._id') = 'VARCHAR' THEN json_extract_string(v, '$._id') WHEN json_keys(v, '$._id')[1] = '$oid' THEN lower(json_extract_string(v, '$._id."$oid"')) END AS text
FROM doc_store WHERE v IS NOT NULL
"""


def _mixed_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends of numbers, texts and object ids in one order."""
    ends = []
    for way, direction in (("asc", 1), ("desc", -1)):
        pairs = [("_id", direction)]
        rows = frames.matching(_documents(spark, sf), {"_id": {"$type": ["number", "string", "objectId"]}}, pairs)
        ends.append(frames.ordered(rows, pairs).limit(2000).select(F.lit(way).alias("way"), F.col("seq").alias("row_id")))
    return ends[0].unionAll(ends[1])


_add(
    "mixed_type_sort",
    _mixed_sort,
    " UNION ALL ".join(
        f"(SELECT '{way}' AS way, row_id FROM ({_ID_RANK}) WHERE weight IN (2, 3, 7) ORDER BY weight {way}, number {way} NULLS LAST, text {way} NULLS LAST, row_id LIMIT 2000)" for way in ("asc", "desc")
    ),
)
_add(
    "mixed_type_distinct",
    lambda s, d: frames.distinct_values(_documents(s, d), "_id", {"_id": {"$type": ["number", "string", "objectId"]}}).agg(F.count("*").alias("n")),
    f"SELECT count(*) AS n FROM (SELECT DISTINCT weight, number, text FROM ({_ID_RANK}) WHERE weight IN (2, 3, 7))",
)
_add(
    "cross_type_compare",
    lambda s, d: frames.matching(_documents(s, d), {"$or": [{"_id": {"$gt": 1100}}, {"_id": {"$lt": "c"}}]}).select(F.col("seq").alias("row_id")),
    f"SELECT row_id FROM ({_ID_RANK}) WHERE weight = 2 AND number > 1100 OR weight = 3 AND text < 'c'",
)


def _stream_find(spark: SparkSession, sf: str) -> DataFrame:
    schema = _table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return drained(find_stream(stream, {"value": {"$gt": 50}, "event_type": {"$in": ["view", "click"]}}, ["event_id", "user_id", "value"]), "events")


_add("stream_find", _stream_find, "SELECT event_id, user_id, value FROM events WHERE value > 50 AND event_type IN ('view', 'click')")

