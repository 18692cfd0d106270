"""Filters of documents as expressions on VARIANT, for what they can settle.

The expression is true where a document surely matches, false where it surely
doesn't, and null where only a full reading can tell: arrays on the path,
wrapped values, operators on elements, text that VARIANT doesn't hold. Its
logic is that of SQL, so negations and combinations need no care.
"""

from __future__ import annotations

import re
from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.bsontypes import TYPE_IDS
from docweave.plans import spec as S

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Whole numbers that a double holds exactly.
_EXACT = 2**53
_NUMBERS = {TYPE_IDS[n] for n in ("double", "int", "long")}
_DOC = "__variant"
_ORDERS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "="}


def _at(names: list[str], kind: str = "variant") -> str:
    return f"try_variant_get({_DOC}, '$.{'.'.join(names)}', '{kind}')"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scalar(names: list[str], missing: str, number: str, string: str, other: str) -> str:
    """By what lies at the path: nothing, a number, a string, a boolean or null; null for the rest."""
    kind = f"schema_of_variant({_at(names)})"
    fans_out = " OR ".join(f"{_at(names[:n], 'array<variant>')} IS NOT NULL" for n in range(1, len(names)))
    missing = f"CASE WHEN {fans_out} THEN NULL ELSE {missing} END" if fans_out else missing
    return (
        f"CASE WHEN {_at(names)} IS NULL THEN {missing} WHEN {kind} = 'STRING' THEN {string} WHEN {kind} IN ('BOOLEAN', 'VOID') THEN {other} "
        f"WHEN {kind} IN ('BIGINT', 'DOUBLE') OR startswith({kind}, 'DECIMAL') THEN {number} END"
    )


def _compared(names: list[str], op: str, arg) -> str | None:
    sign = _ORDERS[op]
    if isinstance(arg, str) and op == "eq" and arg.isprintable():
        return _scalar(names, "false", "false", f"{_at(names, 'string')} = {_text(arg)}", "false")
    if isinstance(arg, (int, float)) and not isinstance(arg, bool) and isfinite(arg) and abs(arg) < _EXACT:
        number = _at(names, "double")
        return _scalar(names, "false", f"CASE WHEN abs({number}) < {_EXACT} THEN {number} {sign} CAST('{float(arg)!r}' AS DOUBLE) END", "false", "false")
    if arg is None and op == "eq":
        kind = f"schema_of_variant({_at(names)})"
        return _scalar(names, "true", "false", "false", f"{kind} = 'VOID'")
    return None


def _test(test: S.Test) -> str | None:
    names = test.path.split(".")
    if not all(_NAME.match(n) for n in names):
        return None
    if test.op in _ORDERS:
        return _compared(names, test.op, test.arg)
    if test.op == "in":
        parts = [_compared(names, "eq", x) for x in test.arg]
        return f"({' OR '.join(parts)})" if parts and None not in parts else None
    if test.op == "exists":
        return f"({_at(names)} IS NOT NULL OR {_scalar(names, 'false', 'true', 'true', 'true')})"
    if test.op == "size":
        items = _at(names, "array<variant>")
        return f"CASE WHEN {items} IS NOT NULL THEN size({items}) = {int(test.arg)} ELSE {_scalar(names, 'false', 'false', 'false', 'false')} END"
    if test.op == "type":
        ids = test.arg
        number = "true" if _NUMBERS <= ids else "false" if not _NUMBERS & ids else "NULL"
        says = lambda name: str(TYPE_IDS[name] in ids).lower()
        kind = f"schema_of_variant({_at(names)})"
        return _scalar(names, "false", number, says("string"), f"CASE {kind} WHEN 'VOID' THEN {says('null')} ELSE {says('bool')} END")
    if test.op == "regex":
        return _scalar(names, "false", "false", "NULL", "false")
    return None


def _sql(node: S.Node) -> str | None:
    if isinstance(node, (S.All, S.Any_)):
        word = " AND " if isinstance(node, S.All) else " OR "
        parts = [_sql(p) for p in node.parts]
        if not parts or all(p is None for p in parts):
            return None
        return f"({word.join(p or 'CAST(NULL AS BOOLEAN)' for p in parts)})"
    if isinstance(node, S.Not):
        part = _sql(node.part)
        return None if part is None else f"(NOT {part})"
    return _test(node) if isinstance(node, S.Test) else None


def _verdict(tree: S.Node) -> str | None:
    sql = _sql(tree)
    # a root that is no plain object is left to the reader
    return sql and f"""element_at(transform(array(CASE WHEN doc RLIKE '^[ \\\\t\\\\r\\\\n]*[{{][ \\\\t\\\\r\\\\n]*"[^$"]' THEN try_parse_json(doc) END), {_DOC} -> CASE WHEN {_DOC} IS NOT NULL THEN {sql} END), 1)"""


def judged(frame: DataFrame, tree: S.Node) -> DataFrame:
    """``frame`` with ``sure``: whether a document matches, null where an expression can't tell."""
    sql = _verdict(tree)
    return frame.withColumn("sure", F.expr(sql) if sql else F.lit(None).cast("boolean"))


def candidates(frame: DataFrame, tree: S.Node) -> DataFrame:
    """``frame`` with ``sure``, without the rows that surely don't match; each text is parsed once."""
    sql = _verdict(tree)
    if not sql:
        return judged(frame, tree)
    return frame.select("*", F.expr(f"inline(filter(array(named_struct('sure', {sql})), r -> coalesce(r.sure, true)))"))
