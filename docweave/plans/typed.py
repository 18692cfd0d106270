"""Filters and paths on typed tables, as Spark columns.

In a typed table null and missing are the same. Every condition is built
together with its complement, so that negations keep rows with nulls and
comparisons of plain columns stay in a form that Parquet can push down.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.compat import DEFAULT, CompatProfile
from docweave.errors import OperationFailure
from docweave.functions.bsontypes import Decimal128, MaxKey, MinKey, Regex
from docweave.plans import spec as S
from docweave.plans.regexes import to_java

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
#: A condition on one value, or None if no value of its type can meet it.
Leaf = Callable[[Column, T.DataType], Column | None]


class Pred(NamedTuple):
    """``pos`` is true where the condition holds, ``neg`` where it doesn't.

    Each row makes exactly one of them true; the other one is false or null.
    """

    pos: Column
    neg: Column


def _never() -> Pred:
    return Pred(F.lit(False), F.lit(True))


def _general(pos: Column | None) -> Pred:
    return _never() if pos is None else Pred(pos, ~F.coalesce(pos, F.lit(False)))


def _any(parts: list[Column | None]) -> Column | None:
    found = [p for p in parts if p is not None]
    if not found:
        return None
    out = found[0]
    for p in found[1:]:
        out = out | p
    return out


def _both(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def field_of(dtype: T.StructType, name: str) -> T.StructField | None:
    """The field of exactly this name; letter case counts."""
    return next((f for f in dtype.fields if f.name == name), None)


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, (*_INTEGERS, *_FLOATS, T.DecimalType)):
        return "number"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    return "other"


def value_class(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, Decimal, Decimal128)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (datetime, date)):
        return "date"
    if isinstance(value, bytes):
        return "binary"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, (list, tuple)):
        return "array"
    return "other"


def _type_ids(dtype: T.DataType) -> int:
    for kind, number in (((T.ByteType, T.ShortType, T.IntegerType), 16), (T.LongType, 18), (_FLOATS, 1), (T.DecimalType, 19), (T.StringType, 2), ((T.StructType, T.MapType), 3), (T.ArrayType, 4), (T.BinaryType, 5), (T.BooleanType, 8), ((T.TimestampType, T.TimestampNTZType, T.DateType), 9)):
        if isinstance(dtype, kind):
            return number
    return 0


def literal(value, dtype: T.DataType) -> Column:
    """A literal of the class of ``dtype``, of its type where that loses nothing."""
    if isinstance(value, Decimal128):
        value = value.value
    if isinstance(value, datetime):
        if isinstance(dtype, T.TimestampNTZType) or value.tzinfo is None:
            naive = value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
            return F.lit(naive.isoformat(sep=" ")).cast(dtype)
        return F.lit(value).cast(dtype)
    if isinstance(value, dict):
        return F.struct(*[literal(v, dtype[k].dataType if isinstance(dtype, T.StructType) and field_of(dtype, k) else T.NullType()).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        inner = dtype.elementType if isinstance(dtype, T.ArrayType) else T.NullType()
        return F.array(*[literal(v, inner) for v in value])
    if isinstance(value, int) and not isinstance(value, bool) and isinstance(dtype, _FLOATS) and abs(value) <= 1 << 53:
        return F.lit(float(value))
    return F.lit(value)


# --- conditions on one value ---------------------------------------------


def _number_leaf(op: str, value, col: Column, dtype: T.DataType) -> Column | None:
    if isinstance(value, Decimal128):
        value = value.value
    if value != value:
        return F.isnan(col) if op == "eq" and isinstance(dtype, _FLOATS) else None
    if isinstance(dtype, _INTEGERS):
        if isinstance(value, (float, Decimal)):
            if value in (float("inf"), float("-inf")):
                holds = op in (("lt", "lte") if value > 0 else ("gt", "gte"))
                return col.isNotNull() if holds else None
            if value != math.floor(value):
                if op == "eq":
                    return None
                op, value = ("gt", math.floor(value)) if op in ("gt", "gte") else ("lt", math.ceil(value))
            value = int(value)
        if not -(1 << 63) <= value < 1 << 63:
            holds = op in (("lt", "lte") if value > 0 else ("gt", "gte"))
            return col.isNotNull() if holds else None
    elif isinstance(dtype, _FLOATS) and isinstance(value, int):
        try:
            near = float(value)
        except OverflowError:
            near = math.inf if value > 0 else -math.inf
        if near == value:
            value = near
        elif op == "eq":
            return None
        else:  # between two doubles: the bound moves to the one beside it
            op = {"gt": "gte", "gte": "gte", "lt": "lt", "lte": "lt"}[op] if near > value else {"gt": "gt", "gte": "gt", "lt": "lte", "lte": "lte"}[op]
            value = near
    elif isinstance(dtype, T.DecimalType):
        value = Decimal(str(value)) if isinstance(value, float) else Decimal(value)
    out = _apply(op, col, literal(value, dtype))
    # Spark has NaN above all numbers; here it compares with none
    return out & ~F.isnan(col) if isinstance(dtype, _FLOATS) and op in ("gt", "gte") else out


def _apply(op: str, col: Column, lit: Column) -> Column:
    return {"eq": lambda: col == lit, "gt": lambda: col > lit, "gte": lambda: col >= lit, "lt": lambda: col < lit, "lte": lambda: col <= lit}[op]()


def _object_equals(value: dict, col: Column, dtype: T.DataType) -> Column | None:
    """Equality in the order of fields; fields that ``value`` lacks are null."""
    if isinstance(dtype, T.MapType):
        return None
    names = [f.name for f in dtype.fields]
    if [n for n in names if n in value] != list(value):
        return None
    parts = [col.isNotNull()]
    for f in dtype.fields:
        inner = col.getField(f.name)
        if f.name not in value or value[f.name] is None:
            parts.append(inner.isNull())
        else:
            p = compare("eq", value[f.name], inner, f.dataType)
            if p is None:
                return None
            parts.append(p)
    return _both(parts)


def _array_equals(value: list, col: Column, dtype: T.ArrayType) -> Column | None:
    parts = [F.size(col) == len(value)]
    for i, x in enumerate(value):
        item = F.get(col, F.lit(i))
        p = item.isNull() if x is None else compare("eq", x, item, dtype.elementType)
        if p is None:
            return None
        parts.append(p)
    return _both(parts)


def compare(op: str, value, col: Column, dtype: T.DataType, compat: CompatProfile = DEFAULT) -> Column | None:
    """``col op value``; None if values of this type can't be compared with it."""
    if isinstance(value, (MinKey, MaxKey)):
        low = isinstance(value, MinKey)
        return col.isNotNull() if compat.extremes_compare_all and op in (("gt", "gte") if low else ("lt", "lte")) else None
    kind = type_class(dtype)
    if kind != value_class(value):
        return None
    if kind == "number":
        return _number_leaf(op, value, col, dtype)
    if kind == "object":
        if op == "eq":
            return _object_equals(value, col, dtype)
        raise OperationFailure("documents are compared by order only in document collections", 2)
    if kind == "array" and op == "eq":
        return _array_equals(list(value), col, dtype)
    return _apply(op, col, literal(value, dtype))


def _modulo(divisor: int, remainder: int, col: Column, dtype: T.DataType) -> Column | None:
    if type_class(dtype) != "number":
        return None
    d = F.lit(divisor)
    floor_mod = ((col % d) + d) % d
    if isinstance(dtype, _INTEGERS):
        return floor_mod == F.lit(remainder)
    # NaN and infinities have no remainder
    return F.coalesce(floor_mod.try_cast("long") == F.lit(remainder), F.lit(False))


def leaf_of(op: str, arg, compat: CompatProfile) -> Leaf:
    if op in ("regex", "regex_or_equal", "regex_equal"):
        pattern = None if op == "regex_equal" else to_java(arg)
        return lambda col, dtype: col.rlike(pattern) if pattern and isinstance(dtype, T.StringType) else None
    if op == "type":
        return lambda col, dtype: col.isNotNull() if _type_ids(dtype) in arg else None
    if op == "mod":
        return lambda col, dtype: _modulo(*arg, col, dtype)
    if op == "in":

        def member(col: Column, dtype: T.DataType) -> Column | None:
            plain = [x for x in arg if not isinstance(x, (Regex, float, dict, list, tuple)) and x is not None and value_class(x) == type_class(dtype) in ("number", "string", "bool") and not isinstance(dtype, T.DecimalType)]
            if isinstance(dtype, _INTEGERS):
                plain = [x for x in plain if isinstance(x, int) and -(1 << 63) <= x < 1 << 63]
            elif type_class(dtype) == "number":
                plain = []
            rest = [x for x in arg if x is not None and not any(x is p for p in plain)]
            parts: list[Column | None] = [col.isin(plain)] if plain else []
            for x in rest:
                parts.append(leaf_of("regex", x, compat)(col, dtype) if isinstance(x, Regex) else compare("eq", x, col, dtype, compat))
            return _any(parts)

        return member
    return lambda col, dtype: compare(op, arg, col, dtype, compat)


# --- paths ---------------------------------------------------------------


def _exists(col: Column, dtype: T.DataType, test: Callable[[Column], Column | None]) -> Column | None:
    """``exists(col, test)``; None if ``test`` can't hold for the element type."""
    if test(F.lit(None).cast(dtype)) is None:
        return None
    return F.exists(col, test)


def reached(col: Column, dtype: T.DataType, steps: list[str], leaf: Callable[[Column, T.DataType, bool], Column | None], positioned: bool = False) -> Column | None:
    """Whether some value at the path meets ``leaf`` (value, type, positioned)."""
    if not steps:
        return leaf(col, dtype, positioned)
    step, rest = steps[0], steps[1:]
    if isinstance(dtype, T.StructType):
        f = field_of(dtype, step)
        return None if f is None else reached(col.getField(step), f.dataType, rest, leaf)
    if isinstance(dtype, T.MapType):
        return reached(F.try_element_at(col, F.lit(step)), dtype.valueType, rest, leaf)
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        parts = []
        if isinstance(inner, (T.StructType, T.MapType)):
            parts.append(_exists(col, inner, lambda x: reached(x, inner, steps, leaf)))
        if step.isdigit():
            parts.append(reached(F.get(col, F.lit(int(step))), inner, rest, leaf, True))
        return _any(parts)
    return None


def _full(leaf: Leaf) -> Callable[[Column, T.DataType, bool], Column | None]:
    """``leaf`` on the value, and on its elements if it is an array not reached by position."""

    def at(col: Column, dtype: T.DataType, positioned: bool) -> Column | None:
        own = leaf(col, dtype)
        if isinstance(dtype, T.ArrayType) and not positioned:
            return _any([_exists(col, dtype.elementType, lambda x: leaf(x, dtype.elementType)), own])
        return own

    return at


def _null_at(col: Column, dtype: T.DataType, steps: list[str], in_array: bool = False, positioned: bool = False) -> Column | None:
    """Null or missing, or an array with a null element."""
    if not steps:
        if isinstance(dtype, T.ArrayType) and not positioned:
            return col.isNull() | F.exists(col, lambda x: x.isNull())
        return col.isNull()
    step, rest = steps[0], steps[1:]
    if isinstance(dtype, T.StructType):
        f = field_of(dtype, step)
        if f is None:
            return None if in_array and positioned else F.lit(True)
        below = _null_at(col.getField(step), f.dataType, rest)
        # a null in an array is no document that could miss a field
        return _not_null_and(col, below) if in_array and positioned else below
    if isinstance(dtype, T.MapType):
        return _null_at(F.try_element_at(col, F.lit(step)), dtype.valueType, rest)
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        parts: list[Column | None] = [] if in_array else [col.isNull()]
        if isinstance(inner, (T.StructType, T.MapType)):
            parts.append(_exists(col, inner, lambda x: _not_null_and(x, _null_at(x, inner, steps, True))))
        if step.isdigit():
            # a position beyond the end isn't missing
            at = int(step)
            below = _null_at(F.get(col, F.lit(at)), inner, rest, True, True)
            parts.append(None if below is None else (F.size(col) > at) & below)
        return _any(parts)
    return None if in_array and positioned else F.lit(True)


def _present(col: Column, dtype: T.DataType, steps: list[str]) -> Column | None:
    """Whether a path exists; a null element has its place in the array, a null field is missing."""
    if not steps:
        return col.isNotNull()
    step, rest = steps[0], steps[1:]
    if isinstance(dtype, T.StructType):
        f = field_of(dtype, step)
        return None if f is None else _present(col.getField(step), f.dataType, rest)
    if isinstance(dtype, T.MapType):
        return _present(F.try_element_at(col, F.lit(step)), dtype.valueType, rest)
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        parts = []
        if isinstance(inner, (T.StructType, T.MapType)):
            parts.append(_exists(col, inner, lambda x: _present(x, inner, steps)))
        if step.isdigit():
            parts.append(_present(F.get(col, F.lit(int(step))), inner, rest) if rest else F.coalesce(F.size(col) > int(step), F.lit(False)))
        return _any(parts)
    return None


def _not_null_and(x: Column, test: Column | None) -> Column | None:
    return None if test is None else x.isNotNull() & test


class Typed:
    """The compiler for one schema."""

    def __init__(self, schema: T.StructType, compat: CompatProfile = DEFAULT):
        self.schema, self.compat = schema, compat

    def start(self, path: str) -> tuple[Column, T.DataType, list[str]] | None:
        """The top-level column of a path, its type and the steps below it."""
        name, *rest = path.split(".")
        f = field_of(self.schema, name)
        return None if f is None else (F.col(f"`{name}`"), f.dataType, rest)

    def plain(self, path: str) -> tuple[Column, T.DataType] | None:
        """The column at a path that passes structs only and ends in no array."""
        at = self.start(path)
        if at is None:
            return None
        col, dtype, steps = at
        for s in steps:
            f = field_of(dtype, s) if isinstance(dtype, T.StructType) else None
            if f is None:
                return None
            col, dtype = col.getField(s), f.dataType
        return None if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else (col, dtype)

    # -- filters --------------------------------------------------------

    def filter(self, spec: dict | None) -> Pred:
        return self.node(S.parse_filter(spec, self.compat))

    def node(self, tree: S.Node) -> Pred:
        if isinstance(tree, S.Not):
            inner = self.node(tree.part)
            return Pred(inner.neg, inner.pos)
        if isinstance(tree, (S.All, S.Any_)):
            parts = [self.node(p) for p in tree.parts]
            if not parts:
                return Pred(F.lit(True), F.lit(False)) if isinstance(tree, S.All) else _never()
            both, either = _both([p.pos for p in parts]), _any([p.pos for p in parts])
            if isinstance(tree, S.All):
                return Pred(both, _any([p.neg for p in parts]))
            return Pred(either, _both([p.neg for p in parts]))
        return self._test(tree)

    def _test(self, test: S.Test) -> Pred:
        at = self.start(test.path)
        op, arg = test.op, test.arg
        if (op == "eq" and arg is None) or (op == "in" and any(x is None for x in arg)):
            null = self._null(test.path)
            if op == "eq":
                return null
            rest = self._test(S.Test(test.path, "in", [x for x in arg if x is not None]))
            return Pred(null.pos | rest.pos, null.neg & rest.neg)
        if op == "all":
            parts = [self._test(S.Test(test.path, "regex_or_equal" if isinstance(x, Regex) else "eq", x)) for x in arg]
            return Pred(_both([p.pos for p in parts]), _any([p.neg for p in parts])) if parts else _never()
        if at is None:
            return _never()
        col, dtype, steps = at
        if op == "exists":
            pos = _present(col, dtype, steps)
            plain = self.plain(test.path)
            return _never() if pos is None else Pred(pos, plain[0].isNull() if plain else ~F.coalesce(pos, F.lit(False)))
        if op == "size":
            return _general(reached(col, dtype, steps, lambda c, d, p: F.when(c.isNotNull(), F.size(c) == arg) if isinstance(d, T.ArrayType) else None))
        if op == "elem":
            return _general(reached(col, dtype, steps, lambda c, d, p: self._element_of(c, d, arg)))
        if op == "all_elem":
            return self._all_elements(col, dtype, steps, arg)
        leaf = leaf_of(op, arg, self.compat)
        plain = self.plain(test.path)
        if plain is None:
            return _general(reached(col, dtype, steps, _full(leaf)))
        pos = leaf(*plain)
        return _never() if pos is None else Pred(pos, self._complement(op, arg, pos, *plain))

    def _complement(self, op: str, arg, pos: Column, col: Column, dtype: T.DataType) -> Column:
        """Negation of a comparison of a plain column, fit for pushdown."""
        kind = value_class(arg) if op == "eq" else ""
        if kind in ("string", "bool", "date", "binary") or (kind == "number" and (isinstance(arg, int) and isinstance(dtype, _INTEGERS) or isinstance(arg, (int, float)) and arg == arg and isinstance(dtype, _FLOATS) and abs(arg) <= 1 << 53)):
            return ~col.eqNullSafe(literal(arg, dtype))
        opposite = {"gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}.get(op)
        if opposite and not isinstance(dtype, _FLOATS):
            inverse = compare(opposite, arg, col, dtype, self.compat)
            if inverse is not None:
                return col.isNull() | inverse
        return ~F.coalesce(pos, F.lit(False)) if op in ("gt", "gte", "lt", "lte") else col.isNull() | ~pos

    def _null(self, path: str) -> Pred:
        at = self.start(path)
        if at is None:
            return Pred(F.lit(True), F.lit(False))
        pos = _null_at(*at)
        if pos is None:
            return _never()
        plain = self.plain(path)
        return Pred(pos, plain[0].isNotNull() if plain is not None else ~F.coalesce(pos, F.lit(False)))

    # -- elements -------------------------------------------------------

    def element(self, node: S.Node, col: Column, dtype: T.DataType) -> Column | None:
        """The condition of ``$elemMatch`` on one element."""
        if isinstance(node, S.All):
            parts = [self.element(p, col, dtype) for p in node.parts]
            return None if any(p is None for p in parts) else _both(parts) if parts else F.lit(True)
        if isinstance(node, S.Any_):
            return _any([self.element(p, col, dtype) for p in node.parts])
        if isinstance(node, S.Not):
            inner = self.element(node.part, col, dtype)
            return F.lit(True) if inner is None else ~F.coalesce(inner, F.lit(False))
        if node.op == "fields":
            if not isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
                return None
            inner = self.element(node.arg, col, dtype)
            return None if inner is None else col.isNotNull() & inner
        steps = node.path.split(".") if node.path else []
        if node.op == "eq" and node.arg is None:
            return _null_at(col, dtype, steps) if steps else col.isNull()
        if node.op == "exists":
            return _present(col, dtype, steps) if steps else F.lit(True)
        if node.op == "size":
            return reached(col, dtype, steps, lambda c, d, p: F.size(c) == node.arg if isinstance(d, T.ArrayType) else None)
        if node.op == "elem":
            return reached(col, dtype, steps, lambda c, d, p: self._element_of(c, d, node.arg))
        if node.op == "all":
            parts = [self.element(S.Test(node.path, "eq", x), col, dtype) for x in node.arg]
            return None if not parts or any(p is None for p in parts) else _both(parts)
        if node.op == "in" and any(x is None for x in node.arg):
            return _any([col.isNull() if not steps else _null_at(col, dtype, steps), self.element(S.Test(node.path, "in", [x for x in node.arg if x is not None]), col, dtype)])
        leaf = leaf_of(node.op, node.arg, self.compat)
        return reached(col, dtype, steps, _full(leaf)) if steps else leaf(col, dtype)

    def _element_of(self, col: Column, dtype: T.DataType, node: S.Node) -> Column | None:
        if not isinstance(dtype, T.ArrayType):
            return None
        return _exists(col, dtype.elementType, lambda x: self.element(node, x, dtype.elementType))

    def _all_elements(self, col: Column, dtype: T.DataType, steps: list[str], nodes: list[S.Node]) -> Pred:
        """Every condition is met by an element of every array reached."""
        reached_any = reached(col, dtype, steps, lambda c, d, p: c.isNotNull() if isinstance(d, T.ArrayType) else None)
        if reached_any is None:
            return _never()
        parts = [reached_any]
        for node in nodes:
            fails = reached(col, dtype, steps, lambda c, d, p, n=node: self._fails(c, d, n))
            if fails is not None:
                parts.append(~F.coalesce(fails, F.lit(False)))
        return _general(_both(parts))

    def _fails(self, col: Column, dtype: T.DataType, node: S.Node) -> Column | None:
        if not isinstance(dtype, T.ArrayType):
            return None
        met = self._element_of(col, dtype, node)
        return col.isNotNull() if met is None else col.isNotNull() & ~F.coalesce(met, F.lit(False))

    # -- values ---------------------------------------------------------

    def flat_values(self, path: str) -> tuple[Column, T.DataType] | None:
        """All values at a path as an array column (arrays unpacked once) and their type.

        Null stands for a missing value; an empty array gives none.
        """
        at = self.start(path)
        return None if at is None else _flat(*at)


def _flat(col: Column, dtype: T.DataType, steps: list[str], positioned: bool = False) -> tuple[Column, T.DataType] | None:
    if not steps:
        if isinstance(dtype, T.ArrayType) and not positioned:
            return F.coalesce(col, F.array(F.lit(None).cast(dtype.elementType))), dtype.elementType
        return F.array(col), dtype
    step, rest = steps[0], steps[1:]
    if isinstance(dtype, T.StructType):
        f = field_of(dtype, step)
        return None if f is None else _flat(col.getField(step), f.dataType, rest)
    if isinstance(dtype, T.MapType):
        return _flat(F.try_element_at(col, F.lit(step)), dtype.valueType, rest)
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        parts = []
        if isinstance(inner, (T.StructType, T.MapType)) and _flat(F.lit(None).cast(inner), inner, steps) is not None:
            kind = _flat(F.lit(None).cast(inner), inner, steps)[1]
            items = F.filter(col, lambda x: x.isNotNull())
            parts.append((F.flatten(F.transform(items, lambda x: _flat(x, inner, steps)[0])), kind))
        if step.isdigit():
            one = _flat(F.get(col, F.lit(int(step))), inner, rest, True)
            if one is not None:
                parts.append(one)
        if not parts:
            return None
        out, kind = parts[0]
        if len(parts) > 1 and parts[1][1] == kind:
            out = F.concat(out, parts[1][0])
        return F.coalesce(out, F.array(F.lit(None).cast(kind))), kind
    return None


# --- sorting and reading -------------------------------------------------


def sort_columns(schema: T.StructType, pairs: list[tuple[str, int]], compat: CompatProfile = DEFAULT) -> list[Column]:
    """``orderBy`` columns: an array sorts by its least value, descending by its greatest."""
    typed = Typed(schema, compat)
    out: list[Column] = []
    for path, direction in pairs:
        if direction not in (1, -1) or isinstance(direction, bool):
            raise OperationFailure("a sort direction is 1 or -1", 2)
        plain = typed.plain(path)
        if plain is not None:
            col, dtype = plain
            if isinstance(dtype, _FLOATS):  # NaN sorts below all numbers
                rank = F.when(col.isNull(), 0).when(F.isnan(col), 1).otherwise(2)
                out.append(rank.asc() if direction == 1 else rank.desc())
            out.append(col.asc_nulls_first() if direction == 1 else col.desc_nulls_last())
            continue
        found = typed.flat_values(path)
        if found is None:
            continue
        values, _ = found
        ranked = F.transform(values, lambda x: F.struct(F.when(x.isNull(), 1).otherwise(2).alias("w"), x.alias("v")))
        key = F.array_min(ranked) if direction == 1 else F.array_max(ranked)
        rank, value = F.coalesce(key.getField("w"), F.lit(0)), key.getField("v")  # no values at all: an empty array
        out += [rank.asc(), value.asc()] if direction == 1 else [rank.desc(), value.desc()]
    return out


def find(df: DataFrame, filter: dict | None = None, projection=None, sort: list[tuple[str, int]] | None = None, skip: int = 0, limit: int = 0, max_scan: int | None = None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """A query on a typed table.

    Rows have no order of their own: ``skip`` and ``limit`` need a ``sort``
    that tells all rows apart to give the same rows each time.
    """
    from docweave.plans.reshape import project

    if skip < 0:
        raise ValueError("skip must be >= 0")
    out = df.limit(max_scan) if max_scan else df
    if filter:
        out = out.where(Typed(df.schema, compat).filter(filter).pos)
    if sort:
        keys = sort_columns(df.schema, sort, compat)
        out = out.orderBy(*keys) if keys else out
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(abs(limit))
    return out if projection is None else project(out, projection, filter, compat)


def distinct(df: DataFrame, path: str, filter: dict | None = None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """``value``: the distinct values at a path, arrays unpacked once; missing ones have none."""
    typed = Typed(df.schema, compat)
    rows = df.where(typed.filter(filter).pos) if filter else df
    plain = typed.plain(path)
    if plain is not None:
        return rows.select(plain[0].alias("value")).where("value IS NOT NULL").distinct()
    found = typed.flat_values(path)
    if found is None:
        return rows.select(F.lit(None).cast("string").alias("value")).where("false")
    return rows.select(F.explode(found[0]).alias("value")).where("value IS NOT NULL").distinct()


def count_documents(df: DataFrame, filter: dict | None = None, skip: int = 0, limit: int = 0, compat: CompatProfile = DEFAULT) -> DataFrame:
    """``n``: the number of matches, after ``skip`` and ``limit``."""
    return find(df, filter, skip=skip, limit=limit, compat=compat).agg(F.count("*").alias("n"))
