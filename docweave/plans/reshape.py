"""Projections and updates of typed tables, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.compat import DEFAULT, CompatProfile
from docweave.documents.project import Projection
from docweave.documents.update import Update, Updater
from docweave.errors import OperationFailure, WriteError
from docweave.plans import spec as S
from docweave.plans.spec import equalities
from docweave.plans.typed import _FLOATS, _INTEGERS, Typed, compare, field_of, find, literal, type_class, value_class

# --- projections -----------------------------------------------------------


def slice_array(col: Column, skip: int | None, limit: int) -> Column:
    """``$slice`` of an array column; a null array stays null."""
    n = F.size(col)
    if skip is None:
        return F.slice(col, F.lit(1), F.lit(limit)) if limit >= 0 else F.slice(col, F.greatest(F.lit(1), n + limit + 1), F.lit(-limit))
    start = F.lit(skip + 1) if skip >= 0 else F.greatest(F.lit(1), n + skip + 1)
    return F.slice(col, start, F.lit(limit))


def _kept(col: Column, dtype: T.DataType, names: dict | bool) -> tuple[Column, T.DataType] | None:
    """A value reduced to the included names; None if nothing of it is left."""
    if names is True:
        return col, dtype
    if isinstance(dtype, T.StructType):
        parts = [(f.name, _kept(col.getField(f.name), f.dataType, names[f.name])) for f in dtype.fields if f.name in names]
        parts = [(n, p) for n, p in parts if p is not None]
        kind = T.StructType([T.StructField(n, p[1]) for n, p in parts])
        if not parts:
            return None
        return F.when(col.isNotNull(), F.struct(*[p[0].alias(n) for n, p in parts])), kind
    if isinstance(dtype, T.ArrayType):
        inner = _kept(F.lit(None).cast(dtype.elementType), dtype.elementType, names)
        if inner is None:  # elements that are no documents are dropped
            return F.when(col.isNotNull(), F.array().cast(dtype)), dtype
        return F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: _kept(x, dtype.elementType, names)[0]), T.ArrayType(inner[1])
    return None


def _without(col: Column, dtype: T.DataType, names: dict | bool) -> Column | None:
    """A value without the excluded names; None if it is excluded itself."""
    if names is True:
        return None
    if isinstance(dtype, T.StructType):
        parts = []
        for f in dtype.fields:
            inner = col.getField(f.name)
            left = _without(inner, f.dataType, names[f.name]) if f.name in names else inner
            if left is not None:
                parts.append(left.alias(f.name))
        return F.when(col.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda x: _without(x, dtype.elementType, names))
    return col


def first_hit(typed: Typed, filter: dict, top: str) -> Column | None:
    """0-based position of the first element of array ``top`` that meets the filter.

    The first condition of the filter on that array decides, as a positional
    ``$`` refers to one condition.
    """
    f = field_of(typed.schema, top)
    if f is None or not isinstance(f.dataType, T.ArrayType):
        return None
    col, inner = F.col(f"`{top}`"), f.dataType.elementType
    for test in _tests(S.parse_filter(filter, typed.compat)):
        if test.path.split(".")[0] != top:
            continue
        rest = test.path[len(top) + 1 :]
        if rest.split(".")[0].isdigit():
            return F.lit(int(rest.split(".")[0]))
        node: S.Node = test.arg if test.op == "elem" and not rest else S.Test(rest, test.op, test.arg)
        met = F.transform(col, lambda x: F.coalesce(typed.element(node, x, inner), F.lit(False)))
        return F.array_position(met, True) - 1
    return None


def _tests(node: S.Node) -> list[S.Test]:
    if isinstance(node, (S.All, S.Any_)):
        return [t for p in node.parts for t in _tests(p)]
    return [node] if isinstance(node, S.Test) else []


def project(df: DataFrame, spec, filter: dict | None = None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """The columns of a projection, in the table's order; ``_id`` comes first."""
    projection = Projection(spec or {"_id": 1}, filter, compat)
    typed = Typed(df.schema, compat)
    values: dict[str, tuple[Column, T.DataType]] = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    for path, (skip, limit) in projection.slices.items():
        top, *steps = path.split(".")
        if top in values:
            values[top] = (_change(*values[top], steps, lambda c, d: slice_array(c, skip, limit) if isinstance(d, T.ArrayType) else c), values[top][1])
    for path, node in projection.elements.items():
        if path in values and isinstance(values[path][1], T.ArrayType):
            col, dtype = values[path]
            kept = F.slice(F.filter(col, lambda x: F.coalesce(typed.element(node, x, dtype.elementType), F.lit(False))), 1, 1)
            values[path] = (F.when(F.size(kept) > 0, kept), dtype)
    if projection.positional is not None:
        top = projection.positional.split(".")[0]
        at = first_hit(typed, filter or {}, top)
        if at is not None:
            col, dtype = values[top]
            error = F.raise_error(F.lit("positional operator element mismatch")).cast(dtype)
            values[top] = (F.when(col.isNull(), None).when(at >= 0, F.array(F.get(col, at.cast("int")))).otherwise(error), dtype)
    names: dict = dict(projection.fields)
    if projection.include:
        for path in projection.slices:
            names.setdefault(path.split(".")[0], True)
    out = []
    for f in df.schema.fields:
        col, dtype = values[f.name]
        if f.name == "_id":
            if projection.with_id:
                out.insert(0, col.alias("_id"))
        elif projection.include is None:
            out.append(col.alias(f.name))
        elif projection.include:
            kept = _kept(col, dtype, names[f.name]) if f.name in names else None
            if kept is not None:
                out.append(kept[0].alias(f.name))
        else:
            left = _without(col, dtype, names[f.name]) if f.name in names else col
            if left is not None:
                out.append(left.alias(f.name))
    return df.select(*out)


def _change(col: Column, dtype: T.DataType, steps: list[str], change: Callable[[Column, T.DataType], Column]) -> Column:
    """A value with the part at a path changed, through structs and arrays of structs."""
    if not steps:
        return change(col, dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _change(x, dtype.elementType, steps, change))
    f = field_of(dtype, steps[0]) if isinstance(dtype, T.StructType) else None
    return col if f is None else col.withField(f"`{f.name}`", _change(col.getField(f.name), f.dataType, steps[1:], change))


# --- updates ---------------------------------------------------------------

_NOTHING = T.NullType()
#: A changed value and its type; None for the value removes the field.
_Rewrite = Callable[[Column, T.DataType], tuple[Column, T.DataType]]


def type_of(value) -> T.DataType:
    """The Spark type of a literal that makes a new field."""
    kind = value_class(value)
    if kind == "number":
        return T.DoubleType() if isinstance(value, float) else T.LongType()
    if kind == "object":
        return T.StructType([T.StructField(k, type_of(v)) for k, v in value.items()])
    if kind == "array":
        return T.ArrayType(type_of(value[0]) if value else T.StringType())
    return {"string": T.StringType(), "bool": T.BooleanType(), "date": T.TimestampType(), "binary": T.BinaryType()}.get(kind, _NOTHING)


def _typed_value(value, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """A literal as a value of ``dtype``, or of its own type where the field is new."""
    if value is None:
        return F.lit(None).cast(dtype), dtype
    if isinstance(dtype, T.NullType):
        dtype = type_of(value)
    if type_class(dtype) != value_class(value):
        raise OperationFailure(f"{value!r} would change the type {dtype.simpleString()}; use a document collection", 2)
    if isinstance(dtype, _INTEGERS) and isinstance(value, float):
        return literal(value, T.DoubleType()), T.DoubleType()
    return literal(value, dtype).cast(dtype), dtype


def conformed(col: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of an old type as one of a type with more fields or wider numbers."""
    if old == new:
        return col
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        parts = []
        for f in new.fields:
            own = field_of(old, f.name)
            parts.append((conformed(col.getField(f.name), own.dataType, f.dataType) if own else F.lit(None).cast(f.dataType)).alias(f.name))
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(col, lambda x: conformed(x, old.elementType, new.elementType))
    return col.cast(new)


class TypedUpdate:
    """An update of a typed table.

    The schema after it is known beforehand: new fields are added for all
    rows, ``$unset`` leaves null. A change of a field's type is an error.
    """

    def __init__(self, schema: T.StructType, update: dict, filter: dict | None = None, array_filters: list | None = None, compat: CompatProfile = DEFAULT, now: datetime | None = None):
        self.update = Update(update, array_filters, compat, now)
        self.filter_spec, self.typed = filter or {}, Typed(schema, compat)
        self.array_filters = {next(iter(S.paths_of(S.parse_filter(f, compat)))).split(".")[0]: f for f in array_filters or ()}

    def columns(self) -> dict[str, tuple[Column, T.DataType]]:
        """The columns that change and their types, as they are for matching rows."""
        values: dict[str, tuple[Column, T.DataType]] = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in self.typed.schema.fields}
        touched = []
        for path, op, arg in self.update.changes:
            if op == "$setOnInsert":
                continue
            top, *steps = path.split(".")
            if op == "$rename":
                touched += [top, arg.split(".")[0]]
                self._rename(values, path, arg)
                continue
            touched.append(top)
            old = values.get(top, (F.lit(None), _NOTHING))
            values[top] = self._rewrite(old[0], old[1], steps, top, lambda c, d, op=op, arg=arg: self._value(op, arg, c, d))
        return {name: values[name] for name in dict.fromkeys(touched)}

    def _rename(self, values: dict, path: str, target: str) -> None:
        old, dtype = values.get(path.split(".")[0], (F.lit(None), _NOTHING))
        for s in path.split(".")[1:]:
            f = field_of(dtype, s) if isinstance(dtype, T.StructType) else None
            if f is None:
                return
            old, dtype = old.getField(s), f.dataType
        if isinstance(dtype, T.NullType):
            return
        source, (top, *steps) = old, target.split(".")
        into = values.get(top, (F.lit(None), _NOTHING))
        # without a value to move the target keeps its own
        values[top] = self._rewrite(*into, steps, top, lambda c, d: (F.when(source.isNotNull(), source).otherwise(c.cast(dtype)), dtype))
        first, *rest = path.split(".")
        values[first] = self._rewrite(*values[first], rest, first, lambda c, d: (F.lit(None).cast(d), d))

    def _rewrite(self, col: Column, dtype: T.DataType, steps: list[str], path: str, change: _Rewrite) -> tuple[Column, T.DataType]:
        if not steps:
            return change(col, dtype)
        step, rest = steps[0], steps[1:]
        if isinstance(dtype, T.ArrayType):
            return self._rewrite_elements(col, dtype, step, rest, path, change)
        if step.startswith("$"):
            raise WriteError(f"cannot apply array updates to {path!r}, which is no array", 2)
        if isinstance(dtype, T.NullType):
            dtype = T.StructType([])
        if not isinstance(dtype, T.StructType):
            raise WriteError(f"cannot create field {step!r} in {path!r}", 28)
        old = field_of(dtype, step)
        inner = col.getField(step) if old else F.lit(None)
        new, kind = self._rewrite(inner, old.dataType if old else _NOTHING, rest, f"{path}.{step}", change)
        names = [f.name for f in dtype.fields] + ([] if old else [step])
        parts = [(new if n == step else col.getField(n)).alias(n) for n in names]
        fields = [T.StructField(n, kind if n == step else field_of(dtype, n).dataType) for n in names]
        return F.struct(*parts), T.StructType(fields)

    def _rewrite_elements(self, col: Column, dtype: T.ArrayType, step: str, rest: list[str], path: str, change: _Rewrite) -> tuple[Column, T.DataType]:
        inner = dtype.elementType
        below = lambda x: self._rewrite(x, inner, rest, f"{path}.{step}", change)
        kind = below(F.lit(None).cast(inner))[1]
        keep = lambda x: conformed(x, inner, kind)
        if step == "$[]":
            return F.transform(col, lambda x: below(x)[0]), T.ArrayType(kind)
        if step == "$":
            at = first_hit(self.typed, self.filter_spec, path.split(".")[0])
            if at is None:
                raise WriteError("the positional operator did not find the match needed from the query", 2)
            return F.transform(col, lambda x, i: F.when(i == at, below(x)[0]).otherwise(keep(x))), T.ArrayType(kind)
        if step[:2] == "$[":
            name = step[2:-1]
            node = S.parse_filter(self.array_filters[name], self.typed.compat)
            wrapped = T.StructType([T.StructField(name, inner)])
            holds = lambda x: F.coalesce(self.typed.element(node, F.struct(x.alias(name)), wrapped), F.lit(False))
            return F.transform(col, lambda x: F.when(holds(x), below(x)[0]).otherwise(keep(x))), T.ArrayType(kind)
        if not step.isdigit():
            raise WriteError(f"cannot create field {step!r} in array {path!r}", 28)
        at = int(step)
        places = F.sequence(F.lit(0), F.greatest(F.size(col) - 1, F.lit(at)))
        return F.transform(places, lambda i: F.when(i == at, below(F.get(col, i))[0]).otherwise(keep(F.get(col, i)))), T.ArrayType(kind)

    # -- values ---------------------------------------------------------

    def _value(self, op: str, arg, col: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
        if op == "$set":
            return _typed_value(arg, dtype)
        if op == "$unset":
            return F.lit(None).cast(dtype), dtype
        if op in ("$inc", "$mul"):
            return self._arithmetic(op, arg, col, dtype)
        if op in ("$min", "$max"):
            value, kind = _typed_value(arg, dtype)
            col = col.cast(kind)
            better = (value < col) if op == "$min" else (value > col)
            if isinstance(kind, _FLOATS):  # NaN is below all numbers
                better = better & ~F.isnan(col) if op == "$min" else better | F.isnan(col)
            return F.when(col.isNull() | better, value).otherwise(col), kind
        if op == "$currentDate":
            kind = T.TimestampType() if isinstance(dtype, T.NullType) else dtype
            return F.lit(self.update.now).cast(kind), kind
        if not isinstance(dtype, (T.ArrayType, T.NullType)):
            raise WriteError(f"cannot apply {op} to a non-array field", 2)
        return self._array(op, arg, col, dtype)

    def _arithmetic(self, op: str, arg, col: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
        if isinstance(dtype, T.NullType):
            value, kind = _typed_value(arg if op == "$inc" else 0.0, dtype)
            return value, kind
        if type_class(dtype) != "number":
            raise WriteError(f"cannot apply {op} to a value of non-numeric type", 14)
        kind = T.DoubleType() if isinstance(arg, float) and isinstance(dtype, _INTEGERS) else dtype
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)) and kind is dtype:
            kind = T.LongType()
        value, own = literal(arg, kind).cast(kind), col.cast(kind)
        if op == "$inc":
            return F.when(col.isNull(), value).otherwise(own + value), kind
        return F.when(col.isNull(), F.lit(0).cast(kind)).otherwise(own * value), kind

    def _array(self, op: str, arg, col: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
        if isinstance(dtype, T.NullType):
            if op in ("$pop", "$pull", "$pullAll"):
                return col, dtype
            first = next(iter(arg["$each"] if S.is_expression(arg) else [arg]), None)
            dtype = T.ArrayType(type_of(first))
            col = F.lit(None).cast(dtype)
        inner = dtype.elementType
        if op == "$pop":
            n = F.greatest(F.size(col) - 1, F.lit(0))
            return F.when(col.isNotNull(), F.slice(col, F.lit(1 if arg == 1 else 2), n)), dtype
        if op == "$pullAll":
            gone = lambda x: _either([x.isNull() if v is None else compare("eq", v, x, inner) for v in arg])
            return F.filter(col, lambda x: ~gone(x)), dtype
        if op == "$pull":
            node = self._pull_node(arg)
            return F.filter(col, lambda x: ~F.coalesce(_never_none(self.typed.element(node, x, inner)), F.lit(False))), dtype
        items = F.coalesce(col, F.array().cast(dtype))
        more = list(arg["$each"]) if S.is_expression(arg) else [arg]
        added = [_typed_value(v, inner)[0] for v in more]
        if op == "$addToSet":
            for v in added:
                items = F.when(F.array_contains(items, v), items).otherwise(F.array_append(items, v))
            return items, dtype
        new = F.array(*added).cast(dtype) if added else F.array().cast(dtype)
        options = arg if S.is_expression(arg) else {}
        if "$position" in options:
            at = int(options["$position"])
            n = F.size(items)
            place = F.least(F.lit(at), n) if at >= 0 else F.greatest(n + at, F.lit(0))
            items = F.concat(F.slice(items, F.lit(1), place), new, F.slice(items, place + 1, F.greatest(n - place, F.lit(0))))
        else:
            items = F.concat(items, new)
        cut = lambda x: slice_array(x, None, int(options["$slice"])) if "$slice" in options else x
        order = lambda x: self._sorted(x, inner, options["$sort"]) if "$sort" in options else x
        return (order(cut(items)) if self.typed.compat.slice_before_sort else cut(order(items))), dtype

    def _pull_node(self, arg) -> S.Node:
        if S.is_expression(arg):
            return S.All(S._operators("", arg, self.typed.compat))
        if isinstance(arg, dict):
            return S.Test("", "fields", S.parse_filter(arg, self.typed.compat))
        return S._field("", arg, self.typed.compat)

    @staticmethod
    def _sorted(items: Column, inner: T.DataType, by) -> Column:
        pairs = list(by.items()) if isinstance(by, dict) else [("", by)]

        def keys(x: Column) -> list[Column]:
            out = []
            for path, _ in pairs:
                v = x
                for s in path.split(".") if path else ():
                    v = v.getField(s)
                out.append(v)
            return out

        def order(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for x, y, (_, direction) in reversed(list(zip(keys(a), keys(b), pairs))):
                # null is below all values
                less = (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))
                more = (y.isNull() & x.isNotNull()) | F.coalesce(x > y, F.lit(False))
                out = F.when(less, -direction).when(more, direction).otherwise(out)
            return out

        return F.array_sort(items, order)


def _either(parts: list[Column | None]) -> Column:
    out = F.lit(False)
    for p in parts:
        if p is not None:
            out = out | F.coalesce(p, F.lit(False))
    return out


def _never_none(col: Column | None) -> Column:
    return F.lit(False) if col is None else col


def update_rows(df: DataFrame, filter: dict | None, update: dict, array_filters: list | None = None, compat: CompatProfile = DEFAULT, now: datetime | None = None, only: Column | None = None) -> DataFrame:
    """The whole table after an update of all rows that match, in one projection; with ``only``, of those among them."""
    changed = TypedUpdate(df.schema, update, filter, array_filters, compat, now).columns()
    matches = F.coalesce(Typed(df.schema, compat).filter(filter).pos, F.lit(False)) if filter else None
    if only is not None:
        matches = only if matches is None else matches & only
    names = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in [*names, *(n for n in changed if n not in names)]:
        if name not in changed:
            out.append(F.col(f"`{name}`"))
            continue
        new, kind = changed[name]
        if matches is not None:
            old = conformed(F.col(f"`{name}`"), names[name], kind) if name in names else F.lit(None)
            new = F.when(matches, new).otherwise(old)
        out.append(new.alias(name))
    return df.select(*out)


def first_match(df: DataFrame, filter: dict | None, order: list[tuple[str, int]], compat: CompatProfile = DEFAULT) -> Column:
    """A condition that holds for the first match by ``order``, whose columns have to tell all matches apart.

    One row is looked up for it. Without a match it holds for no row.
    """
    names = [c for c, _ in order]
    row = find(df, filter, names, order, limit=1, compat=compat).first()
    if row is None:
        return F.lit(False)
    matches = F.coalesce(Typed(df.schema, compat).filter(filter).pos, F.lit(False)) if filter else F.lit(True)
    return reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.lit(row[c])) for c in names], matches)


def update_first(df: DataFrame, filter: dict | None, update: dict, order: list[tuple[str, int]], array_filters: list | None = None, compat: CompatProfile = DEFAULT, now: datetime | None = None) -> DataFrame:
    """The whole table after an update of the first match by ``order``."""
    return update_rows(df, filter, update, array_filters, compat, now, first_match(df, filter, order, compat))


def find_and_update(df: DataFrame, filter: dict | None, update: dict, order: list[tuple[str, int]], return_new: bool = False, array_filters: list | None = None, compat: CompatProfile = DEFAULT, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """The first match by ``order``, before or after its update, and the whole table after it."""
    one = first_match(df, filter, order, compat)
    table = update_rows(df, filter, update, array_filters, compat, now, one)
    if not return_new:
        return df.where(one), table
    return update_rows(df.where(one), None if filter is None or not any("$" in str(p).split(".") for p in _paths(update)) else filter, update, array_filters, compat, now), table


def _paths(update: dict) -> list[str]:
    return [p for changes in update.values() if isinstance(changes, dict) for p in changes]


def upsert_rows(df: DataFrame, filter: dict, update: dict, order: list[tuple[str, int]] | None = None, array_filters: list | None = None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """The table after an update of all matches (with ``order``, of the first), or with a new row if there are none.

    The new row has the equalities of the filter and what the update sets;
    columns that neither names are null, names that aren't columns are lost.
    """
    kept = {op: changes for op, changes in update.items() if op != "$setOnInsert"}
    if find(df, filter, limit=1, compat=compat).first() is not None:
        if not kept:
            return df
        return update_rows(df, filter, kept, array_filters, compat) if order is None else update_first(df, filter, kept, order, array_filters, compat)
    seed = Updater(Update(update, array_filters, compat)).apply(equalities(filter), {}, inserting=True)
    return df.unionByName(df.sparkSession.createDataFrame([tuple(seed.get(f.name) for f in df.schema.fields)], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])))


def delete_rows(df: DataFrame, filter: dict | None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """The rows that don't match, nulls kept."""
    return df.where(Typed(df.schema, compat).filter(filter).neg) if filter else df.where("false")


def delete_first(df: DataFrame, filter: dict | None, order: list[tuple[str, int]], compat: CompatProfile = DEFAULT) -> DataFrame:
    """All rows but the first match by ``order``."""
    return df.where(~first_match(df, filter, order, compat))


def replace_rows(df: DataFrame, filter: dict, replacement: dict, key: str, order: list[tuple[str, int]] | None = None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """The table in which the first match has all columns but ``key`` from ``replacement``, null where it has none.

    First by ``order``, by default that of ``key``.
    """
    matches = first_match(df, filter, order or [(key, 1)], compat)
    out = []
    for f in df.schema.fields:
        own = F.col(f"`{f.name}`")
        out.append(own if f.name == key else F.when(matches, _typed_value(replacement.get(f.name), f.dataType)[0]).otherwise(own).alias(f.name))
    return df.select(*out)


def insert_rows(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with those rows of ``new`` whose key neither it nor an earlier row has.

    Of rows with one key the least in all columns is taken.
    """
    fresh = new.join(df.select(key), key, "left_anti")
    others = [c for c in df.columns if c != key]
    first = fresh.groupBy(key).agg(F.min(F.struct(*others)).alias("__row")).select(key, "__row.*")
    return df.unionByName(first)
