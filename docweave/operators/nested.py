"""Deeply nested JSON documents as related flat tables.

A first pass finds the shapes: for each kind of object that is an element of
an array, the steps that lead to it and its scalar fields. From each shape a
projection is generated: nested ``transform`` calls over VARIANT arrays
attach the path and the position of every ancestor, ``flatten`` joins the
levels and one ``inline`` per target table emits the rows. The list of all
links is one tree of such projections with one ``inline``.

Expressions reach ``DEPTH`` levels down. What lies deeper, and documents that
VARIANT can't hold, are read by a walker in Arrow batches; the first pass
tells whether there are any.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.canonical import json_reader, printable

#: Levels of nesting that the expressions reach; objects below come from the walker.
DEPTH = 12
#: Step into the elements of an array; no JSON name looks like it, since steps are told apart by kind.
_ELEMENT = "e"
_SEP, _KEY = "\x1f", "k"


class Shape(NamedTuple):
    """``steps`` from the root to a kind of object; empty for the root itself.

    ``kind`` is the value of the column that tells kinds of documents apart.
    """

    steps: tuple[str, ...]
    fields: tuple[str, ...]
    kind: str | None = None

    @property
    def name(self) -> str:
        return ".".join("[]" if s == _ELEMENT else s[1:] for s in self.steps)


def _stands_for_value(node: dict) -> bool:
    return next(iter(node), "")[:1] == "$"


def _has_late_dollar(node: dict) -> bool:
    """Whether a ``$`` key follows other keys, or other keys follow one."""
    return len(node) > 1 and len({k[:1] == "$" for k in node}) > 1


class Catalogue(NamedTuple):
    """What ``find_shapes`` found in all documents.

    ``guard``: some object has ``$`` keys beside others; ``odd``: some
    document repeats a name in an object, is deep or isn't JSON;
    ``deep``: something lies below ``DEPTH``; ``whole``: the shapes are
    complete, else they are too many to be projected.
    """

    shapes: list[Shape]
    guard: bool = True
    odd: bool = True
    deep: bool = True
    whole: bool = True


class _Reader:
    """JSON text to dicts and lists; the last value of a repeated name counts."""

    def __init__(self):
        self.repeats = self.broken = False
        self._read = json_reader(object_pairs_hook=self._object, parse_constant=self._constant)

    def _object(self, pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            self.repeats = True
        return out

    @staticmethod
    def _constant(text: str):
        raise ValueError(f"{text} is not JSON")

    def read(self, text: str):
        """The value; None for text that isn't JSON."""
        try:
            return self._read(text)
        except ValueError:
            self.broken = True
            return None


def shapes_of(value, found: dict[tuple[str, ...], set[str]]) -> tuple[bool, bool]:
    """Add the element objects in ``value`` and their leaf fields to ``found``, down to ``DEPTH``.

    Returns whether an object has ``$`` keys beside others, which the
    projection then has to guard against, and whether containers lie deeper.
    """
    mixed = deep = False
    stack = [(value, (), ())]
    while stack:
        node, steps, owner = stack.pop()
        if len(steps) > DEPTH:
            deep = True
        elif type(node) is list:
            inner = (*steps, _ELEMENT)
            for x in node:
                if type(x) is dict:
                    if _stands_for_value(x):
                        mixed |= _has_late_dollar(x)
                    elif len(inner) > DEPTH:
                        deep = True
                    else:
                        found.setdefault(inner, set())
                        stack.append((x, inner, inner))
                elif type(x) is list:
                    stack.append((x, inner, owner))
        elif type(node) is dict:
            mixed |= _has_late_dollar(node)
            own = found.setdefault(owner, set()) if steps == owner else None
            for k, x in node.items():
                kind = type(x)
                if kind is dict and _stands_for_value(x):
                    mixed |= _has_late_dollar(x)
                elif kind is list or kind is dict:
                    if x:
                        stack.append((x, (*steps, _KEY + k), owner))
                    continue
                if own is not None:
                    own.add(k)
    return mixed, deep


def _scan(fields: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str | None, dict[tuple[str, ...], set[str]]] = {}
        reader = _Reader()
        mixed = deep = False
        for batch in batches:
            for kind, text in zip(batch["kind"], batch["v"]):
                value = None if text is None else reader.read(text)
                if type(value) is list or (type(value) is dict and not _stands_for_value(value)):
                    late, below = shapes_of(value, by.setdefault(kind, {}))
                    mixed |= late
                    deep |= below
        rows = []
        for kind, found in by.items():
            for steps, names in found.items():
                name = _SEP.join(printable(s) for s in steps)
                rows.append((kind, name, None))
                if fields:
                    rows += [(kind, name, printable(f)) for f in names]
        marks = {"guard": mixed, "odd": reader.repeats or reader.broken or deep, "deep": deep}
        rows += [(None, None, m) for m, held in marks.items() if held]
        yield pd.DataFrame(rows, columns=["kind", "steps", "field"])

    return run


def find_shapes(df: DataFrame, value: str = "v", kind: str | None = None, limit: int = 100_000, fields: bool = True) -> Catalogue:
    """All shapes in all documents.

    Every task sends each (kind, shape, field) once; the result is as large
    as the schema, not as the data. If there are more than ``limit`` of them
    names are data; the catalogue then says that it isn't whole.
    """
    kinds = F.col(kind).cast("string") if kind else F.lit(None).cast("string")
    picked = df.select(kinds.alias("kind"), F.col(value).cast("string").alias("v")).where("v IS NOT NULL")
    found = picked.mapInPandas(_scan(fields), "kind string, steps string, field string").distinct()
    rows = found.limit(limit + 1).collect()
    if len(rows) > limit:
        return Catalogue([], whole=False)
    marks = {r.field for r in rows if r.steps is None}
    by: dict[tuple[str | None, str], set[str]] = {}
    for r in rows:
        if r.steps is not None:
            by.setdefault((r.kind, r.steps), set()).update([r.field] if r.field is not None else [])
    shapes = [Shape(tuple(s.split(_SEP)) if s else (), tuple(sorted(f)), k) for (k, s), f in sorted(by.items(), key=lambda x: (x[0][0] or "", x[0][1]))]
    return Catalogue(shapes, "guard" in marks, "odd" in marks, "deep" in marks)


def merged(shapes: list[Shape]) -> list[Shape]:
    """The shapes of all kinds of documents together."""
    by: dict[tuple[str, ...], set[str]] = {}
    for s in shapes:
        by.setdefault(s.steps, set()).update(s.fields)
    return [Shape(steps, tuple(sorted(f))) for steps, f in sorted(by.items())]


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _member(node: str, key: str) -> str:
    """SQL for the member ``key`` of a VARIANT object, null on anything else."""
    if "'" not in key and "\\" not in key:
        return f"try_variant_get({node}, {_lit(f'$[{chr(39)}{key}{chr(39)}]')}, 'variant')"
    if '"' not in key and "\\" not in key:
        path = f'$["{key}"]'
        return f"try_variant_get({node}, {_lit(path)}, 'variant')"
    return f"try_element_at(try_variant_get({node}, '$', 'map<string,variant>'), {_lit(key)})"


def _is_object(node: str) -> str:
    fields = f"try_variant_get({node}, '$', 'map<string,variant>')"
    return f"(NOT coalesce(exists(map_keys({fields}), k -> startswith(k, '$')), true))"


def _items(node: str, keys: list[str]) -> str:
    """SQL for the array at ``keys`` below ``node``, null if there is none."""
    while keys and any(c in keys[0] for c in "'\\"):
        node, keys = _member(node, keys[0]), keys[1:]
    for at, key in enumerate(keys):
        if any(c in key for c in "'\\"):
            return _items(_items(node, keys[:at]).replace("'array<variant>'", "'variant'"), keys[at:])
    path = "$" + "".join(f"['{k}']" for k in keys)
    return f"try_variant_get({node}, {_lit(path)}, 'array<variant>')"


def _stored(key: str) -> str:
    """The name under which VARIANT holds ``key``: ``$`` keys of plain objects are renamed."""
    return "~" + key if key[:1] == "$" else key


_LEVEL = "array<struct<__path:string,__parent:string,__pos:array<int>,__e:variant>>"
_LINKS = "array<struct<parent_path:string,child_path:string>>"


def links_sql(shapes: Iterable[Shape], root: str = "__doc", guard: bool = False) -> str:
    """SQL for the array of ``(parent_path, child_path)`` of all shapes.

    The shapes form a tree, so that an array which several of them pass is
    read once and the branches of a missing one cost nothing.
    """
    tree: dict = {}
    for s in shapes:
        node = tree
        for step in s.steps:
            node = node.setdefault(step, {})
        node[""] = True

    def joined(parts: list[str]) -> str:
        none = f"CAST(array() AS {_LINKS})"
        parts = [p if p.startswith("array(") else f"coalesce({p}, {none})" for p in parts]
        return none if not parts else parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    def fields_of(var: str) -> str:
        return f"try_variant_get({var}, '$', 'map<string,variant>')"

    def bound(fields: str, depth: int, body: str) -> str:
        """``body`` over the fields of an object, which are read once."""
        return f"flatten(transform(array({fields}), m{depth} -> {body}))"

    def branches(node: dict, fields: str, path: str, parent: str, depth: int) -> list[str]:
        """The arrays below an object whose fields are the map ``fields``."""
        out = []
        for step, inner in node.items():
            if step and step != _ELEMENT:
                out += below(inner, f"try_element_at({fields}, {_lit(_stored(step[1:]))})", [step[1:]], path, parent, depth)
        return out

    def below(node: dict, var: str, keys: list[str], path: str, parent: str, depth: int) -> list[str]:
        out = []
        if _ELEMENT in node:
            out.append(elements(node[_ELEMENT], f"try_variant_get({var}, '$', 'array<variant>')", keys, path, parent, depth))
        for step, inner in node.items():
            if step and step != _ELEMENT:
                out += below(inner, _member(var, _stored(step[1:])), [*keys, step[1:]], path, parent, depth)
        return out

    def elements(node: dict, items: str, keys: list[str], path: str, parent: str, depth: int) -> str:
        e, i = f"e{depth}", f"i{depth}"
        where = [x for x in (path, _lit(".".join(keys)) if keys else "") if x]
        here = f"concat_ws('.', {', '.join([*where, i])})"
        in_object = {k: v for k, v in node.items() if k not in ("", _ELEMENT)}
        in_array = {k: v for k, v in node.items() if k == _ELEMENT}
        link = f"named_struct('parent_path', {parent}, 'child_path', {here})"
        if "" in node and not in_object and not in_array:
            return f"filter(transform({items}, ({e}, {i}) -> CASE WHEN {_is_object(e)} THEN {link} END), y -> y IS NOT NULL)"
        nested = below(in_array, e, [], here, parent, depth + 1)
        inside = branches(in_object, f"m{depth}", here, here, depth + 1)
        own = [f"array({link})"] if "" in node else []
        is_object = f"NOT coalesce(exists(map_keys(m{depth}), k -> startswith(k, '$')), true)"
        if own or inside:
            body = bound(fields_of(e), depth, f"CASE WHEN {is_object} THEN {joined([*own, *inside])} ELSE {joined(nested)} END")
        else:
            body = joined(nested)
        return f"flatten(transform({items}, ({e}, {i}) -> {body}))"

    parts = branches(tree, "m", "", _lit(""), 0)
    root_array = below({_ELEMENT: tree[_ELEMENT]}, root, [], "", _lit(""), 0) if _ELEMENT in tree else []
    is_object = "NOT coalesce(exists(map_keys(m), k -> startswith(k, '$')), true)" if guard else "m IS NOT NULL"
    body = f"flatten(transform(array({fields_of(root)}), m -> CASE WHEN {is_object} THEN {joined(parts)} ELSE {joined(root_array)} END))"
    return body


def projection_sql(shape: Shape, root: str = "__doc", guard: bool = False) -> str:
    """SQL for the array of ``(__path, __parent, __pos, __e)`` of a shape in one document."""

    def build(node: str, at: int, path: str, parent: str, pos: str, depth: int) -> str:
        names = []
        while shape.steps[at] != _ELEMENT:
            names.append(shape.steps[at][1:])
            at += 1
        prefix = ".".join(names)
        where = [x for x in (path, _lit(prefix) if prefix else "") if x]
        e, i = f"e{depth}", f"i{depth}"
        here = f"concat_ws('.', {', '.join([*where, i])})"
        here_pos = f"concat({pos}, array({i}))"
        items = _items(node, [_stored(n) for n in names])
        if at == len(shape.steps) - 1:
            rows = f"transform({items}, ({e}, {i}) -> named_struct('__path', {here}, '__parent', {parent}, '__pos', {here_pos}, '__e', {e}))"
            return f"filter({rows}, x -> {_is_object('x.__e')})"
        into_object = shape.steps[at + 1] != _ELEMENT
        inner = build(e, at + 1, here, here if into_object else parent, here_pos, depth + 1)
        if guard and into_object:
            inner = f"CASE WHEN {_is_object(e)} THEN {inner} END"
        return f"flatten(filter(transform({items}, ({e}, {i}) -> {inner}), y -> y IS NOT NULL))"

    return f"coalesce({build(root, 0, '', _lit(''), 'array()', 0)}, CAST(array() AS {_LEVEL}))"


def _variant(value: str, guard: bool) -> Column:
    """The document as VARIANT, null where VARIANT can't hold it.

    VARIANT orders the keys of an object; where some object has ``$`` keys
    beside others (``guard``), those that aren't the first are renamed
    before, so that a ``$`` key still tells a value object.
    """
    text = F.col(value).cast("string")
    if guard:
        text = F.regexp_replace(text, r',(\s*)"\$', r',$1"~\$')
    return F.try_parse_json(text)


def _pruned(value):
    """``value`` without the containers below ``DEPTH``."""
    root: list = [None]
    stack = [(value, root, 0, 0)]
    while stack:
        node, into, at, depth = stack.pop()
        if type(node) is dict or type(node) is list:
            if depth > DEPTH:
                node = None
            elif type(node) is dict:
                copy: dict | list = dict.fromkeys(node)
                stack += [(x, copy, k, depth + 1) for k, x in node.items()]
                node = copy
            else:
                copy = [None] * len(node)
                stack += [(x, copy, k, depth + 1) for k, x in enumerate(node)]
                node = copy
        into[at] = node
    return root[0]


def _mended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = _Reader()
    for batch in batches:
        texts = []
        for text in batch["__text"]:
            value = reader.read(text)
            texts.append(json.dumps(_pruned(value)) if type(value) in (dict, list) else None)
        batch["__text"] = texts
        yield batch


def with_variant(df: DataFrame, keep: list[str], value: str = "v", guard: bool = True, odd: bool = False) -> DataFrame:
    """``keep`` columns and ``__doc``, the document as VARIANT.

    With ``odd``, documents that VARIANT can't hold are mended: the last
    value of a repeated name counts, what lies below ``DEPTH`` is left out.
    Text after a whole JSON value, which the parser doesn't look at, then
    makes it no JSON.
    """
    rows = df.select(*keep, F.col(value).cast("string").alias("__text"))
    parsed = rows.withColumn("__doc", _variant("__text", guard))
    if not odd:
        return parsed.select(*keep, "__doc")
    whole = F.try_parse_json(F.concat(F.lit("["), "__text", F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"d":'), "__text", F.lit("}"))).isNotNull()
    parsed = parsed.withColumn("__doc", F.when(whole, F.col("__doc")))
    mended = parsed.where("__doc IS NULL AND __text IS NOT NULL").drop("__doc").mapInPandas(_mended, rows.schema)
    return parsed.where("__doc IS NOT NULL").select(*keep, "__doc").unionByName(mended.select(*keep, _variant("__text", guard).alias("__doc")))


def _walk(value, least: int) -> Iterator[tuple[str, str]]:
    """(parent_path, child_path) of the element objects at ``least`` levels and more."""

    def path(link) -> str:
        parts = []
        while link is not None:
            link, part = link
            parts.append(part)
        return ".".join(reversed(parts))

    stack = [(value, None, None, 0, False)]
    while stack:
        node, link, parent, depth, element = stack.pop()
        if type(node) is dict:
            if _stands_for_value(node):
                continue
            if element:
                if depth >= least:
                    yield path(parent), path(link)
                parent = link
            stack += [(x, (link, k), parent, depth + 1, False) for k, x in node.items() if type(x) in (dict, list)]
        elif type(node) is list:
            stack += [(x, (link, str(i)), parent, depth + 1, True) for i, x in enumerate(node) if type(x) in (dict, list)]


def walked_rows(df: DataFrame, keep: list[str], value: str = "v", least: int = 0) -> DataFrame:
    """``keep, parent_path, child_path`` of the objects at ``least`` levels and more, read by the walker."""
    picked = df.select(*keep, F.col(value).cast("string").alias("__text")).where("__text IS NOT NULL")
    if least:  # that deep takes so many brackets
        picked = picked.where(F.length("__text") - F.length(F.translate("__text", "[{", "")) >= least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader()
        for batch in batches:
            at, links = [], []
            for n, text in enumerate(batch["__text"]):
                value = reader.read(text)
                own = [(printable(a), printable(b)) for a, b in _walk(value, least)] if type(value) in (dict, list) else []
                at += [n] * len(own)
                links += own
            rows = batch.drop(columns="__text").iloc[at].reset_index(drop=True)
            yield rows.assign(__parent=pd.Series([a for a, _ in links], dtype=object), __child=pd.Series([b for _, b in links], dtype=object))

    ddl = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)
    rows = picked.mapInPandas(run, f"{ddl}__parent string, __child string")
    return rows.select(*keep, F.col("__parent").alias("parent_path"), F.col("__child").alias("child_path"))


def element_rows(df: DataFrame, keep: list[str], value: str = "v", kind: str | None = None, known: Catalogue | None = None) -> DataFrame:
    """``keep, parent_path, child_path``: each object that is an array element.

    ``kind`` may name a column whose values have shapes of their own; it
    only saves work. ``known`` may be what ``find_shapes`` gave for these
    documents, to save that pass. Paths are dotted with 0-based positions;
    ``parent_path`` is the nearest enclosing element, empty if there is
    none. Null documents and text that isn't JSON (listed by ``unreadable``)
    have no rows; where an object repeats a name the last value counts, at
    any depth; an object whose first key starts with ``$`` is a value;
    strings are leaves whatever they hold; scalars and nulls in an array
    keep their position. Documents without arrays of objects have no rows;
    an empty table gives an empty result.
    """
    catalogue = known or find_shapes(df, value, kind, fields=False)
    if not catalogue.whole:
        return walked_rows(df, keep, value)
    targets: dict[str | None, list[Shape]] = {}
    for s in catalogue.shapes:
        if s.steps:
            targets.setdefault(s.kind, []).append(s)
    if not targets:
        rows = df.where("false").select(*keep, F.lit("").alias("parent_path"), F.lit("").alias("child_path"))
    elif kind is None or len(targets) == 1:
        sql = links_sql(merged([s for own in targets.values() for s in own]), guard=catalogue.guard)
        rows = with_variant(df, keep, value, catalogue.guard, catalogue.odd).select(*keep, F.inline(F.expr(sql)))
    else:
        alike: dict[str, list[str | None]] = {}  # kinds of the same shapes share a branch
        for k, own in targets.items():
            alike.setdefault(links_sql(own, guard=catalogue.guard), []).append(k)
        cases = [f"WHEN {' OR '.join('__kind IS NULL' if k is None else f'__kind = {_lit(k)}' for k in kinds)} THEN {sql}" for sql, kinds in alike.items()]
        sql = f"CASE {' '.join(cases)} ELSE CAST(array() AS {_LINKS}) END"
        parsed = with_variant(df.withColumn("__kind", F.col(kind).cast("string")), [*keep, "__kind"], value, catalogue.guard, catalogue.odd)
        rows = parsed.select(*keep, F.inline(F.expr(sql)))
    return rows.unionByName(walked_rows(df, keep, value, DEPTH + 1)) if catalogue.deep else rows


def _leaf(field: str) -> Column:
    node = _member("__e", _stored(field))
    text = F.expr(f"coalesce(try_variant_get({node}, '$', 'string'), to_json({node}))")
    return F.when(F.expr(f"is_variant_null({node})"), None).otherwise(text)


def _column_names(fields: Iterable[str]) -> list[str]:
    """Names that stay distinct when letter case doesn't count."""
    seen: dict[str, int] = {}
    out = []
    for f in fields:
        n = seen[f.lower()] = seen.get(f.lower(), 0) + 1
        out.append(f if n == 1 else f"{f}#{n}")
    return out


def flat_tables(df: DataFrame, keep: list[str], value: str = "v", known: Catalogue | None = None) -> dict[str, DataFrame]:
    """One flat table per shape, by its name (the root's is empty).

    Each is a projection of its own with one ``inline``; nothing is read for
    tables that aren't used.

    Columns: ``keep``, ``parent_path``, ``child_path``, ``positions`` (of all
    ancestors), then ``f:`` and the name for each scalar field as text,
    wrapped values as JSON, null where null or missing. Objects more than
    ``DEPTH`` levels down have no table of their own (``element_rows`` lists
    them). More shapes than ``find_shapes`` takes raise an error: names are
    then data and belong into rows first.
    """
    catalogue = known or find_shapes(df, value)
    if not catalogue.whole:
        raise ValueError("the documents have too many shapes for a table each")
    guard = catalogue.guard
    parsed = with_variant(df, keep, value, guard, catalogue.odd)
    tables = {}
    for s in merged(catalogue.shapes):
        names = _column_names(s.fields)
        leaves = [_leaf(f).alias(f"f:{n}") for f, n in zip(s.fields, names)]
        if s.steps:
            rows = parsed.select(*keep, F.inline(F.expr(projection_sql(s, guard=guard))))
            tables[s.name] = rows.select(*keep, F.col("__parent").alias("parent_path"), F.col("__path").alias("child_path"), F.col("__pos").alias("positions"), *leaves)
        else:
            rows = parsed.where("__doc IS NOT NULL").withColumnRenamed("__doc", "__e")
            empty = F.lit("")
            tables[""] = rows.select(*keep, empty.alias("parent_path"), empty.alias("child_path"), F.array().cast("array<int>").alias("positions"), *leaves)
    return tables


def flat_table(df: DataFrame, keep: list[str], name: str, fields: list[str], value: str = "v") -> DataFrame:
    """``keep, parent_path, child_path`` and some fields of one flat table.

    The schema doesn't depend on the data: a field that the table hasn't is
    null, a table that there isn't is empty.
    """
    rows = flat_tables(df, keep, value).get(name)
    if rows is None:
        rows = df.where("false").select(*keep, F.lit("").alias("parent_path"), F.lit("").alias("child_path"))
    own = {c[2:]: F.col(f"`{c}`") for c in rows.columns if c.startswith("f:")}
    return rows.select(*keep, "parent_path", "child_path", *[own.get(f, F.lit(None)).cast("string").alias(f) for f in fields])


def unreadable(df: DataFrame, keep: list[str], value: str = "v") -> DataFrame:
    """``keep`` of the rows whose text isn't JSON."""
    rows = df.select(*keep, F.col(value).cast("string").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader()
        for batch in batches:
            # a null value is JSON too
            yield batch[[reader.read(t) is None and t.strip() != "null" for t in batch["__text"]]]

    return rows.where(F.col("__text").isNotNull() & F.try_parse_json("__text").isNull()).mapInPandas(run, rows.schema).select(*keep)
