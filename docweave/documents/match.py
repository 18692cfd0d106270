"""Filters as functions of one document."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from docweave.compat import DEFAULT, CompatProfile
from docweave.documents.walk import Found, arrays, exists, is_null, values, walk
from docweave.functions.bsontypes import Decimal128, MaxKey, MinKey, Regex, type_id
from docweave.functions.order import is_nan, sort_key, weight
from docweave.plans import spec as S

#: Says whether a document matches; ``hit`` gets the array position that did, by path.
Matcher = Callable[[object, dict], bool]


def compile_filter(tree: S.Node, compat: CompatProfile = DEFAULT) -> Matcher:
    if isinstance(tree, S.All):
        parts = [compile_filter(p, compat) for p in tree.parts]
        return lambda doc, hit: all(p(doc, hit) for p in parts)
    if isinstance(tree, S.Any_):
        parts = [compile_filter(p, compat) for p in tree.parts]
        return lambda doc, hit: any(p(doc, hit) for p in parts)
    if isinstance(tree, S.Not):
        part = compile_filter(tree.part, compat)
        return lambda doc, hit: not part(doc, {})
    return _test(tree, compat)


def _test(test: S.Test, compat: CompatProfile) -> Matcher:
    path, op, arg = test.path, test.op, test.arg
    if op == "fields":
        inner = compile_filter(arg, compat)

        def fields(doc, hit):
            # numeric names in an element filter address the places of a nested array
            return isinstance(doc, (dict, list)) and inner(doc, {})

        return fields
    if op == "exists":
        return lambda doc, hit: exists(walk(doc, path))
    if op == "eq" and arg is None:
        return lambda doc, hit: is_null(walk(doc, path)) if path else doc is None
    if op in ("size", "elem", "all_elem"):
        return _array_test(path, op, arg, compat)
    if op == "all":
        tests = [_test(S.Test(path, "regex_or_equal" if isinstance(x, Regex) else "eq", x), compat) for x in arg]
        return lambda doc, hit: bool(tests) and all(t(doc, hit) for t in tests)
    if op == "in":
        plain = {sort_key(x) for x in arg if not isinstance(x, Regex)}
        patterns = [value_test("regex_or_equal", x, compat) for x in arg if isinstance(x, Regex)]
        null = any(x is None for x in arg)

        def member(doc, hit):
            nodes = walk(doc, path)
            if null and (is_null(nodes) if path else doc is None):
                return True
            return _first(nodes, path, hit, lambda v: sort_key(v) in plain or any(p(v) for p in patterns))

        return member
    holds = value_test(op, arg, compat)
    return lambda doc, hit: _first(walk(doc, path), path, hit, holds)


def _first(nodes: list[Found], path: str, hit: dict, holds: Callable) -> bool:
    for value, index in values(nodes, unpack=bool(path)):
        if holds(value):
            if index is not None:
                hit.setdefault(path, index)
            return True
    return False


def value_test(op: str, arg, compat: CompatProfile) -> Callable[[object], bool]:
    """A test of one value."""
    if op == "eq":
        key = sort_key(arg)
        return lambda v: sort_key(v) == key
    if op == "regex_equal":
        key = sort_key(arg)
        return lambda v: sort_key(v) == key
    if op in ("regex", "regex_or_equal"):
        search = arg.compiled().search
        search_bytes = re.compile(arg.pattern.encode(), arg.compiled().flags & ~re.U).search
        key = sort_key(arg)
        return lambda v: (isinstance(v, str) and search(v) is not None) or (isinstance(v, bytes) and search_bytes(v) is not None) or (isinstance(v, (Regex, re.Pattern)) and sort_key(v) == key)
    if op == "type":
        return lambda v: type_id(v) in arg
    if op == "mod":
        return _modulo(*arg)
    return _ordered(op, arg, compat)


def _modulo(divisor: int, remainder: int) -> Callable[[object], bool]:
    def holds(v) -> bool:
        if isinstance(v, Decimal128):
            v = v.value
        if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)) or v != v or v in (float("inf"), float("-inf")):
            return False
        # floor modulo of Python for all but decimals, which truncate
        return int(v % divisor) == remainder

    return holds


def _ordered(op: str, arg, compat: CompatProfile) -> Callable[[object], bool]:
    kind, key, nan = weight(arg), sort_key(arg), is_nan(arg)
    decimal_nan = nan and not isinstance(arg, float)
    compare = {"gt": lambda k: k > key, "gte": lambda k: k >= key, "lt": lambda k: k < key, "lte": lambda k: k <= key}[op]

    def holds(v) -> bool:
        if weight(v) != kind:
            extreme = isinstance(v, (MinKey, MaxKey)) or isinstance(arg, (MinKey, MaxKey))
            return extreme and compat.extremes_compare_all and compare(sort_key(v))
        if nan or is_nan(v):
            return op in ("gte", "lte") and is_nan(v) and nan and (decimal_nan or not isinstance(v, float))
        return compare(sort_key(v))

    return holds


def _array_test(path: str, op: str, arg, compat: CompatProfile) -> Matcher:
    if op == "size":
        return lambda doc, hit: any(len(a) == arg for a, _ in arrays(walk(doc, path)))
    if op == "elem":
        holds = compile_filter(arg, compat)

        def any_element(doc, hit):
            for items, index in arrays(walk(doc, path)):
                for i, item in enumerate(items):
                    if holds(item, {}):
                        hit.setdefault(path, i if index is None else index)
                        return True
            return False

        return any_element
    conditions = [compile_filter(x, compat) for x in arg]

    def every_condition(doc, hit):
        reached = [a for a, _ in arrays(walk(doc, path))]
        return bool(reached) and all(any(c(item, {}) for item in items) for items in reached for c in conditions)

    return every_condition
