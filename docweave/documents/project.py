"""Projections as functions of one document."""

from __future__ import annotations

from collections.abc import Callable

from docweave.compat import DEFAULT, CompatProfile
from docweave.documents.match import compile_filter
from docweave.documents.walk import walk
from docweave.errors import OperationFailure
from docweave.plans import spec as S


class Projection:
    """The checked form of a projection; both engines read it.

    ``fields`` is a tree of the included or excluded names. ``slices``,
    ``elements`` and ``positional`` are applied to arrays first.
    """

    def __init__(self, spec, filter_spec: dict | None = None, compat: CompatProfile = DEFAULT):
        if isinstance(spec, (list, tuple)):
            spec = {name: 1 for name in spec} or {"_id": 1}
        if not isinstance(spec, dict):
            raise TypeError("a projection is a dict or a list of names")
        self.include: bool | None = None
        self.with_id = True
        self.fields: dict = {}
        self.slices: dict[str, tuple[int | None, int]] = {}
        self.elements: dict[str, S.Node] = {}
        self.positional: str | None = None
        for path, value in spec.items():
            if isinstance(value, dict):
                self._operator(path, value, compat)
            elif path == "_id":
                self.with_id = bool(value) or isinstance(value, (str, list))
            elif path == "$" or path.startswith("$."):
                raise OperationFailure(f"bad projection: {path}", 2)
            elif path.endswith(".$"):
                self._position(path[:-2], filter_spec or {}, compat)
            elif ".$." in path:
                raise OperationFailure(f"positional projection may only end a path: {path}", 2)
            else:
                self._flag(path, bool(value) or isinstance(value, (str, list)))
        if self.include is None and "_id" in spec and not isinstance(spec["_id"], dict):
            self.include = self.with_id if not (self.slices or self.elements) else None
        if self.elements and self.include is None:
            self.include = True

    def _operator(self, path: str, value: dict, compat: CompatProfile) -> None:
        if len(value) != 1:
            raise OperationFailure(f"one operator for each field: {path}", 2)
        op, arg = next(iter(value.items()))
        if op == "$slice":
            if isinstance(arg, bool) or not isinstance(arg, (int, float, list, tuple)):
                raise OperationFailure("$slice takes a number or an array", 2)
            if isinstance(arg, (int, float)):
                self.slices[path] = (None, int(arg))
            else:
                if len(arg) != 2:
                    raise OperationFailure("$slice array wrong size", 2)
                if arg[1] <= 0:
                    raise OperationFailure("$slice limit must be positive", 2)
                self.slices[path] = (int(arg[0]), int(arg[1]))
        elif op == "$elemMatch":
            if "." in path:
                raise OperationFailure("$elemMatch can't be used on a nested field", 2)
            if not isinstance(arg, dict):
                raise OperationFailure("$elemMatch takes an object", 2)
            self.elements[path] = S._element(arg, compat)
            self.fields.setdefault(path, True)
        elif op == "$meta":
            raise NotImplementedError("$meta is not supported")
        else:
            raise OperationFailure(f"unsupported projection option: {op}", 2)

    def _flag(self, path: str, include: bool) -> None:
        if self.include is not None and self.include != include:
            raise OperationFailure("projection can't mix inclusion and exclusion", 2)
        self.include = include
        node = self.fields
        *parents, last = path.split(".")
        for step in parents:
            below = node.setdefault(step, {})
            if below is True:
                return
            node = below
        node[last] = True

    def _position(self, path: str, filter_spec: dict, compat: CompatProfile) -> None:
        if self.positional is not None:
            raise OperationFailure("only one positional projection for each query", 2)
        top = path.split(".")[0]
        if not any(p.split(".")[0] == top or p == path for p in S.paths_of(S.parse_filter(filter_spec, compat))):
            raise OperationFailure("positional projection doesn't match the query", 2)
        self.positional = path
        self._flag(path, True)


def cut(items: list, skip: int | None, limit: int) -> list:
    """``$slice``: the first or last ``limit``, or ``limit`` from ``skip`` on (from the end if negative)."""
    if skip is None:
        return items[:limit] if limit >= 0 else items[limit:]
    start = skip if skip >= 0 else max(0, len(items) + skip)
    return items[start : start + limit]


def compile_projection(projection: Projection, compat: CompatProfile = DEFAULT) -> Callable[[dict, dict], dict]:
    """A function of a document and of what its filter hit."""
    conditions = {path: compile_filter(node, compat) for path, node in projection.elements.items()}

    def run(doc: dict, hit: dict) -> dict:
        for path, (skip, limit) in projection.slices.items():
            doc = _at(doc, path.split("."), lambda x, s=skip, n=limit: cut(x, s, n) if isinstance(x, list) else x)
        for path, holds in conditions.items():
            items = doc.get(path)
            if isinstance(items, list):
                first = next((x for x in items if holds(x, {})), None)
                kept = any(holds(x, {}) for x in items)
                doc = {k: ([first] if k == path else v) for k, v in doc.items() if k != path or kept}
        if projection.positional is not None:
            doc = _positioned(doc, projection.positional, hit)
        if projection.include is None:
            out = doc
        elif projection.include:
            names = {k: v for k, v in projection.fields.items()}
            for path in projection.slices:
                names.setdefault(path.split(".")[0], True) if "." not in path else _merge(names, path)
            out = _kept(doc, names)
            if projection.with_id and "_id" in doc:
                out = {"_id": doc["_id"]} | {k: v for k, v in out.items() if k != "_id"}
            return out if projection.with_id else {k: v for k, v in out.items() if k != "_id"}
        else:
            out = _without(doc, projection.fields)
        return out if projection.with_id else {k: v for k, v in out.items() if k != "_id"}

    return run


def _merge(names: dict, path: str) -> None:
    *parents, last = path.split(".")
    for step in parents:
        below = names.setdefault(step, {})
        if below is True:
            return
        names = below
    names[last] = True


def _at(doc, steps: list[str], change: Callable):
    """A copy of ``doc`` with the values at a path changed, through arrays of documents."""
    if not steps:
        return change(doc)
    if isinstance(doc, list):
        return [_at(x, steps, change) if isinstance(x, dict) else x for x in doc]
    if not isinstance(doc, dict) or steps[0] not in doc:
        return doc
    return {k: (_at(v, steps[1:], change) if k == steps[0] else v) for k, v in doc.items()}


def _positioned(doc: dict, path: str, hit: dict) -> dict:
    index = next((i for p, i in hit.items() if p.split(".")[0] == path.split(".")[0]), next(iter(hit.values()), None))

    def one(items):
        if not isinstance(items, list):
            return items
        if index is None or index >= len(items):
            raise OperationFailure("executor error: positional operator element mismatch", 2)
        return [items[index]]

    steps = path.split(".")
    for n in range(1, len(steps) + 1):  # the first array on the path is the one that is reduced
        if any(isinstance(f.value, list) for f in walk(doc, ".".join(steps[:n]))):
            return _at(doc, steps[:n], one)
    return doc


def _kept(doc: dict, names: dict) -> dict:
    out = {}
    for k, v in doc.items():
        below = names.get(k)
        if below is True:
            out[k] = v
        elif below is not None:
            if isinstance(v, dict):
                out[k] = _kept(v, below)
            elif isinstance(v, list):
                out[k] = _kept_items(v, below)
    return out


def _kept_items(items: list, names: dict) -> list:
    """Documents are reduced, nested lists emptied likewise, scalars dropped."""
    return [_kept(x, names) if isinstance(x, dict) else _kept_items(x, names) for x in items if isinstance(x, (dict, list))]


def _without(doc: dict, names: dict) -> dict:
    out = {}
    for k, v in doc.items():
        below = names.get(k)
        if below is True:
            continue
        out[k] = _without_in(v, below) if below is not None else v
    return out


def _without_in(value, names: dict):
    if isinstance(value, dict):
        return _without(value, names)
    if isinstance(value, list):
        return [_without_in(x, names) for x in value]
    return value
