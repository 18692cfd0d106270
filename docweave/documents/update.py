"""Updates as functions of one document."""

from __future__ import annotations

import copy
from collections.abc import Callable
from datetime import datetime, timezone
from decimal import Decimal

from docweave.compat import DEFAULT, CompatProfile
from docweave.documents.match import compile_filter
from docweave.documents.walk import MISSING
from docweave.errors import OperationFailure, WriteError
from docweave.functions.bsontypes import Decimal128, Int64, Timestamp
from docweave.functions.order import same, sort_key
from docweave.plans import spec as S

#: The update operators.
_OPERATORS = (
    "$inc", "$mul", "$min", "$max", "$set", "$setOnInsert", "$unset", "$rename", "$currentDate", "$addToSet", "$pop", "$pull", "$pullAll", "$push",
)


class Update:
    """A checked update document; both engines read it.

    ``changes`` lists (path, operator, argument) in order of path.
    """

    def __init__(self, spec, array_filters=None, compat: CompatProfile = DEFAULT, now: datetime | None = None):
        if not isinstance(spec, dict):
            raise TypeError("an update is a dict")
        if not spec or next(iter(spec))[:1] != "$":
            raise ValueError("update only works with $ operators")
        self.now = now or datetime.now(timezone.utc)
        self.compat = compat
        self.filters = _array_filters(array_filters, compat)
        changes: dict[str, tuple[str, object]] = {}
        for op, fields in spec.items():
            if op not in _OPERATORS:
                raise WriteError(f"unknown modifier: {op}", 9)
            if not isinstance(fields, dict):
                raise WriteError(f"modifiers operate on fields but {op} has {fields!r}", 9)
            for path, arg in fields.items():
                _check_path(path)
                if path in changes:
                    raise WriteError(f"updating the path {path!r} would create a conflict", 40)
                changes[path] = (op, _checked(op, path, arg))
        self.changes = [(p, *changes[p]) for p in sorted(changes)]
        targets = sorted([*changes, *(arg for op, arg in changes.values() if op == "$rename")])
        for a, b in zip(targets, targets[1:]):
            if a == b or b.startswith(a + "."):
                raise WriteError(f"updating the path {b!r} would create a conflict at {a!r}", 40)
        used = {step[2:-1] for p in changes for step in p.split(".") if step[:2] == "$[" and step != "$[]"}
        for name in used - self.filters.keys():
            raise WriteError(f"no array filter found for identifier {name!r}", 2)
        for name in self.filters.keys() - used:
            raise OperationFailure(f"the array filter for identifier {name!r} was not used", 9)
        self.touches_id = any(p == "_id" or p.startswith("_id.") for p in targets)


def _check_path(path: str) -> None:
    if not path or path.startswith(".") or path.endswith(".") or ".." in path:
        raise WriteError(f"the update path {path!r} contains an empty field name", 56)
    for n, step in enumerate(path.split(".")):
        if step[:1] == "$" and not (step == "$" or (step[:2] == "$[" and step[-1:] == "]")):
            raise WriteError(f"the field {step!r} in {path!r} is not valid for storage", 52)
        if n == 0 and step[:1] == "$":
            raise WriteError(f"cannot have a positional operator at the start of a path: {path!r}", 2)
    if path.split(".").count("$") > 1:
        raise WriteError(f"too many positional elements in {path!r}", 2)


def _array_filters(specs, compat: CompatProfile) -> dict[str, Callable]:
    if specs is None:
        return {}
    if not isinstance(specs, (list, tuple)):
        raise TypeError("array_filters is a list")
    out: dict[str, Callable] = {}
    for spec in specs:
        if not isinstance(spec, dict):
            raise TypeError("each array filter is a dict")
        tree = S.parse_filter(spec, compat)
        names = {p.split(".")[0] for p in S.paths_of(tree)}
        if not names:
            raise OperationFailure("cannot use an expression without a top-level field name in array_filters", 9)
        if len(names) > 1:
            raise OperationFailure("an array filter has to have one top-level field name", 9)
        name = names.pop()
        if not (name[:1].islower() and name.isalnum()):
            raise OperationFailure(f"the identifier {name!r} has to start with a lower-case letter", 2)
        if name in out:
            raise OperationFailure(f"multiple array filters with the same top-level field name {name!r}", 9)
        holds = compile_filter(tree, compat)
        out[name] = lambda x, holds=holds, name=name: holds({name: x}, {})
    return out


def _is_number(x) -> bool:
    return isinstance(x, (int, float, Decimal128)) and not isinstance(x, bool)


def _checked(op: str, path: str, arg):
    if op in ("$inc", "$mul"):
        if not _is_number(arg):
            raise WriteError(f"cannot use {op} with a non-numeric argument", 14)
    elif op == "$rename":
        if not isinstance(arg, str):
            raise WriteError("the 'to' field of $rename has to be a string", 2)
        _check_path(arg)
        if arg == path:
            raise WriteError("the source and target field for $rename must differ", 2)
        if any(s[:1] == "$" for s in (*path.split("."), *arg.split("."))):
            raise WriteError("$rename may not be positional", 2)
    elif op == "$pop":
        if isinstance(arg, bool) or not isinstance(arg, (int, float)):
            raise WriteError("expected a number in $pop", 9)
        if arg not in (1, -1):
            raise WriteError("$pop expects 1 or -1", 9)
    elif op == "$pullAll":
        if not isinstance(arg, (list, tuple)):
            raise WriteError("$pullAll requires an array argument", 2)
    elif op == "$currentDate":
        if isinstance(arg, dict):
            if set(arg) != {"$type"} or arg["$type"] not in ("date", "timestamp"):
                raise WriteError("the '$type' of $currentDate is 'date' or 'timestamp'", 2)
        elif not isinstance(arg, bool):
            raise WriteError("$currentDate takes a bool or {'$type': ...}", 2)
    elif op == "$addToSet":
        if S.is_expression(arg):
            if next(iter(arg)) != "$each" or len(arg) > 1:
                raise WriteError("$addToSet takes only $each", 2)
            if not isinstance(arg["$each"], (list, tuple)):
                raise WriteError("the argument to $each must be an array", 14)
    elif op == "$push" and S.is_expression(arg):
        _check_push(arg)
    return arg


def _check_push(arg: dict) -> None:
    unknown = set(arg) - {"$each", "$slice", "$sort", "$position"}
    if unknown or "$each" not in arg:
        raise WriteError(f"unrecognized clause in $push: {sorted(unknown) or 'no $each'}", 2)
    if not isinstance(arg["$each"], (list, tuple)):
        raise WriteError("the argument to $each in $push must be an array", 2)
    for name in ("$slice", "$position"):
        if name in arg and (isinstance(arg[name], bool) or not isinstance(arg[name], (int, float)) or arg[name] != int(arg[name])):
            raise WriteError(f"the value for {name} must be a whole number", 2)
    if "$sort" in arg:
        by = arg["$sort"]
        orders = list(by.values()) if isinstance(by, dict) else [by]
        if not orders or any(isinstance(o, bool) or o not in (1, -1) for o in orders):
            raise WriteError("the $sort is 1 or -1, or names fields with them", 2)


class _Gone(Exception):
    """The path doesn't lead on; nothing is changed."""


class Updater:
    """Applies an update to documents.

    ``apply`` returns a changed copy, or the document itself if the update
    doesn't change it.
    """

    def __init__(self, update: Update):
        self.update = update

    def apply(self, doc: dict, hit: dict, inserting: bool = False) -> dict:
        new = copy.deepcopy(doc)
        touched: set[tuple] = set()
        changed = False
        for path, op, arg in self.update.changes:
            if op == "$setOnInsert" and not inserting:
                continue
            changed |= self._change(new, path, op, arg, hit, touched)
        return new if changed else doc

    # -- places --------------------------------------------------------

    def _change(self, doc: dict, path: str, op: str, arg, hit: dict, touched: set) -> bool:
        if op == "$rename":
            return self._rename(doc, path, arg)
        steps = path.split(".")
        if "$" in steps:
            index = next((i for p, i in hit.items() if p.split(".")[0] == steps[0]), next(iter(hit.values()), None))
            if index is None:
                raise WriteError("the positional operator did not find the match needed from the query", 2)
            steps = [str(index) if s == "$" else s for s in steps]
        changed = False
        for place in self._places(doc, steps, ()):
            if any(place[: len(t)] == t or t[: len(place)] == place for t in touched):
                raise WriteError(f"updating the path {path!r} would create a conflict", 40)
            touched.add(place)
            changed |= self._write(doc, list(place), op, arg, path)
        return changed

    def _places(self, node, steps: list[str], before: tuple) -> list[tuple]:
        """The concrete paths of a path with ``$[]`` and ``$[name]``."""
        for n, step in enumerate(steps):
            if step[:2] == "$[":
                at = self._read(node, steps[:n])
                if at is MISSING:
                    raise WriteError(f"the path {'.'.join(steps[:n])!r} must exist to apply array updates", 2)
                if not isinstance(at, list):
                    raise WriteError("cannot apply array updates to a non-array element", 2)
                holds = self.update.filters.get(step[2:-1]) if step != "$[]" else None
                out = []
                for i, item in enumerate(at):
                    if holds is None or holds(item):
                        here = (*before, *steps[:n], str(i))
                        out += self._places(item, steps[n + 1 :], here) if n + 1 < len(steps) else [here]
                return out
        return [(*before, *steps)]

    @staticmethod
    def _read(node, steps):
        for s in steps:
            if isinstance(node, dict):
                node = node.get(s, MISSING)
            elif isinstance(node, list) and s.isdigit():
                node = node[int(s)] if int(s) < len(node) else MISSING
            else:
                return MISSING
        return node

    def _parent(self, doc, steps: list[str], create: bool):
        """The container of the last step; missing ones are made if ``create``."""
        node = doc
        for step in steps[:-1]:
            if isinstance(node, dict):
                if step not in node:
                    if not create:
                        raise _Gone
                    node[step] = {}
                node = node[step]
            elif isinstance(node, list):
                if not step.isdigit():
                    raise WriteError(f"cannot create field {step!r} in an array", 28)
                at = int(step)
                if at >= len(node):
                    if not create:
                        raise _Gone
                    node.extend([None] * (at - len(node)))
                    node.append({})
                node = node[at]
            else:
                if not create:
                    raise _Gone
                raise WriteError(f"cannot create field {step!r} in element {node!r}", 28)
        return node

    def _write(self, doc, steps: list[str], op: str, arg, path: str) -> bool:
        create = op not in ("$unset", "$pop", "$pull", "$pullAll")
        try:
            parent = self._parent(doc, steps, create)
        except _Gone:
            return False
        last = steps[-1]
        if isinstance(parent, list):
            if not last.isdigit():
                if not create:
                    return False
                raise WriteError(f"cannot create field {last!r} in an array", 28)
            at = int(last)
            old = parent[at] if at < len(parent) else MISSING
        elif isinstance(parent, dict):
            old = parent.get(last, MISSING)
        elif not create:
            return False
        else:
            raise WriteError(f"cannot create field {last!r} in element {parent!r}", 28)
        new = self._value(old, op, arg, path)
        if new is MISSING:
            if old is MISSING:
                return False
            if isinstance(parent, list):
                parent[at] = None
                return old is not None
            del parent[last]
            return True
        if old is not MISSING and _identical(old, new):
            return False
        if isinstance(parent, list):
            parent.extend([None] * (at + 1 - len(parent)))
            parent[at] = new
        else:
            parent[last] = new
        return True

    def _rename(self, doc: dict, path: str, target: str) -> bool:
        for steps in (path.split("."), target.split(".")):
            for n in range(1, len(steps)):
                if isinstance(self._read(doc, steps[:n]), list):
                    raise WriteError("$rename may not go through an array", 2)
        steps = path.split(".")
        value = self._read(doc, steps)
        if value is MISSING:
            return False
        self._write(doc, steps, "$unset", "", path)
        self._write(doc, target.split("."), "$set", value, target)
        return True

    # -- values --------------------------------------------------------

    def _value(self, old, op: str, arg, path: str):
        if op in ("$set", "$setOnInsert"):
            return copy.deepcopy(arg)
        if op == "$unset":
            return MISSING
        if op in ("$inc", "$mul"):
            if old is MISSING:
                if op == "$inc":
                    return arg
                return Decimal128(0) if isinstance(arg, Decimal128) else 0.0
            if not _is_number(old):
                raise WriteError(f"cannot apply {op} to a value of non-numeric type: {path}", 14)
            return _plus(old, arg) if op == "$inc" else _times(old, arg)
        if op in ("$min", "$max"):
            if old is MISSING:
                return copy.deepcopy(arg)
            smaller = sort_key(arg) < sort_key(old)
            larger = sort_key(arg) > sort_key(old)
            return copy.deepcopy(arg) if (smaller if op == "$min" else larger) else old
        if op == "$currentDate":
            if isinstance(arg, dict) and arg["$type"] == "timestamp":
                return Timestamp(int(self.update.now.timestamp()), 1)
            return self.update.now.replace(microsecond=self.update.now.microsecond // 1000 * 1000)
        if old is MISSING and op in ("$pop", "$pull", "$pullAll"):
            return MISSING
        items = [] if old is MISSING else old
        if not isinstance(items, list):
            code = {"$pop": 14, "$pull": 2, "$pullAll": 2, "$push": 2, "$addToSet": 2}[op]
            raise WriteError(f"cannot apply {op} to a non-array field: {path}", code)
        if op == "$pop":
            return items[:-1] if arg == 1 else items[1:]
        if op == "$pullAll":
            return [x for x in items if not any(same(x, y) for y in arg)]
        if op == "$pull":
            holds = self._pull_condition(arg)
            return [x for x in items if not holds(x)]
        if op == "$addToSet":
            more = arg["$each"] if S.is_expression(arg) else [arg]
            out = list(items)
            for x in more:
                if not any(same(x, y) for y in out):
                    out.append(copy.deepcopy(x))
            return out
        return self._pushed(items, arg)

    def _pull_condition(self, arg) -> Callable[[object], bool]:
        if S.is_expression(arg):
            node = compile_filter(S.All(S._operators("", arg, self.update.compat)), self.update.compat)
            return lambda x: node(x, {})
        if isinstance(arg, dict):
            node = compile_filter(S.parse_filter(arg, self.update.compat), self.update.compat)
            return lambda x: isinstance(x, dict) and node(x, {})
        node = compile_filter(S._field("", arg, self.update.compat), self.update.compat)
        return lambda x: node(x, {})

    def _pushed(self, items: list, arg) -> list:
        if not S.is_expression(arg):
            return [*items, copy.deepcopy(arg)]
        more = copy.deepcopy(list(arg["$each"]))
        at = int(arg.get("$position", len(items)))
        out = [*items[:at], *more, *items[at:]]
        if self.update.compat.slice_before_sort:
            return _sorted(_sliced(out, arg), arg)
        return _sliced(_sorted(out, arg), arg)


def _sliced(items: list, arg: dict) -> list:
    if "$slice" not in arg:
        return items
    n = int(arg["$slice"])
    return items[:n] if n >= 0 else items[n:]


def _sorted(items: list, arg: dict) -> list:
    if "$sort" not in arg:
        return items
    by = arg["$sort"]
    if not isinstance(by, dict):
        return sorted(items, key=sort_key, reverse=by == -1)
    docs = [x for x in items if isinstance(x, dict)]
    rest = [x for x in items if not isinstance(x, dict)]
    for path, order in reversed(by.items()):
        docs.sort(key=lambda d, p=path.split("."): sort_key(None if (v := Updater._read(d, p)) is MISSING else v), reverse=order == -1)
    # what is no document sorts as if it had none of the fields
    return [*rest, *docs] if next(iter(by.values())) == 1 else [*docs, *rest]


def _identical(a, b) -> bool:
    return type(a) is type(b) and same(a, b) if not isinstance(a, (dict, list)) else _same_deep(a, b)


def _same_deep(a, b) -> bool:
    if isinstance(a, dict):
        return isinstance(b, dict) and list(a) == list(b) and all(_identical(x, b[k]) for k, x in a.items())
    return isinstance(b, list) and len(a) == len(b) and all(map(_identical, a, b))


def _numeric(a, b, combine):
    if isinstance(a, Decimal128) or isinstance(b, Decimal128):
        x, y = (v.value if isinstance(v, Decimal128) else Decimal(str(v)) for v in (a, b))
        return Decimal128(combine(x, y))
    out = combine(a, b)
    if isinstance(out, int) and (isinstance(a, Int64) or isinstance(b, Int64)):
        return Int64(out)
    return out


def _plus(a, b):
    return _numeric(a, b, lambda x, y: x + y)


def _times(a, b):
    return _numeric(a, b, lambda x, y: x * y)
