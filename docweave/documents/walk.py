"""Reading a dotted path in a document, with the fan-out over arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"


MISSING = _Missing()


class Found(NamedTuple):
    """A value (or MISSING) at a path.

    ``positioned``: the last step was an array position. ``in_array``: the
    last step led into an array. ``index``: position in the first array that
    was passed, None if none was.
    """

    value: Any
    positioned: bool = False
    in_array: bool = False
    index: int | None = None

    @property
    def counts_as_missing(self) -> bool:
        """A position beyond an array's end isn't a missing field."""
        return self.value is MISSING and not (self.in_array and self.positioned)


def walk(doc, path: str) -> list[Found]:
    """All values a path leads to; fields of array elements first, then positions."""
    nodes = [Found(doc)]
    for step in path.split(".") if path else ():
        nodes = [n for node in nodes for n in _step(node, step)]
    return nodes


def _step(node: Found, step: str) -> Iterator[Found]:
    value = node.value
    if isinstance(value, dict):
        yield Found(value.get(step, MISSING), False, False, node.index)
    elif isinstance(value, list):
        for i, item in enumerate(value):
            if isinstance(item, dict):
                yield Found(item.get(step, MISSING), False, True, i if node.index is None else node.index)
        if step.isdigit():
            at = int(step)
            yield Found(value[at] if at < len(value) else MISSING, True, True, at if node.index is None else node.index)
    else:
        yield Found(MISSING, node.positioned, node.in_array, node.index)


def values(nodes: list[Found], unpack: bool = True, pack: bool = True) -> Iterator[tuple[Any, int | None]]:
    """(value, index in the first array); arrays give their elements, then themselves.

    A value reached by its position isn't unpacked.
    """
    for node in nodes:
        value = node.value
        if isinstance(value, list):
            if unpack and not node.positioned:
                for i, item in enumerate(value):
                    yield item, i if node.index is None else node.index
            if pack:
                yield value, node.index
        elif value is not MISSING:
            yield value, node.index


def arrays(nodes: list[Found]) -> Iterator[tuple[list, int | None]]:
    for node in nodes:
        if isinstance(node.value, list):
            yield node.value, node.index


def exists(nodes: list[Found]) -> bool:
    return any(n.value is not MISSING for n in nodes)


def is_null(nodes: list[Found]) -> bool:
    """Null, or missing, or an array with a null element."""
    return any(n.counts_as_missing for n in nodes) or any(v is None for v, _ in values(nodes, pack=False))
