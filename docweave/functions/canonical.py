"""Canonical text and digests of extended-JSON values.

Two values have the same canonical text if and only if they are equal:
numbers by value (plain or wrapped as ``$numberLong``, ``$numberInt`` or
``$numberDouble``), ``$oid`` by its 12 bytes, ``$date`` by its millisecond,
strings by code point, arrays by order, objects by their fields in order.
Values of different type are never equal; ``$numberDecimal`` is a type of
its own.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation

import xxhash

_HEX24 = re.compile(r"[0-9a-fA-F]{24}\Z")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?\s*(Z|z|[+-]\d\d:?(?:\d\d)?)?)?\Z")
#: Beyond this many digits or places numbers are written with an exponent.
_PLAIN_DIGITS = 400


class Fields(list):
    """The (name, value) pairs of a JSON object in source order."""

    __slots__ = ()


def _long_int(text: str):
    return int(text) if len(text) <= _PLAIN_DIGITS else Decimal(text)


def _reject_constant(text: str):
    raise ValueError(f"{text} is not JSON")


def deep_stack(f: Callable, *args):
    """``f`` without the usual bound of recursion, which for Python code isn't that of the C stack."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10_000_000))
    try:
        return f(*args)
    finally:
        sys.setrecursionlimit(limit)


def json_reader(**options) -> Callable[[str], object]:
    """A reader of JSON text of any depth; raises ValueError for text that isn't one JSON value."""
    fast, slow = json.JSONDecoder(**options), json.JSONDecoder(**options)
    slow.scan_once = json.scanner.py_make_scanner(slow)

    def read(text: str):
        try:
            return fast.decode(text)
        except RecursionError:
            return deep_stack(slow.decode, text)

    return read


#: JSON text to Python values; objects become :class:`Fields`. Raises ValueError for text that isn't one JSON value.
parse = json_reader(object_pairs_hook=Fields, parse_float=Decimal, parse_int=_long_int, parse_constant=_reject_constant)


def number_text(value) -> str:
    """One text for each numeric value: ``7``, ``7.0`` and ``70e-1`` agree."""
    if type(value) is int:
        if -(10**18) < value < 10**18:
            return str(value)
        value = Decimal(value)
    if not value.is_finite():
        return str(value).lstrip("+").lower()
    sign, digits, exp = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "0"
    stripped = text.rstrip("0")
    exp += len(text) - len(stripped)
    minus = "-" if sign else ""
    if exp == 0:
        return minus + stripped
    if 0 < exp <= _PLAIN_DIGITS:
        return minus + stripped + "0" * exp
    if -_PLAIN_DIGITS <= exp < 0:
        if len(stripped) > -exp:
            return f"{minus}{stripped[:exp]}.{stripped[exp:]}"
        return f"{minus}0.{'0' * (-exp - len(stripped))}{stripped}"
    return f"{minus}{stripped}e{exp}"


def to_millis(value) -> int | None:
    """The instant of a ``$date`` payload in milliseconds, or None."""
    if type(value) is int:
        return value
    if type(value) is Decimal:
        return int(value) if value == value.to_integral_value() else None
    if type(value) is Fields and len(value) == 1 and value[0][0] in ("$numberLong", "$numberInt"):
        try:
            return int(value[0][1])
        except (TypeError, ValueError):
            return None
    if type(value) is str and (m := _ISO.match(value)):
        year, month, day, hour, minute, second, fraction, zone = m.groups()
        try:
            at = datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0), tzinfo=timezone.utc)
        except ValueError:
            return None
        delta = at - _EPOCH
        millis = (delta.days * 86400 + delta.seconds) * 1000 + int((fraction or "0")[:3].ljust(3, "0"))
        if zone and zone not in "Zz":
            digits = zone[1:].replace(":", "").ljust(4, "0")
            offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
            millis -= int(offset.total_seconds() * 1000) * (-1 if zone[0] == "-" else 1)
        return millis
    return None


def _wrapped(name: str, value) -> str | None:
    if name == "$oid":
        return "o" + value.lower() if type(value) is str and _HEX24.match(value) else None
    if name == "$date":
        millis = to_millis(value)
        return None if millis is None else f"t{millis}"
    if name in ("$numberLong", "$numberInt", "$numberDouble", "$numberDecimal"):
        kind = "D" if name == "$numberDecimal" else "#"
        try:
            return kind + number_text(value if type(value) in (int, Decimal) else Decimal(value.strip()))
        except (InvalidOperation, AttributeError):
            return None
    return None


def canonical(value) -> str:
    try:
        return _canonical(value)
    except RecursionError:
        return deep_stack(_canonical, value)


def _canonical(value) -> str:
    kind = type(value)
    if kind is str:
        return f"s{len(value)}:{value}"
    if kind is int or kind is Decimal:
        return "#" + number_text(value)
    if value is None:
        return "n"
    if kind is bool:
        return "b1" if value else "b0"
    if kind is Fields:
        if len(value) == 1 and value[0][0][:1] == "$":
            known = _wrapped(*value[0])
            if known is not None:
                return known
        return "{" + ",".join([f"{len(k)}:{k}={_canonical(v)}" for k, v in value]) + "}"
    if kind is list:
        return "[" + ",".join([_canonical(v) for v in value]) + "]"
    raise TypeError(kind)


def digest(text: str) -> bytes:
    """128 bits of a canonical text."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def canonical_json(text: str | None) -> str:
    """Canonical text of a JSON text; text that isn't JSON equals only itself."""
    if text is None:
        return "x"
    try:
        return canonical(parse(text))
    except ValueError:
        return "!" + text


def is_value_object(value) -> bool:
    """An object whose first key starts with ``$`` stands for a value."""
    return type(value) is Fields and bool(value) and value[0][0][:1] == "$"


def printable(name: str) -> str:
    """``name`` with lone surrogates escaped, so that it can leave Python."""
    return name.encode("utf-8", "backslashreplace").decode("utf-8")
