"""One total order over values of all types, as byte strings that compare alike."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timezone
from decimal import Decimal

from docweave.functions.bsontypes import Code, Decimal128, Int64, MaxKey, MinKey, ObjectId, Regex, Timestamp

#: The order of types; an empty array sorts before null, but only as a sort key.
WEIGHT_EMPTY_ARRAY, WEIGHT_NULL, WEIGHT_NUMBER = 0, 1, 2
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def weight(value) -> int:
    if isinstance(value, MinKey):
        return -1
    if value is None:
        return WEIGHT_NULL
    if isinstance(value, bool):
        return 8
    if isinstance(value, (int, float, Int64, Decimal128, Decimal)):
        return WEIGHT_NUMBER
    if isinstance(value, Code):
        return 12 if value.scope is None else 13
    if isinstance(value, str):
        return 3
    if isinstance(value, dict):
        return 4
    if isinstance(value, (list, tuple)):
        return 5
    if isinstance(value, bytes):
        return 6
    if isinstance(value, ObjectId):
        return 7
    if isinstance(value, datetime):
        return 9
    if isinstance(value, Timestamp):
        return 10
    if isinstance(value, (Regex, re.Pattern)):
        return 11
    if isinstance(value, MaxKey):
        return 127
    raise TypeError(f"{type(value).__name__} has no place in the order")


def _number(value) -> bytes:
    if isinstance(value, Decimal128):
        value = value.value
    if isinstance(value, float):
        if value != value:
            return b"\x01"
        if value in (float("inf"), float("-inf")):
            return b"\x82" if value > 0 else b"\x7e"
        value = Decimal(value)
    elif not isinstance(value, Decimal):
        value = Decimal(int(value))
    if value.is_nan():
        return b"\x01"
    if value.is_infinite():
        return b"\x82" if value > 0 else b"\x7e"
    if not value:
        return b"\x80"
    sign, digits, _ = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0").rstrip("0").encode()
    body = struct.pack(">I", value.adjusted() + (1 << 31)) + text + b"\x00"
    return b"\x7f" + bytes(255 - b for b in body) if sign else b"\x81" + body


def _text(value: str | bytes) -> bytes:
    raw = value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value)
    return raw.replace(b"\x00", b"\x00\xff") + b"\x00\x00"


def millis(value: datetime) -> int:
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    delta = value - _EPOCH
    return (delta.days * 86400 + delta.seconds) * 1000 + delta.microseconds // 1000


def _payload(value, w: int) -> bytes:
    if w == WEIGHT_NUMBER:
        return _number(value)
    if w == 3:
        return _text(value)
    if w == 4:
        return b"".join(bytes([weight(v) + 2]) + _text(k) + _payload(v, weight(v)) for k, v in value.items()) + b"\x00"
    if w == 5:
        return b"".join(map(sort_key, value)) + b"\x00"
    if w == 6:
        return _text(value)
    if w == 7:
        return value.binary
    if w == 8:
        return b"\x01" if value else b"\x00"
    if w == 9:
        return struct.pack(">Q", millis(value) + (1 << 63))
    if w == 10:
        return struct.pack(">II", value.time, value.inc)
    if w == 11:
        r = value if isinstance(value, Regex) else Regex.from_native(value)
        return _text(r.pattern) + _text("".join(sorted(r.flags)))
    if w in (12, 13):
        return _text(str(value)) + (_payload(value.scope, 4) if w == 13 else b"")
    return b""


def sort_key(value) -> bytes:
    """Bytes that order as the values do; equal values have equal bytes."""
    w = weight(value)
    return bytes([w + 2]) + _payload(value, w)


def array_key(values: list, descending: bool, empty: bool) -> bytes:
    """Sort key of a path: its least value, or its greatest when descending.

    No value at all sorts as null; ``empty`` tells of an empty array.
    """
    if not values:
        return bytes([(WEIGHT_EMPTY_ARRAY if empty else WEIGHT_NULL) + 2])
    keys = map(sort_key, values)
    return max(keys) if descending else min(keys)


def same(a, b) -> bool:
    """Equality of the language: numbers by value, never bool with number."""
    return weight(a) == weight(b) and sort_key(a) == sort_key(b)


def is_nan(value) -> bool:
    if isinstance(value, Decimal128):
        value = value.value
    return isinstance(value, (float, Decimal)) and value != value
