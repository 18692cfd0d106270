"""BSON, the binary form of documents."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal

from docweave.functions.bsontypes import Binary, Code, Decimal128, Int64, MaxKey, MinKey, ObjectId, Regex, Timestamp
from docweave.functions.ejson import from_millis
from docweave.functions.order import millis

#: Fixed values of the decimal format: bias of the exponent, and the bits of special values.
_BIAS, _INFINITY, _NAN = 6176, 0x78, 0x7C


def _cstring(text: str) -> bytes:
    raw = text.encode()
    if b"\x00" in raw:
        raise ValueError("a field name may not contain NUL")
    return raw + b"\x00"


def _string(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass") + b"\x00"
    return struct.pack("<i", len(raw)) + raw


def encode_decimal(value: Decimal) -> bytes:
    sign, digits, exponent = value.as_tuple()
    top = 0x80 if sign else 0
    if value.is_infinite():
        return bytes(15) + bytes([top | _INFINITY])
    if value.is_nan():
        return bytes(15) + bytes([top | _NAN])
    number = int("".join(map(str, digits)))
    while number >= 10**34 and number % 10 == 0:
        number //= 10
        exponent += 1
    if number >= 10**34 or not -6176 <= exponent <= 6111:
        raise ValueError(f"{value} doesn't fit 34 digits")
    whole = number | ((exponent + _BIAS) << 113) | (sign << 127)
    return whole.to_bytes(16, "little")


def decode_decimal(data: bytes) -> Decimal:
    whole = int.from_bytes(data, "little")
    sign = whole >> 127
    if (data[15] & 0x7C) == _NAN:
        return Decimal("NaN")
    if (data[15] & 0x7C) == _INFINITY:
        return Decimal("-Infinity" if sign else "Infinity")
    if (data[15] & 0x60) == 0x60:  # the long form of the coefficient is always zero
        exponent, number = ((whole >> 111) & 0x3FFF) - _BIAS, 0
    else:
        exponent, number = ((whole >> 113) & 0x3FFF) - _BIAS, whole & ((1 << 113) - 1)
    return Decimal((sign, tuple(map(int, str(number))), exponent))


def _element(value) -> tuple[int, bytes]:
    if value is None:
        return 0x0A, b""
    if isinstance(value, bool):
        return 0x08, b"\x01" if value else b"\x00"
    if isinstance(value, Int64):
        return 0x12, struct.pack("<q", value)
    if isinstance(value, int):
        if -(1 << 31) <= value < 1 << 31:
            return 0x10, struct.pack("<i", value)
        return 0x12, struct.pack("<q", value)
    if isinstance(value, float):
        return 0x01, struct.pack("<d", value)
    if isinstance(value, (Decimal128, Decimal)):
        return 0x13, encode_decimal(value.value if isinstance(value, Decimal128) else value)
    if isinstance(value, Code):
        if value.scope is None:
            return 0x0D, _string(value)
        body = _string(value) + encode(value.scope)
        return 0x0F, struct.pack("<i", len(body) + 4) + body
    if isinstance(value, str):
        return 0x02, _string(value)
    if isinstance(value, dict):
        return 0x03, encode(value)
    if isinstance(value, (list, tuple)):
        return 0x04, encode({str(i): x for i, x in enumerate(value)})
    if isinstance(value, bytes):
        return 0x05, struct.pack("<iB", len(value), getattr(value, "subtype", 0)) + bytes(value)
    if isinstance(value, ObjectId):
        return 0x07, value.binary
    if isinstance(value, datetime):
        return 0x09, struct.pack("<q", millis(value))
    if isinstance(value, re.Pattern):
        value = Regex.from_native(value)
    if isinstance(value, Regex):
        return 0x0B, _cstring(value.pattern) + _cstring("".join(sorted(value.flags)))
    if isinstance(value, Timestamp):
        return 0x11, struct.pack("<II", value.inc, value.time)
    if isinstance(value, MinKey):
        return 0xFF, b""
    if isinstance(value, MaxKey):
        return 0x7F, b""
    raise TypeError(f"{type(value).__name__} can't be encoded")


def encode(doc: dict) -> bytes:
    parts = []
    for key, value in doc.items():
        kind, data = _element(value)
        parts.append(bytes([kind]) + _cstring(key) + data)
    body = b"".join(parts)
    return struct.pack("<i", len(body) + 5) + body + b"\x00"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the document is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def cstring(self) -> str:
        end = self.data.index(b"\x00", self.at)
        text = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return text

    def string(self) -> str:
        (n,) = self.unpack("<i")
        return self.take(n)[:-1].decode("utf-8", "surrogatepass")

    def document(self) -> dict:
        start = self.at
        (size,) = self.unpack("<i")
        out = {}
        while (kind := self.take(1)[0]) != 0:
            key = self.cstring()
            out[key] = self.value(kind)
        if self.at - start != size:
            raise ValueError("a document's length is wrong")
        return out

    def value(self, kind: int):
        if kind == 0x01:
            return self.unpack("<d")[0]
        if kind in (0x02, 0x0E):
            return self.string()
        if kind == 0x03:
            return self.document()
        if kind == 0x04:
            return list(self.document().values())
        if kind == 0x05:
            n, subtype = self.unpack("<iB")
            data = self.take(n)
            return Binary(data, subtype) if subtype else data
        if kind == 0x07:
            return ObjectId(self.take(12))
        if kind == 0x08:
            return self.take(1) == b"\x01"
        if kind == 0x09:
            return from_millis(self.unpack("<q")[0])
        if kind in (0x0A, 0x06):
            return None
        if kind == 0x0B:
            return Regex(self.cstring(), self.cstring())
        if kind == 0x0D:
            return Code(self.string())
        if kind == 0x0F:
            self.unpack("<i")
            return Code(self.string(), self.document())
        if kind == 0x10:
            return self.unpack("<i")[0]
        if kind == 0x11:
            inc, seconds = self.unpack("<II")
            return Timestamp(seconds, inc)
        if kind == 0x12:
            return Int64(self.unpack("<q")[0])
        if kind == 0x13:
            return Decimal128(decode_decimal(self.take(16)))
        if kind == 0x7F:
            return MaxKey()
        if kind == 0xFF:
            return MinKey()
        raise ValueError(f"unknown element type {kind:#x}")


def decode(data: bytes) -> dict:
    return _Reader(data).document()


def split(data: bytes) -> Iterator[bytes]:
    """The documents of a dump file, one after the other."""
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        if size < 5 or at + size > len(data):
            raise ValueError("the dump is cut short")
        yield data[at : at + size]
        at += size
