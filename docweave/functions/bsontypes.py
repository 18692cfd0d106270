"""Value types of documents that Python has no type for."""

from __future__ import annotations

import os
import re
import struct
import threading
import time
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

from docweave.errors import DocweaveError


class InvalidId(DocweaveError):
    pass


class ObjectId:
    """12 bytes: 4 of seconds, 5 random ones per process, 3 of a counter."""

    __slots__ = ("binary",)
    _lock = threading.Lock()
    _process: tuple[int, bytes] = (0, b"")
    _counter = int.from_bytes(os.urandom(3), "big")

    def __init__(self, oid: str | bytes | ObjectId | None = None):
        if oid is None:
            self.binary = self._generated()
        elif isinstance(oid, ObjectId):
            self.binary = oid.binary
        elif isinstance(oid, bytes) and len(oid) == 12:
            self.binary = oid
        elif isinstance(oid, str) and re.fullmatch(r"[0-9a-fA-F]{24}", oid):
            self.binary = bytes.fromhex(oid)
        elif isinstance(oid, (str, bytes)):
            raise InvalidId(f"{oid!r} is no ObjectId: it takes 12 bytes or 24 hex digits")
        else:
            raise TypeError(f"an ObjectId is made from str, bytes or ObjectId, not {type(oid).__name__}")

    @classmethod
    def _generated(cls) -> bytes:
        with cls._lock:
            if cls._process[0] != os.getpid():
                cls._process = (os.getpid(), os.urandom(5))
            cls._counter = (cls._counter + 1) % (1 << 24)
            return struct.pack(">I", int(time.time())) + cls._process[1] + cls._counter.to_bytes(3, "big")

    @classmethod
    def from_datetime(cls, moment: datetime) -> ObjectId:
        """The smallest id of a second, to compare ids by time."""
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=timezone.utc)
        return cls(struct.pack(">I", int(moment.timestamp())) + bytes(8))

    @classmethod
    def is_valid(cls, oid) -> bool:
        try:
            cls(oid)
        except (InvalidId, TypeError):
            return False
        return oid is not None

    @property
    def generation_time(self) -> datetime:
        return datetime.fromtimestamp(struct.unpack(">I", self.binary[:4])[0], timezone.utc)

    def __str__(self) -> str:
        return self.binary.hex()

    def __repr__(self) -> str:
        return f"ObjectId('{self}')"

    def __eq__(self, other) -> bool:
        return isinstance(other, ObjectId) and self.binary == other.binary

    def __lt__(self, other) -> bool:
        return self.binary < other.binary if isinstance(other, ObjectId) else NotImplemented

    def __le__(self, other) -> bool:
        return self.binary <= other.binary if isinstance(other, ObjectId) else NotImplemented

    def __gt__(self, other) -> bool:
        return self.binary > other.binary if isinstance(other, ObjectId) else NotImplemented

    def __ge__(self, other) -> bool:
        return self.binary >= other.binary if isinstance(other, ObjectId) else NotImplemented

    def __hash__(self) -> int:
        return hash(self.binary)

    def __reduce__(self):
        return ObjectId, (self.binary,)


class Int64(int):
    """An integer stored with 64 bits."""


class Decimal128:
    """A decimal of 34 digits; NaN and infinities included."""

    __slots__ = ("value",)

    def __init__(self, value):
        try:
            self.value = value.value if isinstance(value, Decimal128) else Decimal(value)
        except InvalidOperation as e:
            raise ValueError(f"{value!r} is no decimal") from e

    def to_decimal(self) -> Decimal:
        return self.value

    def __str__(self) -> str:
        return str(self.value)

    def __repr__(self) -> str:
        return f"Decimal128('{self.value}')"

    def __eq__(self, other) -> bool:
        return isinstance(other, Decimal128) and str(self.value) == str(other.value)

    def __hash__(self) -> int:
        return hash(str(self.value))


class Binary(bytes):
    """Bytes with a subtype."""

    subtype = 0

    def __new__(cls, data: bytes, subtype: int = 0):
        self = super().__new__(cls, data)
        self.subtype = subtype
        return self

    def __reduce__(self):
        return Binary, (bytes(self), self.subtype)


@dataclass(frozen=True)
class Regex:
    pattern: str
    flags: str = ""

    @classmethod
    def from_native(cls, compiled: re.Pattern) -> Regex:
        letters = ((re.I, "i"), (re.L, "l"), (re.M, "m"), (re.S, "s"), (re.X, "x"))
        flags = "".join(c for bit, c in letters if compiled.flags & bit)
        pattern = compiled.pattern
        return cls(pattern.decode() if isinstance(pattern, bytes) else pattern, flags)

    def compiled(self) -> re.Pattern:
        bits = {"i": re.I, "m": re.M, "s": re.S, "x": re.X}
        flags = re.RegexFlag(0)
        for c in self.flags:
            flags |= bits.get(c, re.RegexFlag(0))
        return re.compile(self.pattern, flags)


@dataclass(frozen=True)
class Timestamp:
    time: int
    inc: int


class Code(str):
    scope: dict | None = None

    def __new__(cls, code: str, scope: dict | None = None):
        self = super().__new__(cls, code)
        self.scope = scope
        return self

    def __reduce__(self):
        return Code, (str(self), self.scope)


class MinKey:
    def __eq__(self, other) -> bool:
        return isinstance(other, MinKey)

    def __hash__(self) -> int:
        return 1

    def __repr__(self) -> str:
        return "MinKey()"


class MaxKey:
    def __eq__(self, other) -> bool:
        return isinstance(other, MaxKey)

    def __hash__(self) -> int:
        return 2

    def __repr__(self) -> str:
        return "MaxKey()"


#: Type numbers and names that ``$type`` takes.
TYPE_IDS = {
    "double": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "undefined": 6, "objectId": 7, "bool": 8, "date": 9, "null": 10, "regex": 11,
    "dbPointer": 12, "javascript": 13, "symbol": 14, "javascriptWithScope": 15, "int": 16, "timestamp": 17, "long": 18, "decimal": 19, "minKey": -1, "maxKey": 127,
}
NUMBER_IDS = frozenset({1, 16, 18, 19})


def type_id(value) -> int:
    """The type number of a value."""
    if value is None:
        return 10
    if isinstance(value, bool):
        return 8
    if isinstance(value, Int64):
        return 18
    if isinstance(value, int):
        return 16
    if isinstance(value, float):
        return 1
    if isinstance(value, (Decimal128, Decimal)):
        return 19
    if isinstance(value, Code):
        return 13 if value.scope is None else 15
    if isinstance(value, str):
        return 2
    if isinstance(value, dict):
        return 3
    if isinstance(value, (list, tuple)):
        return 4
    if isinstance(value, bytes):
        return 5
    if isinstance(value, ObjectId):
        return 7
    if isinstance(value, datetime):
        return 9
    if isinstance(value, Timestamp):
        return 17
    if isinstance(value, (Regex, re.Pattern)):
        return 11
    if isinstance(value, MinKey):
        return -1
    if isinstance(value, MaxKey):
        return 127
    raise TypeError(f"{type(value).__name__} is no type of a document")
