"""Extended JSON: documents to text and back."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from docweave.functions.bsontypes import Binary, Code, Decimal128, Int64, MaxKey, MinKey, ObjectId, Regex, Timestamp
from docweave.functions.canonical import to_millis
from docweave.functions.order import millis

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def from_millis(value: int) -> datetime:
    return _EPOCH + timedelta(milliseconds=value)


def _encoded(value):
    if value is None or value is True or value is False or type(value) in (str, int):
        return value
    if isinstance(value, Int64):
        return {"$numberLong": str(int(value))}
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return {"$numberDouble": "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"}
        return value
    if isinstance(value, dict):
        return {k: _encoded(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_encoded(v) for v in value]
    if isinstance(value, ObjectId):
        return {"$oid": str(value)}
    if isinstance(value, datetime):
        return {"$date": millis(value)}
    if isinstance(value, (Decimal128, Decimal)):
        return {"$numberDecimal": str(value)}
    if isinstance(value, Code):
        return {"$code": str(value)} if value.scope is None else {"$code": str(value), "$scope": _encoded(value.scope)}
    if isinstance(value, bytes):
        return {"$binary": base64.b64encode(value).decode(), "$type": f"{getattr(value, 'subtype', 0):02x}"}
    if isinstance(value, re.Pattern):
        value = Regex.from_native(value)
    if isinstance(value, Regex):
        return {"$regex": value.pattern, "$options": value.flags}
    if isinstance(value, Timestamp):
        return {"$timestamp": {"t": value.time, "i": value.inc}}
    if isinstance(value, MinKey):
        return {"$minKey": 1}
    if isinstance(value, MaxKey):
        return {"$maxKey": 1}
    if isinstance(value, (str, int)):
        return value
    to_json = getattr(value, "to_json", None)  # extension point for types of the user
    if to_json is not None:
        return to_json()
    raise TypeError(f"{type(value).__name__} can't be stored")


#: Hooks of the user: tag to a function of the tagged object.
CUSTOM_HOOKS: dict[str, Callable] = {}


def _decoded(value: dict):
    if not value or len(value) > 2:
        return value
    key = next(iter(value))
    if key[:1] != "$":
        return value
    if key in CUSTOM_HOOKS:
        return CUSTOM_HOOKS[key](value)
    x = value[key]
    try:
        if len(value) == 1:
            if key == "$oid":
                return ObjectId(x)
            if key == "$date":
                from docweave.functions.canonical import Fields

                at = to_millis(Fields(x.items()) if isinstance(x, dict) else int(x) if isinstance(x, Int64) else x)
                return value if at is None else from_millis(at)
            if key == "$numberLong":
                return Int64(x)
            if key == "$numberInt":
                return int(x)
            if key == "$numberDouble":
                return float(x)
            if key == "$numberDecimal":
                return Decimal128(x)
            if key == "$timestamp":
                return Timestamp(int(x["t"]), int(x["i"]))
            if key == "$minKey":
                return MinKey()
            if key == "$maxKey":
                return MaxKey()
            if key == "$code":
                return Code(x)
            if key == "$binary" and isinstance(x, dict):
                return _bytes(x["base64"], x.get("subType", "00"))
            if key == "$regularExpression":
                return Regex(x["pattern"], x.get("options", ""))
            if key == "$regex":
                return Regex(x, "")
            if key == "$uuid":
                return Binary(bytes.fromhex(x.replace("-", "")), 4)
        elif key == "$regex" and "$options" in value:
            return Regex(x, value["$options"])
        elif key == "$binary" and "$type" in value:
            return _bytes(x, value["$type"])
        elif key == "$code" and "$scope" in value:
            return Code(x, value["$scope"])
    except (TypeError, ValueError, KeyError, AttributeError):
        pass
    return value


def _bytes(text: str, subtype) -> bytes:
    data, kind = base64.b64decode(text), int(str(subtype), 16)
    return Binary(data, kind) if kind else data


def dumps(value, indent: int | None = None) -> str:
    return json.dumps(_encoded(value), ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))


def loads(text: str):
    return json.loads(text, object_hook=_decoded)
