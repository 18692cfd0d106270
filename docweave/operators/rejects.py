"""Loading lines while setting aside those that fail to parse, with a reason.

Delimited lines are parsed by structural indexing: the lines of a batch form
one byte buffer, a numpy mask marks the quotes, the parity of the quotes so
far tells which delimiters separate fields, and counts and type checks then
split the lines into valid and rejected ones. Each line is judged alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.functions.canonical import Fields, json_reader
from docweave.session import small_rows

QUOTING, COLUMN_COUNT, BAD_VALUE, UNKNOWN_LAYOUT = "quoting", "column_count", "bad_value", "unknown_layout"
_QUOTE = 34
_INT = re.compile(r"[+-]?[0-9]+\Z")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})\Z")
_OID = re.compile(r"[0-9a-fA-F]{24}\Z")
#: Spark type of each field type.
SPARK_TYPES = {"int": "bigint", "number": "double", "bool": "boolean", "date": "date", "oid": "string", "string": "string"}


class LayoutField(NamedTuple):
    name: str
    kind: str
    null_ok: bool


class Layout(NamedTuple):
    fmt: str
    delim: str
    fields: tuple[LayoutField, ...]


def read_layouts(df: DataFrame, limit: int = 100_000) -> dict[str, Layout]:
    """Layouts by name from ``layout, fmt, delim, pos, field_name, field_type, null_ok``."""
    by: dict[str, list] = {}
    for r in small_rows(df.select("layout", "fmt", "delim", "pos", "field_name", "field_type", "null_ok"), limit, "the table of layouts"):
        by.setdefault(r.layout, []).append(r)
    out = {}
    for name, rows in by.items():
        rows.sort(key=lambda r: r.pos)
        delim = rows[0].delim or ""
        if rows[0].fmt == "delimited" and len(delim.encode()) != 1:
            raise ValueError(f"layout {name}: a delimiter is one byte")
        unknown = {r.field_type for r in rows} - SPARK_TYPES.keys()
        if unknown:
            raise ValueError(f"layout {name}: unknown field types {sorted(unknown)}")
        out[name] = Layout(rows[0].fmt, delim, tuple(LayoutField(r.field_name, r.field_type, bool(r.null_ok)) for r in rows))
    return out


def _is_day(text: str) -> bool:
    m = _DATE.match(text)
    if not m:
        return False
    try:
        date(*map(int, m.groups()))
    except ValueError:
        return False
    return True


def _is_int64(text: str) -> bool:
    return bool(_INT.match(text)) and len(text.lstrip("+-").lstrip("0")) <= 19 and -(2**63) <= int(text) < 2**63


_TEXT_CHECKS = {
    "string": lambda t: True,
    "int": _is_int64,
    "number": lambda t: bool(_NUMBER.match(t)),
    "bool": lambda t: t.lower() in ("true", "false"),
    "date": _is_day,
    "oid": lambda t: bool(_OID.match(t)),
}


def text_ok(text: str, field: LayoutField) -> bool:
    """Whether the text of a delimited field is a value of its type."""
    if text == "" and field.kind != "string":
        return field.null_ok
    return _TEXT_CHECKS[field.kind](text)


class _Real(str):
    """A JSON number with fraction or exponent."""

    __slots__ = ()


class _Whole(str):
    """A JSON number without."""

    __slots__ = ()


def _no_constant(text: str):
    raise ValueError(text)


_read = json_reader(object_pairs_hook=Fields, parse_float=_Real, parse_int=_Whole, parse_constant=_no_constant)


def json_ok(value, field: LayoutField) -> bool:
    if value is None:
        return field.null_ok
    kind = type(value)
    if field.kind == "int":
        return kind is _Whole and _is_int64(value)
    if field.kind == "number":
        return kind is _Whole or kind is _Real
    if field.kind == "bool":
        return kind is bool
    if field.kind == "oid":
        return kind is Fields and len(value) == 1 and value[0][0] == "$oid" and type(value[0][1]) is str and bool(_OID.match(value[0][1]))
    return kind is str and (field.kind == "string" or _is_day(value))


def _json_text(value) -> str | None:
    if value is None or type(value) is str:
        return value
    if type(value) is bool:
        return "true" if value else "false"
    if type(value) is Fields:
        return value[0][1]
    return str(value)


def judge_json(line: str, layout: Layout) -> tuple[str | None, list | None]:
    """(reason, values) of an ndjson line; values are texts in layout order."""
    try:
        value = _read(line)
    except ValueError:
        return QUOTING, None
    if type(value) is not Fields:
        return QUOTING, None
    named = dict(value)
    if len(value) != len(layout.fields) or len(named) != len(layout.fields):
        return COLUMN_COUNT, None
    values = [named.get(f.name) for f in layout.fields]
    if not all(json_ok(v, f) for v, f in zip(values, layout.fields)):
        return BAD_VALUE, None
    return None, [_json_text(v) for v in values]


def judge_delimited(lines: list[str], layout: Layout) -> list[tuple[str | None, list | None]]:
    """(reason, values) of each delimited line."""
    width = len(layout.fields)
    raw = [line.encode("utf-8", "surrogatepass") for line in lines]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    quotes = np.flatnonzero(buffer == _QUOTE)
    marks = np.flatnonzero(buffer == ord(layout.delim))
    quotes_before = lambda at: np.searchsorted(quotes, at)
    base = quotes_before(starts)
    odd = (quotes_before(ends) - base) & 1
    mark_line = np.searchsorted(ends, marks, side="right")
    outside = ((quotes_before(marks) - base[mark_line]) & 1) == 0
    marks, mark_line = marks[outside], mark_line[outside]
    first_mark = np.searchsorted(mark_line, np.arange(len(raw)))
    counts = np.bincount(mark_line, minlength=len(raw)) + 1

    out: list[tuple[str | None, list | None]] = []
    for i, line in enumerate(raw):
        if odd[i]:
            out.append((QUOTING, None))
            continue
        cuts = marks[first_mark[i] : first_mark[i] + counts[i] - 1] - starts[i]
        left = [0, *(cuts + 1).tolist()]
        right = [*cuts.tolist(), len(line)]
        texts: list[str] | None = []
        for a, b in zip(left, right):
            piece = line[a:b]
            if b'"' in piece:
                inner = piece[1:-1]
                if len(piece) < 2 or piece[:1] != b'"' or piece[-1:] != b'"' or b'"' in inner.replace(b'""', b""):
                    texts = None
                    break
                piece = inner.replace(b'""', b'"')
            texts.append(piece.decode("utf-8", "surrogatepass"))
        if texts is None:
            out.append((QUOTING, None))
        elif counts[i] != width:
            out.append((COLUMN_COUNT, None))
        elif not all(text_ok(t, f) for t, f in zip(texts, layout.fields)):
            out.append((BAD_VALUE, None))
        else:
            out.append((None, [None if t == "" and f.kind != "string" else t for t, f in zip(texts, layout.fields)]))
    return out


def _judge(layouts: dict[str, Layout]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            reason, values, header = [None] * n, [None] * n, [False] * n
            by: dict[str, list[int]] = {}
            for i, (name, text) in enumerate(zip(batch["__layout"], batch["__line"])):
                if text is None or name not in layouts:
                    reason[i] = QUOTING if name in layouts else UNKNOWN_LAYOUT
                else:
                    by.setdefault(name, []).append(i)
            numbers, lines = batch["__no"].tolist(), batch["__line"].tolist()
            for name, at in by.items():
                layout = layouts[name]
                if layout.fmt == "delimited":
                    for i in at:
                        header[i] = numbers[i] == 1
                    at = [i for i in at if not header[i]]
                    judged = judge_delimited([lines[i].strip(" \r") for i in at], layout)
                else:
                    judged = [judge_json(lines[i].strip(" \r"), layout) for i in at]
                for i, (why, got) in zip(at, judged):
                    reason[i], values[i] = why, got
            yield batch.drop(columns=["__layout", "__no", "__line"]).assign(reason=reason, is_header=header, field_values=values)

    return run


def judge_lines(df: DataFrame, layouts: dict[str, Layout], keep: list[str], line: str = "raw_line", layout: str = "layout", line_no: str = "line_no") -> DataFrame:
    """``keep`` columns plus ``reason``, ``is_header`` and ``field_values``.

    ``reason`` is null for valid records and for headers (line 1 of a
    delimited file). ``field_values`` holds the texts of a valid record in
    layout order, null where the value is null. A null line is rejected as
    ``quoting``, an empty one too in ndjson; in a delimited layout an empty
    line has one empty field. A line of an unknown layout is rejected as
    ``unknown_layout``. A JSON object that repeats a name has the wrong
    number of fields. Repeated lines are judged each; an empty table gives
    an empty result.
    """
    picked = df.select(*[F.col(c) for c in keep], F.col(layout).alias("__layout"), F.coalesce(F.col(line_no).cast("long"), F.lit(0)).alias("__no"), F.col(line).alias("__line"))
    schema = StructType([df.schema[c] for c in keep])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return picked.mapInPandas(_judge(layouts), f"{ddl}, reason string, is_header boolean, field_values array<string>")


def _typed(at: int, field: LayoutField) -> Column:
    text = F.get("field_values", F.lit(at))
    if field.kind == "oid":
        return F.lower(text).alias(field.name)
    return text.try_cast(SPARK_TYPES[field.kind]).alias(field.name)


def valid_rows(judged: DataFrame, layout: Layout, keep: list[str]) -> DataFrame:
    """The valid records of one layout as a typed table beside ``keep``."""
    typed = [_typed(i, f) for i, f in enumerate(layout.fields)]
    return judged.where("reason IS NULL AND NOT is_header").select(*keep, *typed)


def rejected_rows(judged: DataFrame, keep: list[str]) -> DataFrame:
    return judged.where("reason IS NOT NULL").select(*keep, "reason")
