"""Document operations on tables of (seq, id_key, doc), run in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.compat import DEFAULT, CompatProfile
from docweave.documents.match import compile_filter
from docweave.documents.prefilter import candidates, judged
from docweave.documents.project import Projection, compile_projection
from docweave.documents.update import Update, Updater
from docweave.documents.walk import MISSING, values, walk
from docweave.errors import OperationFailure, WriteError
from docweave.functions import ejson
from docweave.functions.order import array_key, sort_key
from docweave.plans import spec as S

ROWS = "seq long, id_key binary, doc string"


def from_column(df: DataFrame, seq: str, doc: str) -> DataFrame:
    """A table of JSON texts as a collection to be read.

    Its documents have no key; null texts are left out, and texts that
    aren't JSON objects match no filter.
    """
    return df.select(F.col(seq).cast("long").alias("seq"), F.lit(None).cast("binary").alias("id_key"), F.col(doc).cast("string").alias("doc")).where("doc IS NOT NULL")


def read_document(text: str) -> dict | None:
    try:
        value = ejson.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _is_json(text: str) -> bool:
    """Whether a text that begins like an object is one JSON value."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def matching(frame: DataFrame, spec: dict | None, sort: list[tuple[str, int]] | None = None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """Rows that match, with ``hit`` (array positions, JSON) and sort keys ``s0``, ``s1``, ...

    An ``_id`` equality is checked on the key column first, where the file
    statistics can skip whole row groups. What expressions can settle is
    settled before documents are read in Python; of those that surely match
    only the syntax is checked there.
    """
    tree = S.parse_filter(spec, compat)
    sort = sort or []
    columns = [f"s{n}" for n in range(len(sort))]
    if spec:
        for path, value in S.equalities(spec).items():
            if path == "_id" and value is not None and not isinstance(value, (dict, list)):
                frame = frame.where(F.col("id_key").isNull() | (F.col("id_key") == F.lit(sort_key(value))))
    if not tree.parts and not sort:
        return frame.withColumn("hit", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holds = compile_filter(tree, compat)
        for batch in batches:
            keep, hits, keys = [], [], [[] for _ in sort]
            for n, (text, sure) in enumerate(zip(batch["doc"], batch["sure"])):
                if sure and not sort:
                    if _is_json(text):
                        keep.append(n)
                        hits.append(None)
                    continue
                doc, hit = read_document(text), {}
                if doc is not None and (sure or holds(doc, hit)):
                    keep.append(n)
                    hits.append(json.dumps(hit) if hit else None)
                    for at, (path, direction) in enumerate(sort):
                        keys[at].append(path_key(doc, path, direction))
            out = batch.iloc[keep].drop(columns="sure").assign(hit=pd.Series(hits, dtype=object, index=batch.index[keep]))
            for name, column in zip(columns, keys):
                out[name] = pd.Series(column, dtype=object, index=out.index)
            yield out

    return candidates(frame.select("seq", "id_key", "doc"), tree).mapInPandas(run, ", ".join([ROWS, "hit string", *(f"{c} binary" for c in columns)]))


def path_key(doc: dict, path: str, direction: int) -> bytes:
    """Sort key of a document by a path: least value ascending, greatest descending."""
    nodes = walk(doc, path)
    found = [v for v, _ in values(nodes, pack=False)]
    # a position is taken whole, also an array
    empty = any(isinstance(n.value, list) and not n.value for n in nodes)
    if any(n.value is MISSING for n in nodes) and not empty:
        found.append(None)
    return array_key(found, direction == -1, empty)


def ordered(rows: DataFrame, sort: list[tuple[str, int]] | None) -> DataFrame:
    """In order of the sort keys; ties and no keys at all in order of insertion."""
    keys = [F.col(f"s{n}").asc() if d == 1 else F.col(f"s{n}").desc() for n, (_, d) in enumerate(sort or [])]
    return rows.orderBy(*keys, F.col("seq").asc())


def projected(rows: DataFrame, spec, filter_spec: dict | None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """The rows with ``doc`` reduced to a projection."""
    projection = Projection(spec, filter_spec, compat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reduce_ = compile_projection(projection, compat)
        for batch in batches:
            docs, errors = [], []
            for text, hit in zip(batch["doc"], batch["hit"]):
                try:
                    docs.append(ejson.dumps(reduce_(ejson.loads(text), json.loads(hit) if hit else {})))
                    errors.append(None)
                except OperationFailure as e:
                    docs.append(None)
                    errors.append(json.dumps([str(e), e.code]))
            yield batch[["seq", "id_key"]].assign(doc=docs, error=errors)

    return rows.select("seq", "id_key", "doc", "hit").mapInPandas(run, ROWS + ", error string")


def distinct_values(frame: DataFrame, path: str, spec: dict | None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """``key, value``: the distinct values at a path, arrays unpacked once, in order."""
    tree = S.parse_filter(spec, compat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holds = compile_filter(tree, compat)
        for batch in batches:
            seen: dict[bytes, str] = {}
            for text, sure in zip(batch["doc"], batch["sure"]):
                doc = read_document(text)
                if doc is not None and (sure or holds(doc, {})):
                    for v, _ in values(walk(doc, path), pack=False):
                        seen.setdefault(sort_key(v), ejson.dumps({"v": v}))
            yield pd.DataFrame(list(seen.items()), columns=["key", "value"])

    found = candidates(frame.select("doc"), tree).mapInPandas(run, "key binary, value string")
    return found.groupBy("key").agg(F.min("value").alias("value")).orderBy("key")


def updated(frame: DataFrame, spec: dict | None, update: Update | dict, only_seq: int | None = None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """All rows after an update of those that match, with ``matched``, ``modified`` and ``error``.

    A dict as ``update`` replaces documents, all but their ``_id``.
    """
    tree = S.parse_filter(spec, compat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holds = compile_filter(tree, compat)
        updater = Updater(update) if isinstance(update, Update) else None
        for batch in batches:
            docs, matched, modified, errors = [], [], [], []
            for seq, text, sure in zip(batch["seq"], batch["doc"], batch["sure"]):
                hit: dict = {}
                if sure is False or only_seq is not None and seq != only_seq:
                    found = False
                else:
                    doc = ejson.loads(text)
                    found = holds(doc, hit)
                error, changed = None, False
                if found:
                    try:
                        new = updater.apply(doc, hit) if updater else {"_id": doc["_id"]} | {k: v for k, v in update.items() if k != "_id"}
                        written = text if new is doc else ejson.dumps(new)
                        changed = written != text
                        text = written
                    except (WriteError, OperationFailure) as e:
                        error = json.dumps([type(e).__name__, str(e), e.code])
                docs.append(text)
                matched.append(found)
                modified.append(changed)
                errors.append(error)
            yield batch[["seq", "id_key"]].assign(doc=docs, matched=matched, modified=modified, error=errors)

    return judged(frame.select("seq", "id_key", "doc"), tree).mapInPandas(run, ROWS + ", matched boolean, modified boolean, error string")
