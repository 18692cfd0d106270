"""Schemas that drift between the files of a feed.

The catalogue holds, per file, each path with the rows that have it and its
dominant type. A window over (feed, path, type) with ``lag`` and ``lead``
cuts the life of a column into islands; the starts and endings of islands
are the changes. Renames are confirmed by the values of the documents that
both files hold, and aliases made from them, file by file, lead the fields of
one consistent table to their columns.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import lru_cache
from math import isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.canonical import Fields, canonical, deep_stack, digest, is_value_object, json_reader, number_text, parse, printable
from docweave.session import small_rows, staged

_WRAPPED = {"$numberLong": "number", "$numberInt": "number", "$numberDouble": "number", "$numberDecimal": "decimal", "$date": "date", "$oid": "objectId"}
#: Smallest share of a file's rows that hold a path of the file.
PRESENT = 0.1
#: A rename needs so many shared keys, and this share of them with equal values.
RENAME_KEYS, RENAME_SHARE = 5, 0.9


def type_name(value) -> str | None:
    kind = type(value)
    if value is None:
        return None
    if kind is str:
        return "string"
    if kind is bool:
        return "bool"
    if kind is list:
        return "array"
    if kind is Fields:
        if is_value_object(value):
            return _WRAPPED.get(value[0][0], value[0][0])
        return "object"
    return "number"


def walk_paths(value, out: list[tuple[str, object]]) -> None:
    """(path, value) of each field: objects are entered, also directly in an array."""
    try:
        _walk_paths(value, out)
    except RecursionError:
        out.clear()
        deep_stack(_walk_paths, value, out)


def _walk_paths(value, out: list[tuple[str, object]], parent: str = "") -> None:
    for name, x in value:
        path = f"{parent}.{name}" if parent else name
        out.append((path, x))
        if type(x) is Fields:
            if not is_value_object(x):
                _walk_paths(x, out, path)
        elif type(x) is list:
            for item in x:
                if type(item) is Fields and not is_value_object(item):
                    _walk_paths(item, out, path)


def _document(text: str | None, read: Callable[[str], object] = parse):
    if text is None:
        return None
    try:
        value = read(text)
    except ValueError:
        return None
    return value if type(value) is Fields and not is_value_object(value) else None


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


#: Reads the shape of a document; the exact value of a number doesn't count there.
_read_shape = json_reader(object_pairs_hook=Fields, parse_int=float, parse_constant=_no_constant)


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: Counter = Counter()
        holders: dict[str, Counter] = {}
        typed: dict[str, Counter] = {}
        for file, text in zip(batch["file"], batch["v"]):
            if text is None:
                continue
            rows[file] += 1
            value = _document(text, _read_shape)
            if value is None:
                continue
            pairs: list[tuple[str, object]] = []
            walk_paths(value, pairs)
            if file not in holders:
                holders[file], typed[file] = Counter(), Counter()
            holders[file].update({p for p, _ in pairs})
            typed[file].update([(p, type_name(x)) for p, x in pairs])
        out = [(f, None, None, n) for f, n in rows.items()]
        out += [(f, printable(p), None, n) for f, found in holders.items() for p, n in found.items()]
        out += [(f, printable(p), t, n) for f, found in typed.items() for (p, t), n in found.items() if t is not None]
        yield pd.DataFrame(out, columns=["file", "path", "type", "n"])


def file_catalogue(df: DataFrame, files: DataFrame, file: str = "file", value: str = "v", present: float = PRESENT) -> DataFrame:
    """``feed, file_no, file, path, type, share``: the columns of each file.

    Counts are summed within each batch before the shuffle, so a file with a
    third of all rows is no hot key. ``type`` is the most frequent one among
    the non-null values (the first by name on a tie), null if there are
    none. Rows with a null document don't count; text that is no JSON object
    counts as a row without paths; a file without rows has no columns; rows
    of files that ``files`` doesn't list are left out.
    """
    picked = df.select(F.col(file).cast("string").alias("file"), F.col(value).cast("string").alias("v")).where("v IS NOT NULL AND file IS NOT NULL")
    counts = picked.mapInPandas(_profile, "file string, path string, type string, n long").groupBy("file", "path", "type").agg(F.sum("n").alias("n"))
    by_file = Window.partitionBy("file")
    by_path = Window.partitionBy("file", "path")
    shares = (
        counts.withColumn("rows", F.max(F.when(F.col("path").isNull(), F.col("n"))).over(by_file))
        .where("path IS NOT NULL")
        .withColumn("holders", F.max(F.when(F.col("type").isNull(), F.col("n"))).over(by_path))
        .groupBy("file", "path")
        .agg(
            (F.max("holders") / F.max("rows")).alias("share"),
            F.max("holders").alias("holders"),
            F.max("rows").alias("rows"),
            F.min_by("type", F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("type").alias("t")))).alias("type"),
        )
        .where(F.col("holders") >= F.lit(present) * F.col("rows"))
    )
    listed = files.select("feed", F.col("file_no").cast("long").alias("file_no"), "file")
    return listed.join(shares, "file").select("feed", "file_no", "file", "path", "type", "share")


def lifespans(catalogue: DataFrame) -> DataFrame:
    """``feed, path, type, first_no, last_no``: the islands of each column."""
    line = Window.partitionBy("feed", "path", "type").orderBy("file_no")
    marked = catalogue.withColumn("starts", (F.col("file_no") - F.lag("file_no").over(line) > 1).cast("int"))
    numbered = marked.withColumn("island", F.sum(F.coalesce("starts", F.lit(0))).over(line))
    return numbered.groupBy("feed", "path", "type", "island").agg(F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no")).drop("island")


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*\z", "")).otherwise("")


def path_changes(catalogue: DataFrame) -> DataFrame:
    """``feed, file_no, drift_kind, path``: added, removed and retyped paths.

    ``lag`` and ``lead`` over the life of a path in its feed tell where an
    island of it starts, ends or goes on under another type. A path below a
    changed one is no change of its own.
    """
    line, no = Window.partitionBy("feed", "path").orderBy("file_no"), F.col("file_no")
    around = catalogue.select("feed", "file_no", "path", "type", F.lag("file_no").over(line).alias("last_no"), F.lag("type").over(line).alias("last_type"), F.lead("file_no").over(line).alias("next_no"))
    event = lambda when, at, kind: F.when(when, F.struct(at.alias("file_no"), F.lit(kind).alias("drift_kind"), F.col("path").alias("path")))
    follows = F.coalesce(F.col("last_no") == no - 1, F.lit(False))
    ends = F.coalesce(F.col("next_no") > no + 1, F.lit(True))
    events = F.filter(F.array(event(~follows & ~F.coalesce(F.col("last_no") == no, F.lit(False)), no, "added"), event(ends, no + 1, "removed"), event(follows & (F.col("type") != F.col("last_type")), no, "retyped")), F.isnotnull)
    changes = around.select("feed", F.explode(events).alias("e")).select("feed", "e.*")
    # only files whose predecessor is there can show a change
    steps = catalogue.select("feed", "file_no").distinct().withColumn("last_no", F.lag("file_no").over(Window.partitionBy("feed").orderBy("file_no"))).where("last_no = file_no - 1")
    of_file = changes.join(steps.select("feed", "file_no"), ["feed", "file_no"]).groupBy("feed", "file_no").agg(F.collect_list(F.struct("path", "drift_kind")).alias("own"), F.collect_set("path").alias("paths"))
    above = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws(".", F.slice(parts, F.lit(1), n)))
    below = lambda path: (F.instr(path, ".") > 0) & F.exists(above(F.split(path, r"\.")), lambda upper: F.array_contains("paths", upper))
    return of_file.select("feed", "file_no", F.explode(F.filter("own", lambda c: ~below(c.path))).alias("c")).select("feed", "file_no", "c.drift_kind", "c.path")


def _values_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row, k, text, wanted in zip(batch["row_no"], batch["k"], batch["v"], batch["wanted"]):
            value = _document(text)
            if value is None:
                continue
            pairs: list[tuple[str, object]] = []
            walk_paths(value, pairs)
            held: dict[str, list] = {}
            for path, x in pairs:
                held.setdefault(printable(path), []).append(x)
            for w in wanted:
                if w["path"] in held:
                    out.append((w["feed"], w["at_no"], w["path"], w["old"], k, row, digest(canonical(held[w["path"]]))))
        yield pd.DataFrame(out, columns=["feed", "at_no", "path", "old", "k", "row_no", "held"])


def _one_partner_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for feed, no, pairs in zip(batch["feed"], batch["at_no"], batch["pairs"]):
            olds, news = set(), set()
            for _, _, old, new in sorted((-p["same"] / p["both"], -p["both"], p["old_path"], p["new_path"]) for p in pairs):
                if old not in olds and new not in news:
                    olds.add(old)
                    news.add(new)
                    out.append((feed, no, old, new))
        yield pd.DataFrame(out, columns=["feed", "file_no", "old_path", "new_path"])


#: Up to this many changed paths in all go to every task along with the documents; more are joined by file and salt.
MOST_SENT = 200_000
_SALTS = 32


def renames(df: DataFrame, files: DataFrame, changes: DataFrame, row: str = "row_id", file: str = "file", key: str = "k", value: str = "v", most_sent: int = MOST_SENT) -> DataFrame:
    """``feed, file_no, old_path, new_path``: removed and added paths of equal values.

    For documents whose key is in both files, the list of values at the old
    path is compared with that at the new one. The first row of a re-sent
    key that holds the path counts. A path is renamed once: the best pair is
    taken, then the best of the paths left, until none is. Only documents of
    the files around such changes are read.
    """
    lone = changes.where("drift_kind IN ('added', 'removed')").select("feed", F.col("file_no").alias("at_no"), "path", (F.col("drift_kind") == "removed").alias("old"), _parent(F.col("path")).alias("parent"))
    both_kinds = lone.groupBy("feed", "at_no", "parent").agg(F.collect_list(F.struct("path", "old")).alias("own"), F.max("old").alias("gone"), F.min("old").alias("all_gone")).where("gone AND NOT all_gone")
    needed = both_kinds.select("feed", "at_no", F.explode("own").alias("own")).select("feed", "at_no", "own.path", "own.old")
    by_file = (
        needed.withColumn("file_no", F.col("at_no") - F.col("old").cast("int"))
        .join(files.select("feed", F.col("file_no").cast("long").alias("file_no"), "file"), ["feed", "file_no"])
        .groupBy("file")
        .agg(F.collect_list(F.struct("feed", "at_no", "path", "old")).alias("wanted"))
    )
    by_file = staged(by_file, "wanted")
    picked = df.select(F.col(row).cast("long").alias("row_no"), F.col(file).cast("string").alias("file"), F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v")).where("v IS NOT NULL AND k IS NOT NULL")
    if (by_file.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= most_sent:
        wanted = picked.join(F.broadcast(by_file), "file")
    else:  # a file may hold a third of all rows
        salted = by_file.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
        wanted = picked.withColumn("salt", F.pmod(F.xxhash64("k", "row_no"), F.lit(_SALTS)).cast("int")).join(salted, ["file", "salt"])
    held = wanted.mapInPandas(_values_at, "feed string, at_no long, path string, old boolean, k string, row_no long, held binary").withColumn("parent", _parent(F.col("path")))
    # both sides of a key meet in one group: as many rows as there are changed paths under one parent
    where = ["feed", "at_no", "parent", "k"]
    first = held.repartition(*where).groupBy(*where, "path", "old").agg(F.min_by("held", "row_no").alias("held"))
    side = F.struct("path", "held")
    meeting = first.groupBy(*where).agg(F.collect_list(F.when(F.col("old"), side)).alias("olds"), F.collect_list(F.when(~F.col("old"), side)).alias("news"))
    lines = meeting.where(F.size("news") > 0).select("feed", "at_no", "k", F.explode("olds").alias("o"), "news").select("feed", "at_no", "k", "o", F.explode("news").alias("n"))
    pairs = (
        lines.groupBy("feed", "at_no", F.col("o.path").alias("old_path"), F.col("n.path").alias("new_path"))
        .agg(F.count("*").alias("both"), F.count_if(F.col("o.held") == F.col("n.held")).alias("same"))
        .where((F.col("both") >= RENAME_KEYS) & (F.col("same") >= RENAME_SHARE * F.col("both")))
    )
    # as many pairs as one file has changed paths
    of_file = pairs.groupBy("feed", "at_no").agg(F.collect_list(F.struct("old_path", "new_path", "both", "same")).alias("pairs"))
    return of_file.mapInPandas(_one_partner_each, "feed string, file_no long, old_path string, new_path string")


def schema_drift(df: DataFrame, files: DataFrame, row: str = "row_id", file: str = "file", key: str = "k", value: str = "v", catalogue: DataFrame | None = None) -> DataFrame:
    """``file, drift_kind, old_path, new_path``: each change from a file to the next.

    ``added``, ``removed``, ``retyped`` and ``renamed`` paths between a file
    and the file before it in its feed. Names that differ by letter case
    differ. Files without a listed predecessor, or next to one without
    columns, show no change; empty tables give an empty result. A
    ``catalogue`` of the same tables made with a lower ``present`` is used
    where it is at hand.
    """
    catalogue = staged(file_catalogue(df, files, file, value), "catalogue") if catalogue is None else catalogue.where(F.col("share") >= PRESENT)
    changes = staged(path_changes(catalogue), "changes")
    renamed = staged(renames(df, files, changes, row, file, key, value), "renames")
    empty = F.lit("")
    paired = F.stack(F.lit(2), F.lit("removed"), F.col("old_path"), F.lit("added"), F.col("new_path")).alias("drift_kind", "path")
    left = changes.join(renamed.select("feed", "file_no", paired), ["feed", "file_no", "drift_kind", "path"], "left_anti")
    plain = left.select(
        "feed",
        "file_no",
        "drift_kind",
        F.when(F.col("drift_kind") == "added", empty).otherwise(F.col("path")).alias("old_path"),
        F.when(F.col("drift_kind") == "removed", empty).otherwise(F.col("path")).alias("new_path"),
    )
    log = plain.unionByName(renamed.withColumn("drift_kind", F.lit("renamed")))
    listed = files.select("feed", F.col("file_no").cast("long").alias("file_no"), "file")
    return log.join(listed, ["feed", "file_no"]).select("file", "drift_kind", "old_path", "new_path")


def alias_table(log: DataFrame, limit: int = 100_000) -> dict[str, str]:
    """Each renamed path of one feed with the name that it has in the unified table.

    One name has one alias here, so a log of several feeds goes to
    ``file_aliases``, which keeps them apart. Rename chains lead to
    the newest name; where names were swapped back and forth, the chain ends
    at the first name it meets again. The log is as large as the schema's
    history; more than ``limit`` names raise an error.
    """
    pairs = small_rows(log.where("drift_kind = 'renamed'").groupBy("old_path", "new_path").agg(F.count("*").alias("n")), limit, "the table of aliases")
    step: dict[str, tuple[int, str]] = {}
    for r in pairs:
        step[r.old_path] = max(step.get(r.old_path, (0, "")), (r.n, r.new_path))
    out = {}
    for name in step:
        seen, at = {name}, name
        while at in step and step[at][1] not in seen:
            at = step[at][1]
            seen.add(at)
        if at != name:
            out[name] = at
    return out


def _newest(lives: dict[str, list[tuple[int, bool, str]]], path: str, no: int) -> str:
    """The newest name of what ``path`` is in file ``no``; ``lives`` has the (file_no, born, next name) of each path."""
    seen = set()
    while (path, no) not in seen:
        seen.add((path, no))
        events = lives.get(path, [])
        at = bisect_right(events, no, key=lambda e: e[0])
        if at and not events[at - 1][1]:  # a late document still has a name that is over
            step = events[at - 1]
        elif at < len(events) and (not at or not events[at][1]):
            step = events[at]
        else:
            break
        if step[1]:  # an early document already has a later name
            no = step[0]
        elif step[2]:
            path, no = step[2], step[0]
        else:
            break
    return path


def _aliases_of_feed(log: pd.DataFrame) -> pd.DataFrame:
    lives: dict[str, list[tuple[int, bool, str]]] = {}
    for no, kind, old, new in zip(log["file_no"], log["drift_kind"], log["old_path"], log["new_path"]):
        if kind in ("removed", "renamed"):
            lives.setdefault(old, []).append((no, False, new if kind == "renamed" else ""))
        if kind in ("added", "renamed"):
            lives.setdefault(new, []).append((no, True, ""))
    for events in lives.values():
        events.sort()
    out = [(file, path, _newest(lives, path, no)) for file, no in set(zip(log["file"], log["file_no"])) for path in lives]
    return pd.DataFrame([r for r in out if r[1] != r[2]], columns=["file", "path", "name"])


def file_aliases(log: DataFrame, files: DataFrame) -> DataFrame:
    """``file, path, name``: the top-level paths of each file that have another name in the unified table.

    Renames count within their feed and in order of its files: a path leads
    to the newest name in the feed of what it is in that file. The same name
    in another feed, or again after it was given up, goes its own way.
    Documents that come late in an older shape follow the last rename.
    """
    listed = files.select("feed", F.col("file_no").cast("long").alias("file_no"), "file")
    events = log.where("drift_kind <> 'retyped' AND instr(old_path, '.') = 0 AND instr(new_path, '.') = 0").select("file", "drift_kind", "old_path", "new_path")
    return listed.join(events, "file", "left").groupBy("feed").applyInPandas(_aliases_of_feed, "file string, path string, name string")


_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
_CASTS = {"number": "double", "bool": "boolean"}


def _json_text(value) -> str:
    kind = type(value)
    if kind is Fields:
        return "{" + ",".join([f"{json.dumps(k, ensure_ascii=False)}:{_json_text(x)}" for k, x in value]) + "}"
    if kind is list:
        return "[" + ",".join([_json_text(x) for x in value]) + "]"
    return number_text(value) if kind is int or kind is Decimal else json.dumps(value, ensure_ascii=False)


def _cast(value, kind: str | None):
    """``value`` as a column of ``kind`` holds it, or None."""
    if kind is None:
        return printable(value if type(value) is str else deep_stack(_json_text, value))
    if kind == "boolean":
        return value if type(value) is bool else None
    if is_value_object(value) and len(value) == 1 and type_name(value) == "number":
        value = value[0][1]
    if type(value) not in (int, Decimal, str) or type(value) is str and not _NUMBER.match(value):
        return None
    try:
        number = float(value)
    except OverflowError:
        return None
    # whole numbers that a double can't hold don't fit either
    return number if isfinite(number) and (type(value) is not int or int(number) == value) else None


@lru_cache(1000)
def _names(text: str | None) -> dict[str, str]:
    return json.loads(text) if text else {}


def _unify(n_keep: int, kinds: dict[str, str | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = {None: pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: dict[str, list] = {}
            rest: list[str | None] = [None] * batch.num_rows
            for i, (text, aliases) in enumerate(zip(batch.column(n_keep).to_pylist(), batch.column(n_keep + 1).to_pylist())):
                value = _document(text)
                if value is None:
                    rest[i] = text
                    continue
                held: dict[str, tuple[str, object]] = {}
                left = Fields()
                for path, x in value:
                    path = printable(path)
                    name = _names(aliases).get(path, path)
                    if x is None and name in kinds:
                        continue
                    if name not in kinds:
                        left.append((path, x))
                    elif name not in held:
                        held[name] = path, x
                    elif path == name:
                        left.append(held[name])
                        held[name] = path, x
                    else:
                        left.append((path, x))
                for name, (path, x) in held.items():
                    fit = _cast(x, kinds[name])
                    if fit is None:
                        left.append((path, x))
                        continue
                    if name not in cells:
                        cells[name] = [None] * batch.num_rows
                    cells[name][i] = fit
                if left:
                    rest[i] = printable(deep_stack(_json_text, left))
            columns = [pa.array(cells[name], arrow[kind]) if name in cells else pa.nulls(batch.num_rows, arrow[kind]) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *columns, pa.array(rest, pa.string())], [f"c{i}" for i in range(n_keep + len(columns) + 1)])

    return run


def unified_table(df: DataFrame, catalogue: DataFrame, aliases: DataFrame | dict[str, str], keep: list[str], value: str = "v", limit: int = 20_000, file: str = "file") -> DataFrame:
    """All documents in one table with a column for each top-level field.

    Old names are read under their alias in the file of the document (see
    ``file_aliases``; a dict counts for all files); a column has the type
    that all its files agree on and is text where they don't (containers and
    wrapped values are JSON text); files where less than ``PRESENT`` of the
    rows hold it have a say only if there are no others. ``catalogue`` should
    be made with ``present=0``, so that rare fields have columns too. Feeds
    that give one field different names keep their columns. Columns whose
    names differ only by letter case get a number. What has no place there
    (values that don't fit the type, second values of a column, fields that
    the catalogue doesn't list or with a dot in their name) is kept in the
    column ``rest``, as JSON text; so is a document that is no JSON object.
    """
    if isinstance(aliases, dict):
        aliases = catalogue.select("file").distinct().crossJoin(df.sparkSession.createDataFrame(list(aliases.items()), "path string, name string"))
    paths = catalogue.where(F.instr("path", ".") == 0).join(aliases, ["file", "path"], "left").select(F.coalesce("name", "path").alias("name"), "type", "share")
    usual = F.when(F.col("share") >= PRESENT, F.col("type"))
    rows = small_rows(paths.groupBy("name").agg(F.collect_set(usual).alias("types"), F.collect_set("type").alias("rare")), limit, "the table of columns")
    kinds = {r.name: _CASTS.get((r.types or r.rare)[0]) if len(r.types or r.rare) == 1 else None for r in sorted(rows, key=lambda r: r.name)}
    by_file = aliases.groupBy(F.col("file").alias("__file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "name")))).alias("__aliases"))
    picked = df.select(*keep, F.col(value).cast("string").alias("__v"), F.col(file).cast("string").alias("__file")).join(by_file, "__file", "left").select(*keep, "__v", "__aliases")
    fields, seen = df.select(*keep).schema.fields, Counter(k.lower() for k in keep)
    columns = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields]
    for name, kind in [*kinds.items(), ("rest", None)]:
        seen[name.lower()] += 1
        shown = name if seen[name.lower()] == 1 else f"{name}#{seen[name.lower()]}"
        columns.append(f"`{shown.replace('`', '``')}` {kind or 'string'}")
    return picked.mapInArrow(_unify(len(keep), kinds), ", ".join(columns))
