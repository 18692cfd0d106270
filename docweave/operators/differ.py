"""Differences between two copies of a keyed set of JSON documents.

Both copies are normalised (one digest per document, one per top-level
field), EXCEPT ALL in both directions leaves the residues, and a full join
of the residues by key lists one-sided rows and differing fields.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.canonical import Fields, canonical, digest, parse, printable
from docweave.session import staged

_NORMAL = "row_no long, part string, id_digest binary, v_digest binary, fields map<string,binary>"
#: Names under which a ``v`` that is no JSON object is compared as a whole.
NOT_JSON, NOT_OBJECT = "$text", "$value"


def document_fields(text: str | None) -> dict[str, bytes]:
    """Digest of each top-level field; the last one of a repeated name counts."""
    if text is None:
        return {}
    try:
        value = parse(text)
    except ValueError:
        return {NOT_JSON: digest("!" + text)}
    if type(value) is not Fields:
        return {NOT_OBJECT: digest(canonical(value))}
    return {printable(k): digest(canonical(v)) for k, v in value}


def _id_digest(text: str | None) -> bytes | None:
    if text is None:
        return None
    try:
        return digest(canonical(parse(text)))
    except ValueError:
        return digest("!" + text)


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fields = [document_fields(v) for v in batch["v"]]
        yield pd.DataFrame(
            {
                "row_no": batch["row_no"],
                "part": batch["part"],
                "id_digest": [_id_digest(k) for k in batch["id"]],
                "v_digest": [
                    digest(("x" if v is None else "") + "".join(f"{len(k)}:{k}{d.hex()}" for k, d in sorted(f.items())))
                    for f, v in zip(fields, batch["v"])
                ],
                "fields": fields,
            }
        )


def normalised(df: DataFrame, row: str, part: str, key: str, value: str) -> DataFrame:
    """``row_no, part, id_digest, v_digest, fields`` of a copy."""
    picked = df.select(
        F.col(row).cast("long").alias("row_no"),
        F.col(part).cast("string").alias("part"),
        F.col(key).cast("string").alias("id"),
        F.col(value).cast("string").alias("v"),
    )
    return picked.mapInPandas(_normalise, _NORMAL)


#: Neighbouring row numbers that are ordered in one task where some key is repeated in more rows than that.
_BLOCK_BITS = 16


def _numbered(rows: DataFrame, keys: list[str], name: str, hot: bool) -> DataFrame:
    """``rows`` with their place among those of equal ``keys``, by row number.

    If ``hot``, rows are ordered within blocks of row numbers only and the
    sizes of the blocks before are added, so a key with a third of all rows
    is spread; the places are the same.
    """
    if not hot:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("row_no")))
    block = F.coalesce(F.shiftright("row_no", _BLOCK_BITS), F.lit(-(2**62)))
    blocks = rows.groupBy(*keys, block.alias("block")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), *[F.col(k).alias(f"__{k}") for k in keys])
    placed = rows.withColumn("__block", block).withColumn(name, F.row_number().over(Window.partitionBy(*keys, "__block").orderBy("row_no")))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = placed.join(offsets, reduce(lambda x, y: x & y, on, F.col("__block") == F.col("block")))
    return joined.select(*rows.columns, (F.col(name) + F.col("offset")).alias(name))


def _residue(own: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``own`` without an equal partner, numbered within their key.

    EXCEPT ALL works on counts of (part, id, digest), so copies of one row
    collapse before the shuffle; the rows themselves are fetched only for
    the digests that are left over. Of equal rows the first stay.
    """
    cols = ["part", "id_digest", "v_digest"]
    left = own.select(cols).exceptAll(other.select(cols)).groupBy(cols).count().withColumnRenamed("count", "spare")
    same = [own[c].eqNullSafe(left[c]) for c in cols]
    rows = staged(own.join(left, same[0] & same[1] & same[2]).select(own["*"], "spare"), "residue")
    largest = rows.groupBy(cols[:2]).count().agg(F.max("count")).first()[0] or 0
    hot = largest > 1 << _BLOCK_BITS
    spare = _numbered(rows, cols, "nth", hot).where("nth <= spare").drop("nth", "spare")
    return _numbered(staged(spare, "spare") if hot else spare, cols[:2], "turn", hot)


def _unequal_fields(a: Column, b: Column) -> Column:
    names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.filter(names, lambda n: ~F.element_at(a, n).eqNullSafe(F.element_at(b, n)))


def diff_copies(a: DataFrame, b: DataFrame, a_row: str = "a_row", b_row: str = "b_row", part: str = "coll", key: str = "_id", value: str = "v") -> DataFrame:
    """``a_row, b_row, field_name``: how copy ``b`` differs from copy ``a``.

    A document on one side only gives one row with -1 for the other side and
    an empty field name; a document on both sides gives a row for each
    top-level field that is missing on one side or unequal. Order of
    top-level fields and JSON spelling don't count; a null field differs from
    a missing one. A null ``v`` has no fields: it equals a null ``v`` and
    differs from every other in all the fields of that one (and, against an
    empty object, under the name ``$value``). ``v`` that isn't JSON, or isn't
    an object, is compared whole under ``$text`` or ``$value``. Null keys
    match each other. If a key is repeated, equal rows cancel out one by one
    and the rest are paired in order of row number. Columns other than those
    named are ignored, so clashing names do no harm; empty copies give only
    one-sided rows.
    """
    na = staged(normalised(a, a_row, part, key, value), "copy-a")
    nb = staged(normalised(b, b_row, part, key, value), "copy-b")
    ra, rb = _residue(na, nb).alias("ra"), _residue(nb, na).alias("rb")
    on = F.col("ra.part").eqNullSafe(F.col("rb.part")) & F.col("ra.id_digest").eqNullSafe(F.col("rb.id_digest")) & (F.col("ra.turn") == F.col("rb.turn"))
    both = F.col("ra.row_no").isNotNull() & F.col("rb.row_no").isNotNull()
    names = _unequal_fields(F.col("ra.fields"), F.col("rb.fields"))
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(NOT_OBJECT)))
    return ra.join(rb, on, "full").select(
        F.coalesce("ra.row_no", F.lit(-1)).cast("long").alias("a_row"),
        F.coalesce("rb.row_no", F.lit(-1)).cast("long").alias("b_row"),
        F.explode(F.when(both, names).otherwise(F.array(F.lit("")))).alias("field_name"),
    )


def diff_summary(found: DataFrame) -> DataFrame:
    """``kind, field_name, documents`` of a difference list."""
    kind = F.when(F.col("b_row") == -1, "only_a").when(F.col("a_row") == -1, "only_b").otherwise("field")
    return found.groupBy(kind.alias("kind"), "field_name").agg(F.count("*").alias("documents"))
