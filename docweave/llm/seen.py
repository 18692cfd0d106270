"""Has this key been seen before?

Keys are reduced to 128-bit digests of their canonical form and spread over
shards, as many as the rows need; in each shard a scalable Bloom chain answers
them in order of arrival. Only the chain is kept, never the earlier keys; its
state can be stored and carried on by a later run. Within its shard each row
also knows whether its digest came earlier, from a sort that can spill, so
positive answers are checked where they are and the rate of wrong ones is
known without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.canonical import canonical_json, digest
from docweave.llm.bloom import BloomChain
from docweave.session import staged

#: Where a row comes from, in order of arrival: filter state, keys of earlier runs (for the check only), known keys, writes.
_STATE, _HISTORY, _KNOWN, _WRITE = range(4)
_KEYS = "seq long, slot int, h binary, repeat boolean"
_STATE_COLUMNS = "layer int, piece int, capacity long, error double, n_keys long, n_set long, bits binary"
_ANSWERS = f"origin int, seq long, shard int, h binary, kind string, earlier boolean, lead boolean, {_STATE_COLUMNS}"
#: Bytes of a piece of state, and pieces sent at once.
_PIECE, _PIECES = 1 << 17, 256
#: Spellings remembered per task before the memo is emptied.
_MEMO = 200_000
#: Rows of one shard; the number of shards follows from it, and is at least ``_LEAST_SHARDS``.
_SHARD_ROWS, _LEAST_SHARDS = 400_000, 8
#: A key with more rows than this in one Arrow batch is hot: its first row alone goes on to the shard.
_HOT = 16


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def key_digest(part: str | None, key: str) -> bytes:
    """Digest of a key in its part; equal for all spellings of one key."""
    return digest(f"{'~' if part is None else f'{len(part)}:{part}'}|{canonical_json(key)}")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict = {}
    for batch in batches:
        if len(memo) > _MEMO:
            memo.clear()
        hs = []
        for part, key in zip(batch["part"], batch["k"]):
            h = memo.get((part, key))
            if h is None:
                h = memo[part, key] = key_digest(part, key)
            hs.append(h)
        out = pd.DataFrame({"seq": batch["seq"], "h": pd.Series(hs, dtype=object)})
        by = out.groupby("h", sort=False)["seq"]
        # a hot key would fill its shard: rows after its first one of the batch are known at once
        out["repeat"] = (by.transform("size") > _HOT) & (out["seq"] > by.transform("min")) if len(out) else False
        out["slot"] = [int.from_bytes(h[:4], "little", signed=True) for h in hs]
        yield out[_names(_KEYS)]


def keyed(df: DataFrame, seq: str | None, part: str, key: str) -> DataFrame:
    """``seq, slot, h, repeat`` of each row with a key; known keys have no order."""
    at = F.lit(0).cast("long") if seq is None else F.col(seq).cast("long")
    rows = df.select(at.alias("seq"), F.col(part).cast("string").alias("part"), F.col(key).cast("string").alias("k"))
    return rows.where("seq IS NOT NULL AND k IS NOT NULL").mapInPandas(_digests, _KEYS)


def _ask(capacity: int, bound: float, growth: int, tightening: float, keep_state: bool, block_rows: int):
    columns = _names(_ANSWERS)

    def state_of(chain: BloomChain | None, shard: int) -> Iterator[pd.DataFrame]:
        rows = list(chain.pieces(_PIECE)) if chain is not None and keep_state else []
        for at in range(0, len(rows), _PIECES):
            yield pd.DataFrame(rows[at : at + _PIECES]).assign(origin=_STATE, shard=shard, kind="state").reindex(columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, chain = None, None
        for batch in batches:
            if not len(batch):
                continue
            cuts = np.union1d(np.flatnonzero(np.diff(batch["shard"].to_numpy())) + 1, np.arange(block_rows, len(batch), block_rows))
            for block in np.split(np.arange(len(batch)), cuts):
                own = batch.iloc[block]
                if own["shard"].iloc[0] != shard:
                    yield from state_of(chain, shard)
                    shard, chain = int(own["shard"].iloc[0]), BloomChain(capacity, bound, growth, tightening)
                origin = own["origin"].to_numpy()
                if origin[0] == _STATE:
                    for r in own[origin == _STATE][_names(_STATE_COLUMNS)].itertuples(index=False):
                        chain.restore(int(r.layer), int(r.piece), int(r.capacity), float(r.error), int(r.n_keys), int(r.n_set), r.bits, _PIECE)
                if origin[0] <= _HISTORY:
                    own, origin = own[origin > _HISTORY], origin[origin > _HISTORY]
                    if not len(own):
                        continue
                words = np.frombuffer(b"".join(own["h"]), np.uint64).reshape(-1, 2)
                again = pd.DataFrame(words).duplicated().to_numpy()
                known = np.zeros(len(own), bool)
                for rows in (np.flatnonzero(~again), np.flatnonzero(again)):  # repeats within the block are asked when their first row is in
                    h1, h2 = words[rows, 0], words[rows, 1]
                    known[rows] = chain.contains(h1, h2)
                    chain.add(h1[~known[rows]], h2[~known[rows]])
                written = origin == _WRITE
                out = own[written] if not written.all() else own
                yield out.assign(kind=np.where(known, "filter", "new")[written]).reindex(columns=columns)
        yield from state_of(chain, shard)

    return run


class SeenKeys:
    """Answers of the Bloom chains for a stream of keyed rows.

    ``answers`` has ``seq, shard, h, kind, earlier, lead`` for each row but
    the repeats of a hot key within one batch: ``kind`` is ``new`` or
    ``filter`` (the chain says the key is known), ``earlier`` whether an
    earlier row at hand has the same digest, ``lead`` whether it is the first
    one at hand. ``state`` is what a later run needs to carry on and
    ``history`` the digests that it may check against; both lie in tables, a
    task holds the chain of one shard. ``capacity`` is that of the first
    layer of a shard; rows are asked and added in blocks of ``block_rows``.
    Without ``shards`` their number follows from the rows, or is that of the
    ``state``.

    With ``state`` and no ``history`` the earlier keys aren't at hand: what
    the chain takes for known, and no earlier row of this run shows, is
    reported as such but can't be checked; it is counted as unverified, and
    only the bound of the chain speaks for it.
    """

    def __init__(
        self,
        writes: DataFrame,
        known: DataFrame | None = None,
        state: DataFrame | None = None,
        seq: str = "seq",
        part: str = "coll",
        key: str = "k",
        shards: int | None = None,
        capacity: int = 1024,
        bound: float = 1e-3,
        growth: int = 2,
        tightening: float = 0.5,
        keep_state: bool = True,
        block_rows: int = 4096,
        history: DataFrame | None = None,
    ):
        self.bound, self.resumed, self.checkable = bound, state is not None, state is None or history is not None
        self.keys = staged(keyed(writes, seq, part, key), "keys")
        rows = self.keys.where("NOT repeat").select(F.lit(_WRITE).alias("origin"), "seq", "slot", "h")
        if known is not None:
            held = staged(keyed(known, None, part, key).where("NOT repeat"), "known")
            rows = rows.unionByName(held.select(F.lit(_KNOWN).alias("origin"), "seq", "slot", "h"))
        held_shards = state.agg(F.max("n_shards")).first()[0] if state is not None else None
        # counted from the footers of what was written
        self.shards = held_shards or shards or max(_LEAST_SHARDS, -(-rows.count() // _SHARD_ROWS))
        shard = F.pmod(F.col("slot"), F.lit(self.shards)).alias("shard")
        rows = rows.select("origin", "seq", shard, "h")
        if history is not None:
            rows = rows.unionByName(history.select(F.lit(_HISTORY).alias("origin"), F.lit(0).cast("long").alias("seq"), "h", "shard"))
        if state is not None:
            rows = rows.unionByName(state.select(F.lit(_STATE).alias("origin"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("h"), "shard", *_names(_STATE_COLUMNS)), allowMissingColumns=True)
        same = Window.partitionBy("shard", "h").orderBy("origin", "seq")
        first = F.struct(F.first("origin").over(same).alias("origin"), F.first("seq").over(same).alias("seq"))
        # both sorts stay within the partition of the shard
        placed = rows.repartitionById(self.shards, F.col("shard")).withColumn("first", first).withColumn("lead", F.row_number().over(same) == 1)
        earlier = (F.col("first.origin") < _WRITE) | (F.col("first.seq") < F.col("seq"))
        ordered = placed.withColumn("earlier", earlier).drop("first").sortWithinPartitions("shard", "origin", "seq", *(["layer", "piece"] if state is not None else []))
        self._out = staged(ordered.mapInPandas(_ask(capacity, bound, growth, tightening, keep_state, block_rows), _ANSWERS), "answers")
        self._before = [df.select("shard", "h") for df in (history, held.select(shard, "h") if known is not None else None) if df is not None]

    @property
    def answers(self) -> DataFrame:
        return self._out.where("kind != 'state'").select("seq", "shard", "h", "kind", "earlier", "lead")

    @property
    def state(self) -> DataFrame:
        return self._out.where("kind = 'state'").select("shard", F.lit(self.shards).alias("n_shards"), *_names(_STATE_COLUMNS))

    @property
    def history(self) -> DataFrame:
        """``shard, h``: the digests of the rows of this run, of its known keys and of the history it was given."""
        own = self.answers.where("lead").select("shard", "h")
        return reduce(DataFrame.unionByName, self._before, own)

    def checked(self) -> DataFrame:
        """The rows that the chain took for known, with ``right``: whether they are, null if that can't be told."""
        unsure = F.when(~F.col("lead") | F.lit(self.checkable), False)
        return self.answers.where("kind = 'filter'").withColumn("right", F.when(F.col("earlier"), True).otherwise(unsure))

    def found(self, exact: bool = True) -> DataFrame:
        """``seq`` of the rows whose key was used before.

        Positive answers known to be wrong are left out if ``exact``.
        """
        sure = self.keys.where("repeat").select("seq")
        positive = self.checked().where(F.coalesce("right", F.lit(True)) if exact else F.lit(True))
        return sure.unionAll(positive.select("seq"))

    def rate(self) -> DataFrame:
        """``n_new, n_wrong, wrong_rate, error_bound, n_layers, n_unverified``: one row.

        Wrong answers are new keys taken for known ones; the other kind
        doesn't occur, since the chain never forgets. ``n_new`` are the new
        keys, those wrongly answered among them.
        """
        wrong = (F.col("kind") == "filter") & F.col("lead") & ~F.col("earlier")
        counts = self._out.agg(
            F.count_if(F.col("kind") == "new").alias("n_right"),
            F.count_if(wrong).alias("n_open"),
            F.coalesce(F.max("layer") + 1, F.lit(0)).cast("long").alias("n_layers"),
        )
        zero = F.lit(0).cast("long")
        n_wrong, n_unverified = (F.col("n_open"), zero) if self.checkable else (zero, F.col("n_open"))
        sums = counts.select((F.col("n_right") + n_wrong).alias("n_new"), n_wrong.alias("n_wrong"), "n_layers", n_unverified.alias("n_unverified"))
        return sums.select("n_new", "n_wrong", F.coalesce(F.try_divide("n_wrong", "n_new"), F.lit(0.0)).alias("wrong_rate"), F.lit(self.bound).alias("error_bound"), "n_layers", "n_unverified")


def seen_before(writes: DataFrame, known: DataFrame | None = None, **options) -> DataFrame:
    """``seq`` of each row whose key is in ``known`` or in a row of smaller ``seq``.

    Keys are extended JSON in ``k``, compared within ``coll`` by value.
    A null key is never known; a null ``coll`` is a collection of its own;
    a key that isn't JSON equals only the same text; a row without ``seq``
    has no place in the order and is left out; rows of equal ``seq`` aren't
    earlier than each other. Further columns are ignored; an empty table
    gives an empty result.
    """
    return SeenKeys(writes, known, keep_state=False, **options).found()
