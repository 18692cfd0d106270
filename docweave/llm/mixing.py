"""Mixing sources to target shares by systematic sampling.

Every document of a source is expected in the same number of copies. The
documents of a source are laid out in blocks, by size within a block; the
prefix sums of their expected copies, shifted by one random offset, cross
integers, and a document is emitted once per integer that its own stretch
crosses. So a source gets its number of copies to within one, no document is
used more than the rounded-up number of times, and because neighbours have
like sizes the share in tokens is met closely.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.tokens import SPLIT, VOCABULARY, count_tokens
from docweave.session import small_rows, staged


class Mixture:
    """A mixture of ``docs`` by the shares in ``targets``.

    ``targets`` has ``source, target_share, max_repeats``. ``total`` is the
    size in tokens; by default it is the largest at which every source can
    reach its share within its repeats. With a larger ``total`` the short
    sources are used to their limit and the reported shares show it.
    Sources without tokens are left out and the other shares rescaled, also
    if the shares don't sum to 1. Documents with null text, null source or a
    source without a target are not used; a document without tokens counts
    as size 0. Repeated rows are documents of their own.
    """

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        total: float | None = None,
        seed: int = 0,
        doc: str = "doc_id",
        source: str = "source",
        text: str = "text",
        vocabulary: str = VOCABULARY,
        split: str = SPLIT,
        block_rows: int = 50_000,
        max_sources: int = 10_000,
    ):
        spark = docs.sparkSession
        picked = docs.select(F.col(doc).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where("text IS NOT NULL AND source IS NOT NULL")
        self.sizes = staged(count_tokens(picked, ["doc_id", "source"], "text", vocabulary, split), "sizes")
        wanted = {r.source: r for r in small_rows(targets.select("source", "target_share", "max_repeats"), max_sources, "the table of targets") if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
        sums = self.sizes.where(F.col("source").isin(sorted(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        held = {r.source: r for r in small_rows(sums, max_sources, "the table of sources") if r.tokens}
        scale = sum(wanted[s].target_share for s in held)
        self.shares = {s: wanted[s].target_share / scale for s in held}
        limit = min((held[s].tokens * wanted[s].max_repeats / self.shares[s] for s in held), default=0.0)
        self.total = limit if total is None else float(total)
        draw = random.Random(seed)
        plan = []
        for s in sorted(held):
            most = wanted[s].max_repeats
            plan.append((s, self.shares[s], most, min(float(most), self.total * self.shares[s] / held[s].tokens), draw.random()))
        self.plan = spark.createDataFrame(plan, "source string, share double, most int, rate double, offset double")
        #: Rows a block may have on average; blocks are spread by the document's hash.
        self.blocks = max(1, math.ceil(max((r.docs for r in held.values()), default=0) / block_rows))

    def copies(self) -> DataFrame:
        """``doc_id, source, n_tokens, copies`` of each document that is used."""
        block = F.pmod(F.xxhash64("doc_id"), F.lit(self.blocks))
        # one row per source, at most ``max_sources``: small enough to broadcast
        rows = self.sizes.join(F.broadcast(self.plan), "source").withColumn("block", block)
        counts = rows.groupBy("source", "block").agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")).select("source", "block", "before")
        nth = F.row_number().over(Window.partitionBy("source", "block").orderBy("n_tokens", "doc_id"))
        placed = rows.withColumn("nth", nth).join(before, ["source", "block"]).withColumn("at", F.col("before") + F.col("nth"))
        crossed = F.floor(F.col("offset") + F.col("rate") * F.col("at")) - F.floor(F.col("offset") + F.col("rate") * (F.col("at") - 1))
        return placed.select("doc_id", "source", "n_tokens", F.least(crossed, F.col("most").cast("long")).alias("copies")).where("copies > 0")

    def rows(self) -> DataFrame:
        """``doc_id, source, copy_no, n_tokens``: one row per use of a document."""
        return self.copies().select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy_no"), "n_tokens")

    def report(self) -> DataFrame:
        """``source, target_share, actual_share, n_docs, n_copies, n_tokens, most_copies``."""
        used = self.copies().groupBy("source").agg(
            F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies")
        )
        whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))
        joined = self.plan.select("source", F.col("share").alias("target_share")).join(used, "source", "left").na.fill(0, ["n_docs", "n_copies", "n_tokens", "most_copies"])
        return joined.select("source", "target_share", F.coalesce(F.try_divide("n_tokens", whole), F.lit(0.0)).alias("actual_share"), "n_docs", "n_copies", "n_tokens", "most_copies")
