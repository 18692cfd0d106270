"""The query language on streams.

A compiled filter or projection is a tree of plain columns, so it works on a
streaming table as it stands; there is no state to keep.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docweave.compat import DEFAULT, CompatProfile
from docweave.plans.reshape import project
from docweave.plans.typed import Typed
from docweave.session import shared_dir


def find_stream(stream: DataFrame, filter: dict | None = None, projection=None, compat: CompatProfile = DEFAULT) -> DataFrame:
    """Matching rows of a stream, projected."""
    out = stream.where(Typed(stream.schema, compat).filter(filter).pos) if filter else stream
    return out if projection is None else project(out, projection, filter, compat)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and read its result.

    Progress and result lie in the shared folder, so a restart after the
    loss of an executor goes on where it was.
    """
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
