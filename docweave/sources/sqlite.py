"""A data source for SQLite files with a table of keys and documents."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docweave.functions import ejson
from docweave.functions.order import sort_key


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """``format("docweave_sqlite")`` with ``path``, ``table`` and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "docweave_sqlite"

    def schema(self) -> str:
        return "seq long, k string, v string"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "documents")
        self.n = int(options.get("partitions", "8"))
        if not self.table.isidentifier():
            raise ValueError(f"{self.table!r} is no table name")

    def partitions(self) -> list[InputPartition]:
        connection = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        low, high = connection.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        connection.close()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.n))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        connection = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from connection.execute(f"SELECT rowid, CAST(k AS TEXT), CAST(v AS TEXT) FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
        finally:
            connection.close()


def read_table(spark: SparkSession, path: str, table: str = "documents", partitions: int = 8) -> DataFrame:
    """``seq, k, v`` of a table, read in ranges of row numbers."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("docweave_sqlite").option("table", table).option("partitions", partitions).load(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    key = F.udf(lambda text: sort_key(ejson.loads(text).get("_id")), "binary", useArrow=True)
    return read_table(spark, path).select("seq", key("v").alias("id_key"), F.col("v").alias("doc"))
