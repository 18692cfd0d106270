"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docweave.errors import ConfigurationError

_STAGED: list[tuple[SparkSession, str]] = []


def get_session(app: str = "docweave", **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is named, a temporary one in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else ""
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("name a folder that all executors share in spark.checkpoint.dir")
        path = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one result feeds several branches whose recomputation would
    repeat Python work; unlike a cache it survives the loss of executors. It
    is deleted by ``release``, at the end of a ``scratch`` block or at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    if cluster_by:
        writer = writer.partitionBy(*cluster_by)
    writer.parquet(path)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df``, once nothing reads it any more."""
    at = next((n for n, (_, path) in enumerate(_STAGED) if path == df._staged_at), None)
    if at is not None:
        _STAGED.append(_STAGED.pop(at))
        release_staged(len(_STAGED) - 1)


@contextmanager
def scratch() -> Iterator[None]:
    """A block at whose end all that was staged in it is deleted; its results have to be read or written by then."""
    held = len(_STAGED)
    try:
        yield
    finally:
        release_staged(held)


def release_staged(keep: int = 0) -> None:
    """Delete what ``staged`` wrote, all but the first ``keep``; runs at exit too."""
    while len(_STAGED) > keep:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            pass


atexit.register(release_staged)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, where they couldn't by themselves.

    They can if its folder is on PYTHONPATH or, where they share the
    driver's process, the working directory.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.master == "local" or context.master.startswith("local["):
        known.append(os.getcwd())
    if root in map(os.path.abspath, filter(None, known)) or "site-packages" in root or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    # read by the driver only, which serves it to the executors
    archive = os.path.join(tempfile.mkdtemp(prefix="docweave-"), "docweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "docweave")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by nature; refuses one beyond ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
