"""Session settings, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A stored table of at most so many bytes on disk may be broadcast; in memory it is some times that.
STORED_LIMIT = 8 << 20

_OWN_DIR: dict[str, str] = {}
_MARKED: set[str] = set()
_SCOPES: list[list[str]] = []


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on, in UTC."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], True)
    return _OWN_DIR[app]


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; nothing is there yet. All of an application's are deleted when it ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/quern-{app}"
    if root not in _MARKED:
        fs, p = _file_system(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MARKED.add(root)
    path = f"{root}/{label}-{uuid.uuid4().hex[:12]}"
    for s in _SCOPES:
        s.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever was stored inside; results must have been written elsewhere or collected by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for x in paths:
            fs, p = _file_system(spark, x)
            fs.delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` stored and that nothing reads any more, as an iteration's last state."""
    for t in tables:
        path = getattr(t, "_quern_path", None)
        if path:
            fs, p = _file_system(t.sparkSession, path)
            fs.delete(p, True)


def materialize(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Lineage is cut, the table survives the loss of any executor, and a plan that uses
    it twice doesn't compute it twice.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def stored_bytes(table: DataFrame) -> int:
    """Bytes on disk of a stored table, as its file listing has them."""
    return int(table._jdf.queryExecution().analyzed().stats().sizeInBytes())


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = 100_000, base: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its row count is checked to be small, else ``df`` as it is.

    ``base`` is a stored table with at least as many rows, for instance the dimension that ``df`` filters or
    enriches. Then the size of its files is checked instead, which needs no job.
    """
    small = stored_bytes(base) <= STORED_LIMIT if base is not None else small_enough(df, limit)
    return F.broadcast(df) if small else df
