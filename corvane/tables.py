"""Tables in the folder that driver and executors share: what cuts lineage, is read more than once, or outlives a query."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are deleted at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The paths that each open ``tidied`` block has made.
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may do without the setting, it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(spark, "_corvane_dir", None):
        spark._corvane_dir = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return spark._corvane_dir


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """Deletes the tables that were made within, but for those to keep, once it ends; results are written before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            deleted(spark, path)


def settled(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as a table and read again: its lineage ends there. With keep it outlives the ``tidied`` block it is made in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    if _made and not keep:
        _made[-1].append(path)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, DataFrame] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """The files below a path with their sizes and times of change, as the file system tells them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return ()
    found, todo = [], [where]
    while todo:
        for s in system.listStatus(todo.pop()):
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(found))


def once(spark: SparkSession, name: str, folder: str, sources: tuple[str, ...], build) -> DataFrame:
    """The table that ``build`` gives for the tables of a folder, made once in an application as long as these don't change.

    It lies in the shared folder until the application's folder there is cleared; what else was made on its way is deleted.
    """
    state = tuple(state_of(spark, f"{folder}/{s}.parquet") for s in sources)
    key = (spark.sparkContext.applicationId, name, folder, state)
    if key not in _kept:
        with tidied(spark):
            _kept[key] = settled(build(), name, keep=True)
    return _kept[key]
