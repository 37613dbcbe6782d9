"""Places and small helpers that all corpus operators use."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words wherever a contract says ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether a query's shuffle files are deleted at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(spark, "_corvane_dir", None):
        spark._corvane_dir = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(spark._corvane_dir)
    return spark._corvane_dir


#: The paths that each open ``tidied`` block has made.
_made: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """Deletes the tables that were made within once it ends; results are written before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there.

    The table stands for all that made it, so the write's shuffle files go as soon as it is done. With keep it
    outlives the ``tidied`` block it is made in.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if keep and _made:
        _made[-1].remove(path)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``settled``, dealt by the key into as many buckets as a shuffle has partitions: what groups it by the key later moves no row of it."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, name)
    table = re.sub(r"\W", "_", path.rpartition("/")[2])
    spark.sql(f"CREATE TABLE {table} ({', '.join(f'`{c}` {t}' for c, t in df.dtypes)}) USING parquet CLUSTERED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        df.repartition(n, key).write.insertInto(table)
    finally:
        spark.conf.set(RELEASE, before)
    out = spark.table(table)
    out.schema  # resolved; the catalog needn't know the table any longer, its files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column needs; Spark doesn't tell cases apart."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def one_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, hash of the text) is among ``kept`` (doc_id, t), one for each: equal rows are told apart by a number of their own. docs may have any other columns."""
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    hashed, kept_id, kept_t, again_id, again_t, row, how_often = unused(docs.columns, "_hash", "_kept_id", "_kept_t", "_again_id", "_again_t", "_row", "_often")
    kept = settled(kept.select(F.col("doc_id").alias(kept_id), F.col("t").alias(kept_t)).distinct(), "kept")
    rows = docs.withColumn(hashed, t)
    same = lambda i, h: (F.col(hashed) == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i))
    rows = rows.join(kept, same(kept_id, kept_t), "left_semi")
    keys = docs.select(F.col("doc_id").cast("long").alias(again_id), t.alias(again_t)).groupBy(again_id, again_t).agg(F.count("*").alias(how_often)).filter(F.col(how_often) > 1).drop(how_often)
    again = settled(keys.join(kept, (F.col(again_t) == F.col(kept_t)) & F.col(again_id).eqNullSafe(F.col(kept_id)), "left_semi"), "again")
    if again.isEmpty():
        return rows.drop(hashed)
    # a repeated row moves; all of its columns are one value for the choice
    repeated = rows.join(again, same(again_id, again_t), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = repeated.groupBy("doc_id", hashed).agg(F.first(whole).alias(row)).select(f"{row}.*")
    return rows.join(again, same(again_id, again_t), "left_anti").drop(hashed).unionByName(one)


def told_apart(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """A written table's rows with their number among those with equal keys, from 0; which of these has which number is left open.

    Rows of a key that repeats are counted by the task that wrote them (column ``pid``), then numbered after what other tasks
    have, so a key of any size stays dealt over tasks. Keys that don't repeat move as counts alone.
    """
    again = settled(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "again")
    if again.isEmpty():
        return rows.withColumn(number, F.lit(0).cast("long"))
    same = lambda a, b: _every(a[k].eqNullSafe(b[k]) for k in keys)
    own = rows.join(again, same(rows, again), "left_semi")
    counts = own.groupBy(*keys, "pid").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = settled(counts.select(*keys, "pid", before.alias("_before")), "again-before")
    inner = own.withColumn("_i", F.row_number().over(Window.partitionBy("pid", *keys).orderBy(*keys)) - 1)
    told = inner.join(before, same(inner, before) & (inner["pid"] == before["pid"])).select(*[inner[c] for c in rows.columns], (F.col("_i") + F.col("_before")).alias(number))
    alone = rows.join(again, same(rows, again), "left_anti").withColumn(number, F.lit(0).cast("long"))
    return alone.unionByName(told)


def _every(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def ascii_lower(text: Column | str) -> Column:
    """Null is empty; only A-Z change."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
