"""Exact deduplication by streaming over keyed state on disk.

A stream over the documents' digests keeps, for each digest and without expiry, the largest doc_id, its
content locator and the group's size in a RocksDB state store below the shared folder. Hits are then
compared with their keeper byte by byte; should a digest ever join different texts, its rows are grouped
by the text itself. Null text is empty; of rows with one doc_id any stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, one_each, scratch, settled

#: State lies on disk; a partition's store is closed once it has committed, so few are open at a time.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def keyed_state(digests: DataFrame, path: str) -> DataFrame:
    """digest -> (keep_id, group_size), from a stream over the table of digests at ``path``."""
    spark = digests.sparkSession
    out, checkpoint = scratch(spark, "dedup-state"), scratch(spark, "dedup-stream")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(digests.schema).parquet(path).groupBy("digest")
            .agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("order"), "doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
        )
        (
            state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch:06d}"))
            .start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, keep struct<order:bigint,doc_id:bigint,locator:string>, group_size long, batch int"
    try:
        found = spark.read.schema(schema).parquet(f"{out}/*")
    except Exception as e:  # an empty input makes no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], schema)
    latest = found.groupBy("digest").agg(F.max(F.struct("batch", "keep", "group_size")).alias("s"))
    return latest.select("digest", F.col("s.keep.doc_id").alias("keep_id"), F.col("s.keep.locator").alias("keep_locator"), F.col("s.group_size").alias("group_size"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, t (the text's hash), keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = ascii_lower("text")
    path = scratch(spark, "dedup-digests")
    raw = F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), raw, F.input_file_name().alias("locator")).write.parquet(path)
    schema = "doc_id long, digest string, t long, locator string"
    digests = spark.read.schema(schema).parquet(path)
    state = settled(keyed_state(digests, path), "dedup-groups")
    hits = state.filter("group_size > 1")
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw, text.alias("full")).withColumn("digest", F.sha2("full", 256))
    # all texts move once; what follows has those of the hits alone
    full = settled(full.join(hits.select("digest", "keep_id"), "digest"), "dedup-hits")
    keepers = full.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("full").alias("kept_full"))
    keepers = settled(keepers, "dedup-keepers")  # so that the join below reads plain shuffles and a large group can be split
    full = full.drop("keep_id")
    differs = full.join(keepers, "digest").filter(F.col("full") != F.col("kept_full")).select("digest")
    if differs.isEmpty():
        rows = digests.join(state, "digest")
    else:
        differs = differs.distinct()
        again = full.join(differs, "digest").groupBy("digest", "full").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = full.join(again, ["digest", "full"]).select("digest", "doc_id", "t", "keep_id", "group_size")
        rows = digests.join(state, "digest").join(differs, "digest", "left_anti").select("digest", "doc_id", "t", "keep_id", "group_size").unionByName(apart)
    return rows.select("doc_id", "t", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """Of rows with equal texts the one that stays, with its own columns: of the largest doc_id, of these the text with the least hash."""
    kept = exact_groups(docs).filter("kept").groupBy("doc_id", "text_sha256").agg(F.min("t").alias("t"))
    return one_each(docs, kept.select("doc_id", "t"))
