"""Streams: department payloads to canonical records, signals to windowed counts and latest status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.normalize import normalised


def json_stream(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of a folder of JSON lines; a malformed line is kept apart and never stops the stream."""
    return _parsed(spark.readStream.text(path).withColumnRenamed("value", "payload"), schema)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 10_000) -> DataFrame:
    """Raw (topic, payload); offsets are kept in the sink's checkpoint."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger)}
    return spark.readStream.format("kafka").options(**options).load().select("topic", F.col("value").cast("string").alias("payload"))


def department_stream(spark: SparkSession, path: str, schema: str, department: str) -> DataFrame:
    return normalised(department, json_stream(spark, path, schema)[0])


#: Topic -> department, schema of its messages.
Topics = dict[str, tuple[str, str]]


def dispatched(messages: DataFrame, topics: Topics, out: str):
    """A query over one stream of (topic, payload) that sends each topic's messages through its department's normaliser.

    Below ``out``, records/<department> and dead/<department> get a folder for each batch. A batch that is run again after a
    failure writes its folder anew, so each message is there once. Unreadable messages and those of unknown topics (department
    ``unknown``) are dead letters. How many messages a batch takes is bounded by the source's options.
    """
    names = {d for d, _ in topics.values()}

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for topic, (department, schema) in topics.items():
                good, bad = _parsed(rows.filter(F.col("topic") == topic), schema)
                normalised(department, good).write.mode("overwrite").parquet(f"{out}/records/{department}/batch={number:09d}")
                bad.write.mode("overwrite").parquet(f"{out}/dead/{department}/batch={number:09d}")
            lost = rows.filter(~F.coalesce(F.col("topic").isin(*topics), F.lit(False))).select("payload")
            lost.write.mode("overwrite").parquet(f"{out}/dead/unknown/batch={number:09d}")
        finally:
            rows.unpersist()

    if len(names) < len(topics):
        raise ValueError("a department has one topic")
    return messages.select("topic", "payload").writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(batch)


def _parsed(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of a column ``payload``."""
    x = messages.withColumn("x", F.from_json("payload", schema))
    empty = F.forall(F.array(*[F.col("x")[c.split()[0].strip("`")].cast("string").isNull() for c in schema.split(", ")]), lambda v: v)
    bad = F.col("x").isNull() | F.coalesce(empty, F.lit(True))
    return x.filter(~bad).select("x.*"), x.filter(bad).select("payload")


def windowed_counts(signals: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return signals.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def latest_status(signals: DataFrame) -> DataFrame:
    """(user_id, event_type, n) after each batch: the latest event of each user and how many were seen, in keyed state."""

    def update(key, batches, state):
        last, kind, n = state.get if state.exists else (0, "", 0)
        for pdf in batches:
            pdf = pd.DataFrame(pdf)
            i = pdf["at"].idxmax()
            if pdf["at"][i] >= last:
                last, kind = int(pdf["at"][i]), str(pdf["event_type"][i])
            n += len(pdf)
        state.update((last, kind, n))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "n": [n]})

    keyed = signals.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_type string, n long", "at long, kind string, n long", "update", "NoTimeout")
