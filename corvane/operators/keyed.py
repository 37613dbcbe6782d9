"""Keyed tables whose keys are kept unique when they are written, and logs that only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import tables

from .console import upserted


class DuplicateKey(ValueError):
    """Rows that would give a key a second time."""


class KeyedTable:
    """Versions of a table below a path; each key is there once. A version is whole once its _SUCCESS file is written; readers take the latest whole one.

    ``update``: the columns that change where a key is known; null: all others. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], update: list[str] | None = None):
        self.spark, self.path, self.keys = spark, path, keys
        self.empty = spark.createDataFrame([], schema)
        self.update = [c for c in self.empty.columns if c not in keys] if update is None else update

    def versions(self) -> list[int]:
        return sorted(int(f.rpartition("/v")[2][:6]) for f, *_ in tables.state_of(self.spark, self.path) if f.endswith("/_SUCCESS"))

    def current(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.empty
        return self.spark.read.schema(self.empty.schema).parquet(f"{self.path}/v{known[-1] if version is None else version:06d}")

    def put(self, rows: DataFrame, merge: bool = True) -> int:
        """Writes the next version with the rows and returns its number. merge=False: a known key is an error; a key that the rows give twice or a null one always is, and nothing is written."""
        rows = tables.settled(rows.select(self.empty.columns), "keyed-rows")
        bad = rows.filter(F.expr(" or ".join(f"`{k}` is null" for k in self.keys))).limit(1).count()
        twice = rows.groupBy(*self.keys).count().filter("count > 1").limit(1).count()
        now = self.current()
        known = 0 if merge else now.join(rows.select(*self.keys), self.keys, "left_semi").limit(1).count()
        if bad or twice or known:
            raise DuplicateKey("a null key" if bad else "a key is given twice" if twice else "a key is known already")
        version = max(self.versions(), default=0) + 1
        upserted(now, rows, self.keys, self.update).write.mode("overwrite").parquet(f"{self.path}/v{version:06d}")
        return version


def registry(spark: SparkSession, path: str) -> dict[str, KeyedTable]:
    """The three tables with unique keys: records by department and id, UBIDs, evidence by pair."""
    return {
        "records": KeyedTable(spark, f"{path}/records", "department string, record_id string, business_name string, status string", ["department", "record_id"], ["business_name", "status"]),
        "ubids": KeyedTable(spark, f"{path}/ubids", "ubid string, status string, merged_into string, record_count long", ["ubid"]),
        "evidence": KeyedTable(spark, f"{path}/evidence", "pair_id string, confidence double, decision string", ["pair_id"]),
    }


def appended(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The log after the rows have been added to it."""
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
