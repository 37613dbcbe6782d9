"""Sources beyond files: increments over JDBC, paged JSON over HTTP, demo records; single files as sinks."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.sources.records import RECORD_SCHEMA, read_json

# What stands in where no demo file is found.
DEMO = [
    ("CT-001", "commercial_taxes", "UBIQUITY INNOVATIONS PVT LTD", "AAAA0001A", "29AAAA0001A1Z5", "Bangalore Urban", "560001"),
    ("FB-001", "factories_board", "UBIQUITY INNOVATIONS PRIVATE LIMITED", "AAAA0001A", None, "Bangalore Urban", "560001"),
    ("SE-001", "shops_establishments", "UBIQUITY INNOVATIONS", "AAAA0001A", None, "Bangalore Urban", "560001"),
]


def jdbc_increment(spark: SparkSession, url: str, table: str, stamp: str, key: str | None = None, since: str | None = None, since_key: int | None = None, parts: int = 8, **options: str) -> DataFrame:
    """Rows newer than ``since`` by a timestamp column, then by an incrementing one where stamps tie; the database filters, and reads are dealt over the key's range."""
    where = "1 = 1"
    if since is not None:
        where = f"{stamp} > TIMESTAMP('{since}')" if key is None or since_key is None else f"({stamp} > TIMESTAMP('{since}') OR ({stamp} = TIMESTAMP('{since}') AND {key} > {int(since_key)}))"
    source = f"(SELECT * FROM {table} WHERE {where}) x"
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is not None:
        low, high = reader.option("dbtable", f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table} WHERE {where}) y").load().first()
        if low is not None and high > low:
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.option("dbtable", source).load()


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedSource(DataSource):
    """``spark.read.format("paged_json")``: pages of a REST endpoint, each an array of objects, read in parallel.

    Options: url, pages (how many), size (rows of a page), token (sent as bearer), timeout in seconds. Page numbers begin at 1.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Page(i + 1) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        mark = "&" if "?" in self.options["url"] else "?"
        request = urllib.request.Request(f"{self.options['url']}{mark}page={partition.number}&size={self.options.get('size', 100)}", headers={"Accept": "application/json"})
        if self.options.get("token"):
            request.add_header("Authorization", f"Bearer {self.options['token']}")
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 30))) as answer:
            for row in json.load(answer):
                yield partition.number, json.dumps(row)


def paged(spark: SparkSession, url: str, pages: int, schema: str, **options: str) -> DataFrame:
    """Rows of all pages; an object that doesn't fit the schema has nulls."""
    spark.dataSource.register(PagedSource)
    raw = spark.read.format("paged_json").options(url=url, pages=str(pages), **options).load()
    return raw.select("page", F.from_json("payload", schema).alias("x")).select("page", "x.*")


def demo_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the demo file, or three fixed ones where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return read_json(spark, path)
    given = spark.createDataFrame(DEMO, "record_id string, department string, business_name string, pan string, gstin string, district string, pincode string")
    return given.select(*[F.col(c.split()[0]) if c.split()[0] in given.columns else F.lit(None).cast("string").alias(c.split()[0]) for c in RECORD_SCHEMA.split(", ")])


def payload_hash(payload):
    """SHA-256 of a JSON payload with its keys in order, as Python writes it; distinct payloads are hashed once a batch."""
    @F.pandas_udf("string")
    def hashed(x: pd.Series) -> pd.Series:
        once = {v: hashlib.sha256(json.dumps(json.loads(v), sort_keys=True).encode()).hexdigest() for v in x.dropna().unique()}
        return x.map(once.get).astype(object).where(x.notna(), None)

    return hashed(payload)


def write_single(df: DataFrame, path: str, banner: str | None = None) -> None:
    """A CSV export as one file in the folder ``path``, after a banner line and an empty one. Exports are results small enough to hand out."""
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns])
    rows = df.select(F.lit(1).alias("k"), line.alias("value"))
    head = [banner, ""] if banner else []
    top = df.sparkSession.createDataFrame([(i - len(head) - 1, v) for i, v in enumerate([*head, ",".join(df.columns)])], "k int, value string")
    top.unionByName(rows).coalesce(1).sortWithinPartitions("k", "value").select("value").write.text(path)


def write_object(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON object with an array of rows for each part, as one file in the folder ``path``."""
    whole = None
    for name, df in parts.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        whole = one if whole is None else whole.crossJoin(one)  # one row each
    whole.select(F.to_json(F.struct(*whole.columns)).alias("value")).coalesce(1).write.text(path)
