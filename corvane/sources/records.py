"""Sources: business records derived from the relational tables, activity signals, files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _syllables(x: str) -> str:
    """SQL for a word of three syllables, a consonant and a vowel each, told by a number."""
    pick = lambda letters, n: f"substr('{letters}', CAST({n} AS INT) + 1, 1)"
    parts = [f"floor(({x}) % 262144 / {64**i})" for i in range(3)]
    return " || ".join(f"{pick('BDFKLMNPRSTVZJKR', f'{n} % 16')} || {pick('AEOU', f'floor({n} / 16) % 4')}" for n in parts)


#: The same text in Spark and in the SQL oracle. Words and numbers are made once, below the joins.
RECORDS_SQL = f"""
SELECT src.p || '-' || lpad(CAST(src.k AS STRING), 7, '0') AS record_id, src.department AS department, src.k AS entity_key,
  src.initials || ' ' || CASE WHEN src.p = 'SE' AND src.k % 10 = 3 THEN replace(replace(replace(src.words, 'KA', 'CA'), 'KO', 'CO'), 'KU', 'CU') ELSE src.words END || ' ' || upper(a.p_name)
    || CASE WHEN src.p <> 'CT' AND src.k % 6 = 5 THEN ' TRADERS' WHEN src.p = 'CT' THEN ' PVT LTD' WHEN src.p = 'FB' THEN ' PRIVATE LIMITED' ELSE '' END AS business_name,
  src.word || CASE WHEN src.p = 'SE' THEN ' TRADERS' ELSE ' ' || upper(b.p_name) END AS trade_name,
  CASE WHEN (src.p = 'FB' AND src.k % 5 = 0) OR (src.p = 'SE' AND src.k % 4 = 0) THEN NULL ELSE src.number END AS pan,
  CASE WHEN src.p = 'CT' OR (src.p = 'SE' AND src.k % 8 = 0) THEN '29' || src.number || '1Z' || CAST(src.k % 10 AS STRING) END AS gstin,
  CASE WHEN (src.p = 'CT' AND src.k % 5 < 3) OR (src.p = 'SE' AND src.k % 5 = 0) THEN 'UDYAM-KA-' || lpad(CAST(src.k % 100 AS STRING), 2, '0') || '-' || lpad(CAST(src.k AS STRING), 7, '0') END AS udyam_number,
  CASE WHEN src.p = 'SE' AND src.k % 9 = 0 THEN 'Proprietorship' ELSE CASE src.k % 7 WHEN 0 THEN 'Private Limited Company' WHEN 1 THEN 'Proprietorship' WHEN 2 THEN 'Partnership' WHEN 3 THEN 'LLP' WHEN 4 THEN 'Public Limited Company' WHEN 5 THEN 'One Person Company' ELSE 'HUF' END END AS legal_status,
  CASE WHEN src.p = 'FB' THEN 'Manufacturing' WHEN src.p = 'SE' AND src.k % 2 = 0 THEN 'Retail Trade' ELSE 'Wholesale Trade' END AS business_type,
  CASE WHEN src.p = 'FB' THEN 'Manufacturing' WHEN src.k % 3 = 0 THEN 'Trade' ELSE 'Services' END AS sector,
  'NO ' || CAST(src.k % 100 AS STRING) || ' MAIN ROAD' AS address_line1, CASE WHEN src.p = 'SE' THEN '' ELSE 'BLOCK ' || CAST(src.nk AS STRING) END AS address_line2,
  n.n_name || CASE WHEN src.p = 'SE' THEN ' TOWN' ELSE ' CITY' END AS city, n.n_name AS district, CAST(560000 + src.nk * 10 + src.k % 10 AS STRING) AS pincode,
  CASE WHEN src.p = 'SE' AND src.k % 2 = 1 THEN '+91-' || src.mobile WHEN src.p = 'FB' AND src.k % 2 = 1 THEN NULL ELSE src.mobile END AS phone,
  CASE WHEN src.p = 'FB' OR (src.p = 'SE' AND src.k % 3 = 1) THEN NULL WHEN src.p = 'SE' AND src.k % 3 = 0 THEN ' INFO' || CAST(src.k AS STRING) || '@EXAMPLE.COM ' ELSE 'info' || CAST(src.k AS STRING) || '@example.com' END AS email,
  CASE src.k % 7 WHEN 0 THEN 'Cancelled' WHEN 1 THEN 'Suspended' ELSE 'Active' END AS registration_status, '20' || lpad(CAST(src.k % 24 AS STRING), 2, '0') || '-0' || CAST(src.k % 9 + 1 AS STRING) || '-15' AS reg_date
FROM (
  SELECT p, department, k, nk, chr(CAST(65 + k % 26 AS INT)) || chr(CAST(65 + floor(k / 26) % 26 AS INT)) AS initials, '98' || lpad(CAST(k AS STRING), 8, '0') AS mobile,
    {_syllables('CAST(floor(k / 3) AS BIGINT) * 104729 + 7')} AS word, {_syllables('CAST(floor(k / 3) AS BIGINT) * 104729 + 7')} || ' ' || {_syllables('(k % 13) * 15485863 + 5')} AS words,
    chr(CAST(65 + k % 26 AS INT)) || chr(CAST(65 + floor(k / 26) % 26 AS INT)) || chr(CAST(65 + floor(k / 676) % 26 AS INT)) || 'PC' || lpad(CAST(k % 10000 AS STRING), 4, '0') || chr(CAST(65 + k % 26 AS INT)) AS number
  FROM (
    SELECT 'CT' AS p, 'commercial_taxes' AS department, c_custkey AS k, c_nationkey AS nk FROM customer
    UNION ALL SELECT 'FB', 'factories_board', s_suppkey, s_nationkey FROM supplier
    UNION ALL SELECT 'SE', 'shops_establishments', c.c_custkey, c.c_nationkey FROM customer c JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 0) o ON o.o_custkey = c.c_custkey
  ) u
) src JOIN part a ON a.p_partkey = src.k % 200 JOIN part b ON b.p_partkey = (7 * src.k + 3) % 200 JOIN nation n ON n.n_nationkey = src.nk
"""
SIGNALS_SQL = """
SELECT entity_key, department, signal_type, signal_date, value,
  CASE WHEN entity_key % 11 = 0 OR k % 10 = 0 THEN 'Cancelled' WHEN k % 10 < 7 THEN 'Active' END AS status,
  CASE WHEN event_type = 'signup' THEN k - 50 END AS overdue_days,
  event_type = 'error' AND entity_key % 13 = 0 AND k % 20 = 0 AS formal_closure
FROM (
  SELECT user_id AS entity_key, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE event_id % 5 WHEN 0 THEN 'commercial_taxes' WHEN 1 THEN 'factories_board' WHEN 2 THEN 'shops_establishments' WHEN 3 THEN 'labour_dept' ELSE 'revenue_dept' END AS department,
    CASE event_type WHEN 'click' THEN 'filing' WHEN 'view' THEN 'inspection' WHEN 'signup' THEN 'renewal' WHEN 'purchase' THEN 'consumption' ELSE 'closure' END AS signal_type,
    CASE event_id % 97 WHEN 5 THEN '0000-00-00' WHEN 6 THEN 'unknown' WHEN 7 THEN NULL ELSE CAST(CAST(ts AS DATE) - CAST((user_id % 30) * 30 AS INT) AS STRING) END AS signal_date,
    CASE WHEN event_type = 'purchase' THEN value END AS value
  FROM events
) e
"""
_TABLES = r"\b(?:FROM|JOIN) (customer|supplier|orders|part|nation|events)\b"


def from_text(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query over the tables' Parquet files."""
    return spark.sql(re.sub(_TABLES, lambda m: m[0].replace(m[1], f"parquet.`{sf_dir}/{m[1]}.parquet`"), sql))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(spark, sf_dir, RECORDS_SQL)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(spark, sf_dir, SIGNALS_SQL)


RECORD_SCHEMA = ", ".join(f"{c} string" for c in "record_id department business_name trade_name pan gstin aadhaar udyam_number legal_status business_type sector address_line1 address_line2 district city pincode phone email status reg_date".split())


def read_json(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """A top-level array of records, or an object with the array ``records``; anything else is an error."""
    whole = spark.read.text(path, wholetext=True)
    kind = whole.select(F.expr("left(trim(value), 1)").alias("c"), F.expr("get_json_object(value, '$.records') is not null").alias("r")).first()
    if kind.c != "[" and not kind.r:
        raise ValueError("expected an array of records or an object with 'records'")
    body = F.col("value") if kind.c == "[" else F.get_json_object("value", "$.records")
    return whole.select(F.explode(F.from_json(body, f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")).alias("x")).select("x.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """By the lower-cased suffix: json, csv (every column a string) or parquet."""
    suffix = path.lower().rpartition(".")[2]
    if suffix == "json":
        return read_json(spark, path)
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format: {suffix}")


def synthetic(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """n records of max(n // 3, 10) entities over five departments, the same for a seed."""
    entity = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n // 3, 10)))
    departments = F.array(*[F.lit(d) for d in ("commercial_taxes", "factories_board", "shops_establishments", "labour_dept", "revenue_dept")])
    letter = lambda div: F.char((65 + F.floor(F.col("entity") / div) % 26).cast("int"))
    out = spark.range(n).withColumn("entity", entity).withColumn("department", F.element_at(departments, (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)) + 1).cast("int")))
    out = out.withColumn("pan", F.concat(letter(1), letter(26), letter(676), F.lit("PC"), F.lpad((F.col("entity") % 10000).cast("string"), 4, "0"), letter(1)))
    gstin = F.when(F.col("department") == "commercial_taxes", F.concat(F.lit("29"), "pan", F.lit("1Z"), (F.col("entity") % 10).cast("string")))
    return out.select(F.format_string("REC-%07d", "id").alias("record_id"), "department", F.format_string("BUSINESS %d PVT LTD", "entity").alias("business_name"), "pan", gstin.alias("gstin"), (560000 + F.col("entity")).cast("string").alias("pincode"))
