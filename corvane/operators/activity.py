"""Activity of entities from dated signals: features and first-match rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIVE, ENDED = ("Active", "VALID", "RENEWED"), ("Cancelled", "REVOKED", "CLOSED")
DORMANT_DAYS = 540


def features(signals: DataFrame, reference: str) -> DataFrame:
    """One row per entity. reference: a date; a signal of the cutoff day itself is outside, as its text sorts before the cutoff's."""
    ref = F.to_date(F.lit(reference))
    since = days_since(F.col("signal_date"), reference)
    cut = lambda days: F.concat(F.date_sub(ref, days).cast("string"), F.lit("T00:00:00+00:00"))
    kind = lambda k: F.col("signal_type") == k
    # the latest is the largest text, read or not
    last = lambda k: F.coalesce(F.max_by("since", F.when(kind(k), F.col("signal_date"))), F.lit(-1))
    order = Window.partitionBy("entity_key").orderBy(F.asc_nulls_first("signal_date"), "value")
    used = kind("consumption") & F.col("value").isNotNull()
    s = signals.withColumn("since", since)
    values = s.filter(used).withColumn("i", F.row_number().over(order))
    slope = values.groupBy("entity_key").agg(F.regr_slope("value", "i").alias("slope"), F.max_by("value", "i").alias("last_value"), F.count("*").alias("n_values"))
    status = F.coalesce("status", F.lit(""))
    out = s.groupBy("entity_key").agg(
        last("filing").alias("days_since_filing"), F.count_if(kind("filing") & (F.col("signal_date") >= cut(365))).alias("filings_12m"),
        last("inspection").alias("days_since_inspection"), F.coalesce(F.max(F.when(F.col("overdue_days") > 0, F.col("overdue_days"))), F.lit(0)).alias("max_overdue"),
        F.count_if(kind("renewal") & (F.col("signal_date") >= cut(1095))).alias("renewals_3y"),
        F.count_if(status.isin(*ALIVE)).alias("n_active"), F.count_if(status.isin(*ENDED)).alias("n_cancelled"),
        F.countDistinct(F.when(F.col("since") < 365, F.col("department"))).alias("departments_12m"),
        days_since(F.max("signal_date"), reference).alias("days_since_any"),
        F.max(F.coalesce("formal_closure", F.lit(False)) & kind("closure")).alias("formally_closed"), F.count("*").alias("n_signals"),
    )
    out = out.join(slope, "entity_key", "left")
    many = F.col("n_values") >= 2
    return out.withColumn("slope", F.when(many, F.col("slope")).otherwise(-1.0)).withColumn("last_value", F.when(many, F.col("last_value")).otherwise(-1.0)).drop("n_values")


def compliance(signals: DataFrame, entities: DataFrame, reference: str) -> DataFrame:
    """Of every entity, with signals or not: days since a deposit and a tax filing, whether it complied within 180 days and a filing says it is active; -1 is unknown."""
    ref = F.to_date(F.lit(reference))
    s = signals.withColumn("since", days_since(F.col("signal_date"), reference))
    kind, gst = F.col("signal_type"), (F.col("signal_type") == "filing") & (F.col("department") == "commercial_taxes")
    latest = lambda ok: F.coalesce(F.max_by("since", F.when(ok, F.col("signal_date"))), F.lit(-1))
    cut = F.concat(F.date_sub(ref, 180).cast("string"), F.lit("T00:00:00+00:00"))
    recent = kind.isin("filing", "renewal", "inspection") & (F.col("signal_date") >= cut)
    out = s.groupBy("entity_key").agg(
        latest(kind == "epf_deposit").alias("days_since_epf"), F.max(F.coalesce(recent, F.lit(False)).cast("int")).alias("compliant_6m"), latest(gst).alias("days_since_gst"),
        F.coalesce(F.max(F.when(gst, (F.coalesce("status", F.lit("")) == "Active").cast("int"))), F.lit(-1)).alias("gst_active"),
    )
    columns = out.columns[1:]
    return entities.join(out, "entity_key", "left").select("entity_key", *[F.coalesce(c, F.lit(-1)).alias(c) for c in columns])


def days_since(text: Column, reference: str) -> Column:
    """Whole days from an ISO date or time, Z or an offset or neither (then UTC), to the reference's midnight UTC; 0 at least, -1 where it can't be read."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    seconds = F.unix_seconds(F.to_timestamp(F.lit(reference + "T00:00:00Z"))) - F.unix_micros(F.try_to_timestamp(zoned)) / 1e6
    return F.when(seconds.isNull(), -1).otherwise(F.greatest(F.lit(0), F.floor(seconds / 86400).cast("int")))


def classified(f: DataFrame) -> DataFrame:
    """status, rule, confidence: closure, all cancelled, several departments, dormant; none is UNCERTAIN."""
    rules = [
        ("explicit_closure", "CLOSED", F.col("formally_closed")), ("all_cancelled", "CLOSED", (F.col("n_active") == 0) & (F.col("n_cancelled") > 0)),
        ("multi_department", "ACTIVE", (F.col("departments_12m") >= 3) & (F.col("days_since_any") < 180)),
        ("dormant", "DORMANT", (F.col("days_since_any") >= DORMANT_DAYS) & (F.col("n_active") > 0)),
    ]
    rule = F.coalesce(*[F.when(c, F.lit(n)) for n, _, c in rules], F.lit("none"))
    status = F.coalesce(*[F.when(c, F.lit(s)) for _, s, c in rules], F.lit("UNCERTAIN"))
    return f.withColumn("rule", rule).withColumn("status", status).withColumn("confidence", F.when(rule == "none", 0.0).otherwise(0.99))
