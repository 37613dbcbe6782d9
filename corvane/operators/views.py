"""What screens and graph queries show as rows: evidence with all its parts, details of clusters, trails, exports, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attribution, linkage, serving

#: What negative evidence is described as.
PAN_BLOCK = "Both records have PAN numbers, but they are DIFFERENT. This is strong evidence of different legal entities."
LEGAL_BLOCK = "Legal structures are incompatible: '%s' vs '%s'. A business cannot be both simultaneously."
PLACE_BLOCK = "Different districts (%s vs %s) with dissimilar pincodes and moderate name similarity (0.00). Unlikely same entity."


def evidence_rows(ev: DataFrame) -> DataFrame:
    """Each pair with names, departments, ids, confidence, decision, explanation, features (struct), xai_factors (array) and, if it is unsafe, safety_blocks."""
    same = lambda c: F.coalesce((F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != ""), F.lit(False))
    features = F.struct(
        same("pan_token").alias("pan_match"), same("gstin_token").alias("gstin_match"), F.round("name_sim", 3).alias("name_similarity"), *[same(c).alias(f"{c}_match") for c in ("district", "pincode", "phone")], same("legal").alias("legal_status_match"),
    )
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    blocks = F.array(
        F.when(F.col("conflict_pan"), PAN_BLOCK), F.when(F.col("conflict_legal"), F.format_string(LEGAL_BLOCK, up("legal_status_a"), up("legal_status_b"))), F.when(F.col("far_apart"), F.format_string(PLACE_BLOCK, up("district_a"), up("district_b"))),
    )
    none = F.array().cast("array<string>")
    xai = F.transform(attribution.terms(), lambda t: F.struct(*[t[c].alias(c) for c in ("feature", "contribution", "direction", "bar_pct")]))
    return ev.withColumn("xai_factors", xai).select(
        F.col("business_name_a").alias("record_a"), F.col("business_name_b").alias("record_b"), F.col("department_a").alias("dept_a"), F.col("department_b").alias("dept_b"), F.col("a").alias("record_a_id"), F.col("b").alias("record_b_id"),
        F.round("confidence", 4).alias("confidence"), "decision", linkage.explanation().alias("explanation"), features.alias("features"), "xai_factors", F.col("safe").alias("safety_ok"),
        F.when(F.col("safe"), none).otherwise(F.filter(blocks, lambda t: t.isNotNull())).alias("safety_blocks"),
    )


def trail(ev: DataFrame, record_id: str | None = None) -> DataFrame:
    """Why records are linked: each kept pair from both sides (of one record, if given), the surest first."""
    kept = ev.filter("decision <> 'reject'")
    if record_id is not None:
        kept = kept.filter((F.col("a") == record_id) | (F.col("b") == record_id))
    kept = kept.withColumn("explanation", linkage.explanation())

    def side(x: str, y: str) -> DataFrame:
        return kept.select(
            F.col(f"department_{x}").alias("dept_a"), F.col(x).alias("record_a"), F.col(f"business_name_{x}").alias("name_a"), F.col(f"department_{y}").alias("dept_b"), F.col(y).alias("record_b"), F.col(f"business_name_{y}").alias("name_b"),
            F.round("confidence", 6).alias("confidence"), "decision", "explanation",
        )

    return side("a", "b").unionByName(side("b", "a")).orderBy(F.desc("confidence"), "record_a", "record_b")


def of_tokens(tokens: DataFrame, members: DataFrame, token: str | None = None) -> DataFrame:
    """Records by PAN token (of one token, if given), with the UBID and the name of their cluster where they have one."""
    t = tokens.filter("pan_token is not null") if token is None else tokens.filter(F.col("pan_token") == token)
    named = members.groupBy("ubid").agg(F.min_by("business_name", "record_id").alias("canonical_name"))
    own = members.select("record_id", "ubid").join(named, "ubid")
    return t.select("pan_token", "department", F.col("record_id").alias("dept_record_id"), "business_name").join(own.withColumnRenamed("record_id", "dept_record_id"), "dept_record_id", "left").select("pan_token", "department", "dept_record_id", "business_name", "ubid", "canonical_name")


def unlinked(records: DataFrame, links: DataFrame, n: int | None = None) -> DataFrame:
    """Records that no link (a, b) touches, the newest first, n at most."""
    linked = links.select(F.explode(F.array("a", "b")).alias("record_id")).distinct()
    out = records.join(linked, "record_id", "left_anti").select("department", "record_id", "business_name", "reg_date").orderBy(F.desc("reg_date"), "record_id")
    return out if n is None else out.limit(n)


def cluster_detail(ev: DataFrame, touching: DataFrame, members: DataFrame, status: DataFrame, started: str, ubid: str | None = None) -> DataFrame:
    """(ubid, part, at, subject, detail): the rows of a cluster's detail view - its records, activity, evidence, timeline by time, reviews - of all clusters or one.

    ev: the evidence that isn't rejected; touching: what ``linkage.of_clusters`` gives of all evidence.
    """
    if ubid is not None:
        members, status, touching = (t.filter(F.col("ubid") == ubid) for t in (members, status, touching))
    row = lambda part, at, subject, detail: [F.col("ubid"), F.lit(part).alias("part"), at.cast("string").alias("at"), subject.alias("subject"), detail.alias("detail")]
    none = F.lit("")
    pair = F.concat("a", F.lit("___"), "b")
    review = ev.filter("decision = 'review'").select("a", "b", F.explode(F.array("a", "b")).alias("record_id")).join(members.select("record_id", "ubid"), "record_id").groupBy("a", "b").agg(F.min("ubid").alias("ubid"))
    told = serving.timeline(ev, members, status, started)
    return serving.union([
        members.select(*row("record", none, F.col("record_id"), F.concat_ws(" | ", serving.label(F.col("department")), "business_name"))),
        status.select(*row("activity", none, F.col("status"), F.col("rule"))), touching.select(*row("evidence", none, pair, F.col("decision"))),
        told.select(*row("timeline", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.col("action"), F.col("details"))), review.select(*row("review", none, pair, F.lit("pending"))),
    ])


def activity_export(members: DataFrame, signals: DataFrame, classified: DataFrame) -> DataFrame:
    """ubid, business, status, confidence, last_event, date, months_inactive of each cluster; the last event is that of the largest date text. signals: ubid and a signal's columns."""
    last = signals.groupBy("ubid").agg(F.max(F.struct("signal_date", "signal_type")).alias("l"))
    named = members.groupBy("ubid").agg(F.min_by("business_name", "record_id").alias("business"))
    out = named.join(classified.select("ubid", "status", "confidence", F.floor(F.col("days_since_any") / 30).alias("months_inactive")), "ubid").join(last, "ubid", "left")
    return out.select("ubid", "business", "status", "confidence", F.col("l.signal_type").alias("last_event"), F.col("l.signal_date").alias("date"), "months_inactive")


def newest_first(log: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows of a log that only grows."""
    return log.orderBy(F.desc(at), F.desc(key)).limit(n)


def thresholds_applied(ev: DataFrame, auto: float, review: float) -> DataFrame:
    """The evidence routed anew by other thresholds; safety is as it was found."""
    return linkage.routed(ev.drop("decision"), auto, review)


def text_of(features: Column) -> Column:
    """A features struct as text, for display."""
    yes = lambda n: F.concat(F.lit(f"{n}="), features[n].cast("string"))
    return F.concat_ws(";", yes("pan_match"), yes("gstin_match"), *[yes(f"{c}_match") for c in ("district", "pincode", "phone", "legal_status")])
