"""What the console shows and exports: cluster table, guided queries, timelines, alerts, health, statistics, texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of departments, and quality, score and staleness of their feeds.
LABELS = {"commercial_taxes": "Comm. Taxes", "factories_board": "Factories Board", "shops_establishments": "Shops & Est.", "labour_dept": "Labour Dept", "revenue_dept": "Revenue Dept"}
HEALTH = {"commercial_taxes": ("Good", 92, 1), "factories_board": ("Good", 85, 3), "shops_establishments": ("Fair", 72, 2), "labour_dept": ("Fair", 68, 6), "revenue_dept": ("Stale", 55, 8)}
# The saved queries, as status, sector, pincode and district.
GUIDED = {
    "active_factories": {"status": "ACTIVE", "sector": "Manufacturing"}, "dormant_18m": {"status": "DORMANT"}, "closed_recent": {"status": "CLOSED"}, "uncertain": {"status": "UNCERTAIN"},
    "pin_560058": {"pincode": "560058", "status": "ACTIVE"}, "mysuru": {"district": "Mysuru"}, "tumakuru_mfg": {"district": "Tumakuru", "sector": "Manufacturing"},
}
DIFF_FIELDS = ("department", "business_name", "trade_name", "legal_status", "business_type", "address_line1", "city", "district", "pincode", "phone", "email")
# How the 16 features are called.
FEATURE_LABELS = {
    "pan_token_match": "PAN Number Match", "gstin_token_match": "GSTIN Match", "udyam_token_match": "Udyam Registration Match", "name_jaro_winkler": "Business Name Similarity (Jaro-Winkler)",
    "name_levenshtein_norm": "Business Name Similarity (Edit Distance)", "name_token_overlap": "Business Name Word Overlap", "name_sbert_cosine": "Business Name Semantic Similarity (AI)",
    "trade_name_jaro_winkler": "Trade Name Similarity", "address_sbert_cosine": "Address Semantic Similarity (AI)", "pincode_match": "PIN Code Match", "district_match": "District Match",
    "city_jaro_winkler": "City Name Similarity", "phone_match": "Phone Number Match", "email_match": "Email Address Match", "legal_status_match": "Legal Structure Match (Pvt Ltd/LLP/etc.)",
    "business_type_match": "Business Type Match (Mfg/Trading/Services)",
}


def label(department: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, department), department)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cluster_table(members: DataFrame, status: DataFrame, risk: DataFrame, flags: DataFrame) -> DataFrame:
    """What lists and exports show of each cluster; udyam is that of the first record with one, else a dash."""
    c = members.groupBy("ubid").agg(
        F.coalesce(F.min_by("udyam_number", F.when(F.coalesce("udyam_number", F.lit("")) != "", F.col("record_id"))), F.lit("-")).alias("udyam"),
        F.min_by("business_name", "record_id").alias("business_name"), F.count("*").alias("records"), F.countDistinct("department").alias("departments"),
    )
    c = c.join(status.select("ubid", F.col("status").alias("abi_status"), F.floor(F.col("days_since_any") / 30).alias("months")), "ubid", "left")
    c = c.join(risk.select("ubid", "risk"), "ubid", "left").join(flags.select("ubid", F.col("flag").alias("security_flag")), "ubid", "left")
    return c.withColumn("abi_status", F.coalesce("abi_status", F.lit("UNKNOWN")))


def conjunctive(members: DataFrame, activity: DataFrame, **where: str) -> DataFrame:
    """ubid of the clusters that meet every condition, each by any of their records: pincode, district, department, business_type, sector, q, status."""
    has = lambda c, v: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(v.lower()))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    of = {
        "pincode": lambda v: F.coalesce(F.col("pincode") == v, F.lit(False)), "district": lambda v: has(F.col("district"), v), "department": lambda v: has(F.col("department"), v),
        "business_type": lambda v: has(F.concat(text("business_type"), text("sector")), v), "sector": lambda v: has(F.col("sector"), v),
        "q": lambda v: has(F.col("business_name"), v) | F.contains(F.upper(F.concat(text("record_id"), text("pan"), text("gstin"), text("udyam_number"))), F.lit(v.upper())),
    }
    some = {k: v for k, v in where.items() if v and k != "status"}
    met = members.groupBy("ubid").agg(F.count("*").alias("records"), *[F.max(of[k](v)).alias(f"_{k}") for k, v in some.items()])
    for k in some:
        met = met.filter(f"_{k}")
    met = met.select("ubid", "records")
    if where.get("status"):
        met = met.join(activity.filter(F.col("status") == where["status"].upper()).select("ubid"), "ubid", "left_semi")
    return met


def guided(members: DataFrame, status: DataFrame) -> DataFrame:
    """(id, clusters, records) of each saved query; one pass over the members tells them all."""
    has = lambda c, v: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(v.lower()))
    of = {"pincode": lambda v: F.coalesce(F.col("pincode") == v, F.lit(False)), "district": lambda v: has("district", v), "sector": lambda v: has("sector", v)}
    asked = sorted({(k, v) for w in GUIDED.values() for k, v in w.items() if k != "status"})
    met = members.groupBy("ubid").agg(F.count("*").alias("records"), *[F.max(of[k](v)).alias(f"_{i}") for i, (k, v) in enumerate(asked)])
    met = met.join(status.select("ubid", F.col("status").alias("_status")), "ubid", "left")

    def all_of(w: dict) -> Column:
        out = F.lit(True)
        for k, v in w.items():
            out = out & (F.coalesce(F.col("_status") == v, F.lit(False)) if k == "status" else F.col(f"_{asked.index((k, v))}"))
        return out

    sums = met.agg(*[x for i, w in GUIDED.items() for x in (F.count_if(all_of(w)).alias(f"c_{i}"), F.coalesce(F.sum(F.when(all_of(w), F.col("records"))), F.lit(0)).alias(f"r_{i}"))])
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"c_{i}").alias("clusters"), F.col(f"r_{i}").alias("records")) for i in GUIDED])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def timeline(ev: DataFrame, members: DataFrame, status: DataFrame, started: str) -> DataFrame:
    """(ubid, at, action, details): what a run that began at ``started`` tells of each cluster; linked pairs are told 0, 1 and 2 seconds after, activity 3."""
    at = lambda s: (F.lit(started).cast("timestamp") + F.expr(f"interval {s} seconds")).alias("at")
    of = members.select("record_id", "ubid", "department")
    side = lambda c: ev.filter("decision = 'auto_link'").select("a", "b", F.col(c).alias("record_id"), "confidence").join(of, "record_id")
    ingested = lambda s: s.select("ubid", F.lit("record_ingested").alias("action"), F.format_string("Record %s ingested from %s", "record_id", label(F.col("department"))).alias("details"))
    alone = members.join(members.groupBy("ubid").count().filter("count = 1"), "ubid", "left_semi")
    review = ev.filter("decision = 'review'").select("a", "b", F.explode(F.array("a", "b")).alias("record_id")).join(of, "record_id").groupBy("a", "b").agg(F.min("ubid").alias("ubid"))
    return union([
        ingested(side("a")).select("ubid", at(0), "action", "details"), ingested(side("b")).select("ubid", at(1), "action", "details"),
        side("a").select("ubid", at(2), F.lit("auto_linked").alias("action"), F.format_string("Matched %s ↔ %s", "a", "b").alias("details")),
        ingested(alone).select("ubid", at(0), "action", F.concat("details", F.lit(" — standalone UBID created")).alias("details")),
        review.select("ubid", at(0), F.lit("sent_to_review").alias("action"), F.format_string("Pair %s ↔ %s sent to review", "a", "b").alias("details")),
        status.select("ubid", at(3), F.lit("abi_classified").alias("action"), F.concat(F.lit("ABI Status set: "), "status").alias("details")),
    ])


def statistics(members: DataFrame, ev: DataFrame, status: DataFrame) -> DataFrame:
    """One row of the platform's counters."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s.lower()}_count")
    e = ev.agg(
        F.count_if(F.col("decision") == "auto_link").alias("auto_linked"), F.count_if(F.col("decision") == "review").alias("sent_to_review"), F.count_if(F.col("decision") == "reject").alias("rejected"),
        F.count_if((F.col("decision") == "review") & ~F.col("safe")).alias("blocked_by_safety"), F.count_if(F.col("decision") != "reject").alias("total_links"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
    )
    m = members.agg(F.countDistinct("ubid").alias("total_ubids"), F.count("*").alias("total_records"), F.countDistinct("department").alias("departments"))
    return m.crossJoin(e).crossJoin(status.agg(*[n(s) for s in ("ACTIVE", "DORMANT", "CLOSED", "UNCERTAIN")]))  # one row each


def platform(now: DataFrame, alerts: DataFrame, before: DataFrame | None = None, runs: int = 1, processing: bool = False, rollbacks: int = 0, auto: float = 0.92, review: float = 0.65, role: str = "Admin") -> DataFrame:
    """The 27 figures that the console polls: ``statistics`` of this run, changes since the run before (all, if there is none), open alerts, thresholds. Each table has one row."""
    counted = {"delta_ubids": "total_ubids"} | {f"delta_{s}": f"{s}_count" for s in ("active", "dormant", "closed", "uncertain")}
    if before is not None:
        now = now.crossJoin(before.select(*[F.col(c).alias(f"_{d}") for d, c in counted.items()]))
    since = lambda d, c: (F.col(c) - (F.col(f"_{d}") if before is not None else F.lit(0))).alias(d)
    own = [c for c in now.columns if not c.startswith("_")]
    fixed = {"pipeline_runs": runs, "is_processing": processing, "false_positive_cost": "₹2.4L per unsafe merge", "auto_threshold": auto, "review_threshold": review, "rollback_count": rollbacks, "current_role": role}
    return now.crossJoin(alerts).select(*own, F.col("sent_to_review").alias("pending_reviews"), *[since(d, c) for d, c in counted.items()], "alert_count", *[F.lit(v).alias(k) for k, v in fixed.items()])


def health(records: DataFrame) -> DataFrame:
    """Records of each department beside what is known of its feed."""
    known = F.create_map(*[x for d, (q, s, h) in HEALTH.items() for x in (F.lit(d), F.struct(F.lit(q).alias("quality"), F.lit(s).alias("score"), F.lit(h).alias("stale_hours")))])
    h = F.coalesce(F.try_element_at(known, F.col("department")), F.struct(F.lit("Unknown").alias("quality"), F.lit(50).alias("score"), F.lit(12).alias("stale_hours")))
    return records.groupBy("department").agg(F.count("*").alias("records")).withColumn("h", h).select("department", label(F.col("department")).alias("label"), "records", "h.quality", F.col("h.score").alias("quality_score"), "h.stale_hours")


def synced(h: DataFrame, department: str) -> DataFrame:
    """Health after a department's feed was read again."""
    ok = F.col("department") == department
    return h.withColumn("quality_score", F.when(ok, F.least(F.lit(100), F.col("quality_score") + 15)).otherwise(F.col("quality_score"))).withColumn("stale_hours", F.when(ok, 0).otherwise(F.col("stale_hours"))).withColumn("quality", F.when(ok, "Good").otherwise(F.col("quality")))


def alerts(table: DataFrame, ev: DataFrame, h: DataFrame, acknowledged: tuple[str, ...] = ()) -> DataFrame:
    """(kind, severity, subject, n, acknowledged): dormancy of 15 % or more, closed clusters with recent signals, uncertain ones, pending reviews, stale feeds, and the cost notice."""
    row = lambda kind, severity, subject, n: [F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), subject.alias("subject"), n.cast("long").alias("n")]
    none = F.lit("")
    d = table.agg(F.count_if(F.col("abi_status") == "DORMANT").alias("dormant"), F.count("*").alias("all")).filter("dormant > 0").withColumn("pct", F.bround(100 * F.col("dormant") / F.col("all"))).filter("pct >= 15")
    reviews = ev.agg(F.count_if(F.col("decision") == "review").alias("pending"), F.count_if((F.col("decision") == "review") & ~F.col("safe")).alias("blocked"))
    out = union([
        d.select(*row("DORMANCY", "warning", none, F.col("dormant"))), table.filter("abi_status = 'CLOSED' and months < 6").select(*row("CLOSED_ACTIVE", "critical", F.col("ubid"), F.col("months"))),
        table.filter("abi_status = 'UNCERTAIN'").select(*row("UNCERTAIN", "info", F.col("ubid"), F.lit(1))), reviews.filter("pending > 0").select(*row("PENDING", "warning", none, F.col("pending"))),
        h.filter("stale_hours >= 6").select(*row("STALE", "warning", F.col("department"), F.col("stale_hours"))), reviews.select(*row("COST", "info", none, F.col("blocked"))),
    ])
    return out.withColumn("acknowledged", F.concat_ws("/", "kind", "subject").isin(list(acknowledged)) if acknowledged else F.lit(False))


def field_differences(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, field, value_a, value_b, same) of a review's two records, side by side."""
    sides = pairs.select("a", "b")
    for s in "ab":
        sides = sides.join(records.select(F.col("record_id").alias(s), *[F.coalesce(F.col(c), F.lit("")).alias(f"{c}_{s}") for c in DIFF_FIELDS]), s)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_a").alias("value_a"), F.col(f"{c}_b").alias("value_b")) for c in DIFF_FIELDS])
    return sides.select("a", "b", F.explode(rows).alias("r")).select("a", "b", "r.*").withColumn("same", F.lower("value_a") == F.lower("value_b"))


def review_risk(ev: DataFrame) -> DataFrame:
    """(a, b, risk): 150 points for each unit of doubt, 100 at most; the console's random part is left out."""
    return ev.filter("decision = 'review'").select("a", "b", F.least(F.lit(100), F.floor(F.round((1 - F.col("confidence")) * 150, 9)).cast("int")).alias("risk"))


# The sentences of safety_summary, feature_sentence and summary.
def safety_summary() -> Column:
    hard = F.col("conflict_pan").cast("int") + F.col("conflict_legal").cast("int")
    pct = F.format_string("%.1f%%", F.floor(F.round(F.col("confidence") * 1000, 6) + 0.5) / 10)
    warnings = (F.col("confidence") < 0.65).cast("int") + F.coalesce((F.col("pan_token_a") == F.col("pan_token_b")), F.lit(False)).cast("int")
    blocked = F.concat(F.lit("❌ MERGE BLOCKED: "), hard.cast("string"), F.lit(" hard negative evidence found. Confidence "), pct, F.lit(" is irrelevant when hard evidence conflicts exist."))
    review = F.concat(F.lit("⚠️ MERGE REQUIRES REVIEW: Confidence "), pct, F.lit(" with "), warnings.cast("string"), F.lit(" warnings."))
    return F.when(hard > 0, blocked).when(~F.col("safe"), review).otherwise(F.concat(F.lit("✅ MERGE SAFE: No negative evidence, confidence "), pct, F.lit(".")))


def feature_sentence(feature: Column, value: Column, impact: Column) -> Column:
    """What a feature's value and impact say, by its kind and bands of its value."""
    names = F.create_map(*[F.lit(x) for pair in FEATURE_LABELS.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, feature), feature)
    tail = F.format_string(" (impact: %+.3f)", impact)
    band = F.when(value > 0.85, "Very high").when(value > 0.65, "Moderate").otherwise("Low")
    like = F.concat(name, F.lit(": "), band, F.format_string(" similarity (%.0f%%)", F.bround(value * 100)))
    same = F.concat(name, F.when(value > 0.5, ": Match confirmed").otherwise(": No match"))
    plain = F.concat(name, F.format_string(": value=%.3f", F.bround(value, 3)))
    return F.concat(
        F.when(feature == "pan_token_match", F.when(value > 0.5, "Both records share the same PAN number").otherwise("PAN numbers do not match or are unavailable"))
        .when(feature == "gstin_token_match", F.when(value > 0.5, "Both records have the same GSTIN").otherwise("GSTINs differ or are unavailable"))
        .when(feature.contains("jaro_winkler") | feature.contains("cosine"), like)
        .when(feature.isin("pincode_match", "district_match", "phone_match", "email_match", "legal_status_match", "business_type_match"), same).otherwise(plain), tail,
    )


def summary(decision: Column, confidence: Column, contributions: Column) -> Column:
    """A linkage explanation: a header by decision, then three supporting and three opposing sentences that aren't weak, the strongest first. contributions: array of (impact, sentence)."""
    strongest = F.array_sort(contributions, lambda x, y: F.when(F.abs(x["impact"]) > F.abs(y["impact"]), -1).when(F.abs(x["impact"]) < F.abs(y["impact"]), 1).otherwise(0))
    top = lambda ok: F.transform(F.slice(F.filter(strongest, lambda x: ok(x["impact"]) & (F.abs(x["impact"]) > 0.05)), 1, 3), lambda x: F.concat(F.lit("  • "), x["sentence"]))
    pct = F.format_string("%.1f%%", F.floor(F.round(confidence * 1000, 6) + 0.5) / 10)
    head = lambda mark, what, why: F.concat(F.lit(f"{mark} {what} with "), pct, F.lit(f" confidence.\n{why}"))
    first = F.when(decision == "auto_link", head("✅", "AUTO-LINKED", "These records likely represent the same business because:")).when(
        decision == "review", head("🔍", "SENT FOR HUMAN REVIEW", "Evidence is mixed — human judgment needed. Key factors:")
    ).otherwise(head("❌", "REJECTED as non-match", "These records likely represent different businesses because:"))
    against = top(lambda v: v <= 0)
    title = F.when(decision == "auto_link", "Minor factors against match:").otherwise("Factors against match:")
    return F.array_join(F.concat(F.array(first), top(lambda v: v > 0), F.when(F.size(against) > 0, F.concat(F.array(title), against)).otherwise(F.array().cast("array<string>"))), "\n")


def sparklines(runs: DataFrame) -> DataFrame:
    """(series, points): each counter over the runs, in their order. runs: run_id and a column for each counter."""
    long = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("long").alias("v")) for c in runs.columns if c != "run_id"])
    rows = runs.select("run_id", F.explode(long).alias("x")).select("run_id", "x.*")
    return rows.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "v"))), lambda x: x["v"].cast("string")), ",").alias("points"))


def quota_left(access: DataFrame, client: str, most: int = 3) -> int:
    """How many exports a client may still make. access: client, action."""
    return max(0, most - access.filter((F.col("client") == client) & F.startswith("action", F.lit("export"))).count())


def latest_runs(runs: DataFrame) -> DataFrame:
    """Run history, the newest first, with each counter's change since the run before; runs are few."""
    order = Window.orderBy("run_id")
    return runs.select("*", *[(F.col(c) - F.lag(c, 1, 0).over(order)).alias(f"delta_{c}") for c in runs.columns if c != "run_id"]).orderBy(F.desc("run_id"))
