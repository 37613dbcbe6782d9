"""Keyed updates, review decisions, audit rows, free-text and global search over clusters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a question's words stand for, in the order they are tried.
STATUSES = {"active": "ACTIVE", "dormant": "DORMANT", "closed": "CLOSED", "uncertain": "UNCERTAIN"}


def upserted(target: DataFrame, changes: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """target with new keys added; on known keys only the update columns change."""
    t, c = target.alias("t"), changes.alias("c")
    both = t.join(c, [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full_outer")
    known = F.coalesce(*[F.col(f"t.{k}").isNotNull() for k in keys[:1]])
    pick = lambda x: F.when(known & F.lit(x not in update), F.col(f"t.{x}")).otherwise(F.coalesce(f"c.{x}", f"t.{x}"))
    return both.select(*[F.coalesce(f"t.{x}", f"c.{x}").alias(x) if x in keys else pick(x).alias(x) for x in target.columns])


def merged(members: DataFrame, keep: str, lose: str) -> DataFrame:
    """The loser's records move to the kept cluster, if that owns any record."""
    owns = members.agg(F.max(F.col("ubid") == keep).alias("owns"))
    return members.join(F.broadcast(owns)).withColumn("ubid", F.when((F.col("ubid") == lose) & F.col("owns"), keep).otherwise(F.col("ubid"))).drop("owns")


def merge_log(keep: str, lose: str, spark) -> DataFrame:
    return spark.createDataFrame([(lose, "MERGED", keep)], "ubid string, status string, merged_into string")


def parsed_question(text: str, districts: list[str], departments: list[str]) -> dict:
    """status, district, department, pincode, months found in a question; else the question as keyword."""
    q, out = text.lower(), {}
    for kind, words in (("status", STATUSES), ("district", {d.lower(): d for d in districts}), ("department", {d.lower(): d for d in departments})):
        if hit := next((v for w, v in words.items() if w in q), None):
            out[kind] = hit
    if m := re.search(r"\b(\d{6})\b", q):
        out["pincode"] = m[1]
    if m := re.search(r"(\d+)\s*months?", q):
        out["months"] = int(m[1])
    return out or {"keyword": text}


def question_filter(params: dict) -> Column:
    """The predicate over cluster members; months is reported, not applied."""
    p = F.lit(True)
    for c in ("status", "pincode", "department"):
        if c in params:
            p = p & (F.col(c) == params[c])
    if "district" in params:
        p = p & F.contains(F.lower("district"), F.lit(params["district"].lower()))
    if "keyword" in params:
        p = p & F.contains(F.lower("business_name"), F.lit(params["keyword"].lower()))
    return p


def question_sql(params: dict) -> str:
    """The same as SQL text, for display."""
    parts = [f"{k} = '{v}'" for k, v in params.items() if k not in ("months", "keyword")] + [f"business_name LIKE '%{v}%'" for k, v in params.items() if k == "keyword"]
    return "SELECT DISTINCT ubid FROM members WHERE " + (" AND ".join(parts) or "true")


def searched(members: DataFrame, text: str) -> DataFrame:
    """(ubid, reason) of clusters that hold the text: by UBID, name, then the first record's first hit."""
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    own = F.coalesce(*[F.when(has(c), F.lit(n)) for c, n in (("record_id", "record id"), ("pan", "PAN"), ("gstin", "GSTIN"), ("pincode", "pincode"))])
    hits = members.groupBy("ubid").agg(
        F.max(has("ubid")).alias("by_id"), F.max(has("business_name")).alias("by_name"), F.min_by(own, F.when(own.isNotNull(), F.col("record_id"))).alias("by_record"),
    )
    reason = F.coalesce(F.when(F.col("by_id"), F.lit("UBID")), F.when(F.col("by_name"), F.lit("name")), F.col("by_record"))
    return hits.select("ubid", reason.alias("reason")).filter("reason is not null")


def audit_events(ev: DataFrame, members: DataFrame) -> DataFrame:
    """(event, subject): what happened to records and pairs."""
    linked, review = ev.filter("decision = 'auto_link'"), ev.filter("decision = 'review'")
    ingested = linked.select(F.lit("ingested").alias("event"), F.explode(F.array("a", "b")).alias("subject"))
    pair = F.concat("a", F.lit("___"), "b").alias("subject")
    alone = members.join(members.groupBy("ubid").count().filter("count = 1"), "ubid", "left_semi").select(F.lit("standalone").alias("event"), F.col("record_id").alias("subject"))
    return ingested.unionByName(linked.select(F.lit("auto_linked").alias("event"), pair)).unionByName(review.select(F.lit("sent_to_review").alias("event"), pair)).unionByName(alone)


#: Order of priorities, and the doubt that next cases lie nearest to.
PRIORITIES, DOUBT = ("critical", "high", "normal", "low"), 0.785
DECIDED = ("approve", "reject", "defer", "escalate", "merge", "separate")


def review_state(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Each case as its latest log row leaves it: pending, in_review once assigned, completed once decided; an undo puts it back to pending.

    log (append-only): case_id, at, decision (assign, undo or one of DECIDED), reviewer; of rows of one time the one whose decision sorts last counts.
    """
    last = log.groupBy("case_id").agg(F.max_by(F.struct("decision", "reviewer"), F.struct("at", "decision")).alias("l"))
    out, d = queue.join(last, "case_id", "left"), F.col("l.decision")
    status = F.when(F.coalesce(d, F.lit("undo")) == "undo", "pending").when(d == "assign", "in_review").otherwise("completed")
    return out.withColumn("status", status).withColumn("decision", F.when(d.isin(*DECIDED), d)).withColumn("reviewer", F.when(d != "undo", F.col("l.reviewer"))).drop("l")


def next_cases(state: DataFrame, n: int = 10) -> DataFrame:
    """The pending cases to review next: by priority, then nearest to the doubt, then by case id."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return state.filter("status = 'pending'").orderBy(rank, F.abs(F.col("confidence") - DOUBT), "case_id").limit(n)


def assigned(state: DataFrame, reviewer: str, at: int, n: int = 10) -> DataFrame:
    """Log rows that give a reviewer the next cases."""
    return next_cases(state, n).select("case_id", F.lit(at).cast("int").alias("at"), F.lit("assign").alias("decision"), F.lit(reviewer).alias("reviewer"))


def compensated(state: DataFrame, log: DataFrame, cases: DataFrame, at: int) -> DataFrame:
    """Log rows that take back merges and separations: of the given cases those whose latest decision is one; nothing in the log changes."""
    own = state.filter(F.col("decision").isin("merge", "separate", "approve", "reject")).join(cases.select("case_id"), "case_id", "left_semi")
    return own.select("case_id", F.lit(at).cast("int").alias("at"), F.lit("undo").alias("decision"), "reviewer")


def training_rows(state: DataFrame) -> DataFrame:
    """Approved and rejected cases with label 1 and 0; others give none."""
    label = F.when(F.col("decision") == "approve", 1).when(F.col("decision") == "reject", 0)
    return state.withColumn("label", label).filter("label is not null")


def review_statistics(state: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row: cases by status, pending ones by priority, share of approvals, and of the log decisions made (those taken back too), taken back, and reviewers."""
    yes, no = F.count_if(F.col("decision") == "approve"), F.count_if(F.col("decision") == "reject")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    pending = [F.count_if((F.col("status") == "pending") & (F.col("priority") == p)).alias(f"pending_{p}") for p in PRIORITIES] if "priority" in state.columns else []
    out = state.agg(F.count("*").alias("total_cases"), n("pending"), n("in_review"), n("completed"), *pending, F.round(yes / F.nullif(yes + no, F.lit(0)), 3).alias("approval_rate"), F.countDistinct("reviewer").alias("reviewers"))
    if log is None:
        return out
    more = log.agg(F.count_if(F.col("decision").isin(*DECIDED)).alias("total_reviewed"), F.count_if(F.col("decision") == "undo").alias("rollback_count"))
    return out.crossJoin(more)  # one row each


def readiness(members: DataFrame) -> DataFrame:
    """(ubid, score, ready): how many of PAN, GSTIN, email, phone and Udyam number any record has; four make a cluster ready."""
    kinds = [c for c in ("pan", "gstin", "email", "phone", "udyam_number") if c in members.columns]
    has = [F.max((F.coalesce(F.col(c), F.lit("")) != "").cast("int")) for c in kinds]
    score = sum(has[1:], has[0])
    return members.groupBy("ubid").agg(score.alias("score")).withColumn("ready", F.col("score") >= 4)


def security_flags(members: DataFrame, status: DataFrame) -> DataFrame:
    """(ubid, flag): several names under a PAN are flagged; closed, or one department with several places or with activity this month, are watched."""
    m = members.join(status.select("entity_key", "status", "days_since_any"), "entity_key", "left").groupBy("ubid").agg(
        F.count("pan").alias("pans"), F.countDistinct("business_name").alias("names"), F.countDistinct("department").alias("departments"), F.countDistinct("pincode").alias("places"),
        F.max(F.coalesce(F.col("status") == "CLOSED", F.lit(False))).alias("closed"), F.min("days_since_any").alias("days"),
    )
    one = F.col("departments") == 1
    flag = F.when((F.col("pans") > 0) & (F.col("names") > 2), "Flagged").when(F.col("closed") | (one & (F.col("places") > 1)) | (one & (F.col("days") < 30)), "Watch").otherwise("Clean")
    return m.select("ubid", flag.alias("flag"))


def run_deltas(runs: DataFrame) -> DataFrame:
    """Status counts of each run beside the change since the run before."""
    order = Window.partitionBy("status").orderBy("run_id")
    return runs.withColumn("delta", F.col("n") - F.lag("n", 1, 0).over(order))
