"""Registered queries of rows that screens, graph queries and exports show, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import linkage, serving, views
from corvane.sources.records import SIGNALS_SQL, records, signals

from .details import _FU, _cluster_activity, _evidence_of_clusters
from .registry import _CC, _EV, KEY, ORACLE, QUERIES, _ev, _kept, _members, _tokens, query  # noqa: F401
from .serving import _LABEL, _TIMELINE, _TOKEN, _built

_EXPLAINED = ORACLE["scr_explanations"].partition("SELECT a, b, ")[2].partition(" AS explanation FROM ev")[0]


@query(f"""{_EV}, x AS ({ORACLE['scr_contributions'].partition(_EV)[2].lstrip(', ').replace('p AS (', 'SELECT * FROM (WITH p AS (', 1)})), f AS (SELECT a, b, string_agg(feature || ' ' || bar_pct || ' ' || direction, '; ' ORDER BY place) AS xai FROM x GROUP BY 1, 2)
  SELECT e.na AS record_a, e.nb AS record_b, e.ta AS dept_a, e.tb AS dept_b, e.a AS record_a_id, e.b AS record_b_id, round(confidence, 4) AS confidence, decision, {_EXPLAINED} AS explanation, round(name_sim, 3) AS name_similarity,
    'pan_match=' || coalesce(pan_a = pan_b, false) || ';gstin_match=' || coalesce(gst_a = gst_b, false) || ';district_match=' || coalesce(da = db, false) || ';pincode_match=' || coalesce(pa = pb, false) || ';phone_match=' || coalesce(ha = hb, false) || ';legal_status_match=' || coalesce(la = lb, false) AS features,
    xai, safe AS safety_ok, CASE WHEN safe THEN '' ELSE concat_ws(' ', CASE WHEN conflict_pan THEN '{views.PAN_BLOCK}' END, CASE WHEN conflict_legal THEN 'Legal structures are incompatible: ''' || la || ''' vs ''' || lb || '''. A business cannot be both simultaneously.' END,
      CASE WHEN far_apart THEN 'Different districts (' || upper(da) || ' vs ' || upper(db) || ') with dissimilar pincodes and moderate name similarity (0.00). Unlikely same entity.' END) END AS blocks
  FROM ev e JOIN f ON f.a = e.a AND f.b = e.b""")
def evd_full(spark, d):
    """Evidence with its features, contributions and, where it is unsafe, what speaks against it; nested parts as text."""
    e = views.evidence_rows(_ev(spark, d))
    xai = F.array_join(F.transform("xai_factors", lambda x: F.concat_ws(" ", x["feature"], x["bar_pct"].cast("string"), x["direction"])), "; ")
    name = F.col("features")["name_similarity"]
    return e.select("record_a", "record_b", "dept_a", "dept_b", "record_a_id", "record_b_id", "confidence", "decision", "explanation", name.alias("name_similarity"), views.text_of(F.col("features")).alias("features"), xai.alias("xai"), "safety_ok", F.array_join("safety_blocks", " ").alias("blocks"))


_TRAIL = f"""{_EV}, k AS (SELECT *, {_EXPLAINED} AS explanation FROM ev WHERE decision <> 'reject'), tr AS (SELECT ta AS dept_a, a AS record_a, na AS name_a, tb AS dept_b, b AS record_b, nb AS name_b, round(confidence, 6) AS confidence, decision, explanation FROM k
  UNION ALL SELECT tb, b, nb, ta, a, na, round(confidence, 6), decision, explanation FROM k)"""


@query(f"{_TRAIL} SELECT * FROM tr")
def jn_evidence_trails(spark, d):
    """Both orientations of every kept pair, the surest first."""
    return views.trail(_kept(spark, d))


@query(f"{_TRAIL} SELECT * FROM tr WHERE record_a = 'CT-0000003' OR record_b = 'CT-0000003'")
def jn_evidence_trail(spark, d):
    """The trail of one record."""
    return views.trail(_kept(spark, d), "CT-0000003")


@query(f"""{_CC} SELECT {_TOKEN('PAN', 't.pt')} AS pan_token, t.department, t.record_id AS dept_record_id, t.business_name, u.ubid, n.canonical_name
  FROM tok t LEFT JOIN ub u ON u.record_id = t.record_id LEFT JOIN (SELECT ubid, min_by(business_name, record_id) AS canonical_name FROM ub GROUP BY 1) n ON n.ubid = u.ubid WHERE t.pt IS NOT NULL""")
def jn_pan_token_rows(spark, d):
    """Every PAN token's records with their UBID, if they have one."""
    return views.of_tokens(_tokens(spark, d), _members(spark, d))


@query(f"{_EV} SELECT department, record_id, business_name, reg_date FROM records r WHERE NOT EXISTS (SELECT 1 FROM ev WHERE decision <> 'reject' AND (ev.a = r.record_id OR ev.b = r.record_id)) ORDER BY reg_date DESC, record_id LIMIT 50")
def jn_unlinked_newest(spark, d):
    """The 50 newest records that no kept pair touches."""
    return views.unlinked(records(spark, d), _kept(spark, d), 50)


@query(f"{_CC} SELECT DISTINCT u.ubid, e.a, e.b, e.decision, round(e.confidence, 6) AS confidence FROM ub u JOIN (SELECT *, a AS r FROM ev UNION ALL SELECT *, b FROM ev) e ON e.r = u.record_id")
def jn_cluster_evidence_rows(spark, d):
    return _evidence_of_clusters(spark, d)


@query(f"""{_TIMELINE} SELECT ubid, 'record' AS part, '' AS "at", record_id AS subject, {_LABEL} || ' | ' || business_name AS detail FROM ub UNION ALL SELECT entity_key, 'activity', '', status, rule FROM c
  UNION ALL SELECT DISTINCT u.ubid, 'evidence', '', e.a || '___' || e.b, e.decision FROM ub u JOIN (SELECT *, a AS r FROM ev UNION ALL SELECT *, b FROM ev) e ON e.r = u.record_id
  UNION ALL SELECT ubid, 'timeline', strftime(tl."at", '%Y-%m-%d %H:%M:%S'), action, details FROM tl
  UNION ALL SELECT least(x.ubid, y.ubid), 'review', '', e.a || '___' || e.b, 'pending' FROM ev e JOIN ub x ON x.record_id = e.a JOIN ub y ON y.record_id = e.b WHERE decision = 'review'""")
def biq_cluster_rows(spark, d):
    """The detail view of every cluster as rows: records, activity, evidence, timeline, reviews."""
    _, m, c = _built(spark, d)
    return views.cluster_detail(_kept(spark, d), _evidence_of_clusters(spark, d), m, linkage.checkpointed(c), "2024-02-01")


@query(f"""{_FU}, la AS (SELECT entity_key, max({{'signal_date': signal_date, 'signal_type': signal_type}}) FILTER (signal_date IS NOT NULL) AS l FROM signals GROUP BY 1), nm AS (SELECT ubid, min_by(business_name, record_id) AS business FROM ub GROUP BY 1)
  SELECT nm.ubid, business, status, CASE WHEN rule = 'none' THEN 0.0 ELSE 0.99 END AS confidence, l.signal_type AS last_event, l.signal_date AS "date", CAST(floor(days_since_any / 30) AS BIGINT) AS months_inactive FROM nm JOIN c ON c.entity_key = nm.ubid LEFT JOIN la ON la.entity_key = nm.ubid""")
def snk_activity_export(spark, d):
    """The rows of the activity export."""
    m = _members(spark, d)
    own = signals(spark, d).join(m.select("ubid", "entity_key").distinct(), "entity_key")
    return views.activity_export(m, own.filter("signal_date is not null"), _cluster_activity(spark, d, m))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"timestamp\", 'user ' || user_id AS actor, event_type AS action, props AS entity FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def biq_access_log(spark, d):
    """The 200 newest rows of a log, here of the events."""
    e = spark.read.parquet(f"{d}/events.parquet")
    new = views.newest_first(e, "ts", "event_id", 200)
    return new.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("entity"))


@query(f"{_EV} SELECT CASE WHEN confidence >= 0.8 AND safe THEN 'auto_link' WHEN confidence >= 0.5 THEN 'review' ELSE 'reject' END AS decision, count(*) AS pairs FROM ev GROUP BY 1")
def saf_applied(spark, d):
    """How pairs are routed after other thresholds were applied."""
    return views.thresholds_applied(_ev(spark, d), 0.8, 0.5).groupBy("decision").agg(F.count("*").alias("pairs"))


_ALERTS = f"({ORACLE['biq_all_alerts']})"


@query(f"""WITH s AS ({ORACLE['biq_statistics']}) SELECT *, 1 AS pipeline_runs, false AS is_processing, sent_to_review AS pending_reviews, total_ubids AS delta_ubids, active_count AS delta_active, dormant_count AS delta_dormant, closed_count AS delta_closed, uncertain_count AS delta_uncertain,
  (SELECT count(*) FROM {_ALERTS} a WHERE NOT acknowledged) AS alert_count, '₹2.4L per unsafe merge' AS false_positive_cost, 0.92 AS auto_threshold, 0.65 AS review_threshold, 0 AS rollback_count, 'Admin' AS current_role FROM s""")
def biq_platform(spark, d):
    """All 27 figures of the platform, after its first run."""
    unseen = QUERIES["biq_all_alerts"](spark, d).filter("not acknowledged").agg(F.count("*").alias("alert_count"))
    return serving.platform(QUERIES["biq_statistics"](spark, d), unseen)
