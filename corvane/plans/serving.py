"""Registered queries of what the console shows and exports, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import pii
from corvane.operators import activity, console, features, linkage, serving
from corvane.sources.connectors import payload_hash
from corvane.sources.records import records, signals

from .details import _FU, _RISK, _cluster_activity, _evidence_of_clusters
from .registry import _CC, _EV, _R, _S, _SINCE, KEY, ORACLE, QUERIES, REFERENCE, _ev, _kept, _members, _tokens, query

_LABEL = "CASE department " + " ".join(f"WHEN '{d}' THEN '{v}'" for d, v in serving.LABELS.items()) + " ELSE department END"
_FLAG = """flag AS (SELECT ub.ubid, CASE WHEN count(pan) > 0 AND count(DISTINCT business_name) > 2 THEN 'Flagged' WHEN bool_or(coalesce(c.status, '') = 'CLOSED') THEN 'Watch' WHEN count(DISTINCT department) = 1 AND count(DISTINCT pincode) > 1 THEN 'Watch'
    WHEN count(DISTINCT department) = 1 AND min(c.days_since_any) < 30 THEN 'Watch' ELSE 'Clean' END AS flag FROM ub LEFT JOIN c ON c.entity_key = ub.ubid GROUP BY 1)"""
_TABLE = f"""{_RISK}, {_FLAG}, tab AS (SELECT ub.ubid, coalesce(min_by(udyam_number, record_id) FILTER (udyam_number IS NOT NULL), '-') AS udyam, min_by(business_name, record_id) AS business_name, count(*) AS records, count(DISTINCT department) AS departments,
    coalesce(max(c.status), 'UNKNOWN') AS abi_status, CAST(max(floor(c.days_since_any / 30)) AS BIGINT) AS months, max(k.risk) AS risk, max(g.flag) AS security_flag
    FROM ub LEFT JOIN c ON c.entity_key = ub.ubid LEFT JOIN risk k ON k.ubid = ub.ubid LEFT JOIN flag g ON g.ubid = ub.ubid GROUP BY 1)"""


def _built(spark, d):
    """(evidence, members, activity of clusters)."""
    e = _ev(spark, d)
    m = _members(spark, d)
    return e, m, _cluster_activity(spark, d, m)


def _table(spark, d, built=None):
    e, m, c = built or _built(spark, d)
    c = linkage.checkpointed(c)
    flags = console.security_flags(m.drop("entity_key").withColumn("entity_key", F.col("ubid")), c.withColumnRenamed("ubid", "entity_key"))
    return serving.cluster_table(m, c, linkage.risk(m, e, c), flags)


@query(f"{_TABLE} SELECT * FROM tab")
def snk_clusters(spark, d):
    """The rows of the cluster export."""
    return _table(spark, d)


@query(f"{_CC} SELECT ubid, min_by(business_name, record_id) AS business_name, 'ACTIVE' AS status, count(*) AS record_count, count(DISTINCT department) AS department_count FROM ub GROUP BY 1")
def snk_ubid_nodes(spark, d):
    return _members(spark, d).groupBy("ubid").agg(F.min_by("business_name", "record_id").alias("business_name"), F.lit("ACTIVE").alias("status"), F.count("*").alias("record_count"), F.countDistinct("department").alias("department_count"))


@query(f"""{_CC} SELECT 'record' AS kind, count(*) AS violations FROM (SELECT 1 FROM ub GROUP BY department, record_id HAVING count(*) > 1) x UNION ALL SELECT 'pair', count(*) FROM (SELECT 1 FROM ev GROUP BY a, b HAVING count(*) > 1) x
  UNION ALL SELECT 'ubid of a record', count(*) FROM (SELECT 1 FROM ub GROUP BY record_id HAVING count(DISTINCT ubid) > 1) x""")
def snk_violations(spark, d):
    """How many keys break the three rules of uniqueness."""
    e = _ev(spark, d)
    m = _members(spark, d)
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("violations"))
    return serving.union([n("record", m.groupBy("department", "record_id").count().filter("count > 1")), n("pair", e.groupBy("a", "b").count().filter("count > 1")), n("ubid of a record", m.groupBy("record_id").agg(F.countDistinct("ubid").alias("n")).filter("n > 1"))])


@query(f"{_R} SELECT record_id, {_LABEL} AS label FROM records")
def nrm_labels(spark, d):
    return records(spark, d).select("record_id", serving.label(F.col("department")).alias("label"))


@query(f"""{_R} SELECT record_id, sha256('{{"business_name": "' || business_name || '", "district": "' || district || '", "record_id": "' || record_id || '"}}') AS payload_hash FROM records""")
def nrm_payload_hash(spark, d):
    payload = F.to_json(F.struct("record_id", "district", "business_name"))
    return records(spark, d).select("record_id", payload_hash(payload).alias("payload_hash"))


@query(f"{_R} SELECT record_id, left(coalesce(pan, ''), 4) || CASE WHEN pan IS NULL THEN '' ELSE '****' || right(pan, 2) END AS pan, CASE WHEN gstin IS NULL THEN '' ELSE left(gstin, 5) || '*********' || right(gstin, 2) END AS gstin FROM records")
def pii_export_masks(spark, d):
    return records(spark, d).select("record_id", pii.export_pan("pan").alias("pan"), pii.export_gstin("gstin").alias("gstin"))


_HMAC = ORACLE["pii_pan_token"].partition("SELECT record_id, ")[2].partition(" AS pan_token")[0]
_TOKEN = lambda kind, x: _HMAC.replace("'PAN:' || pan", f"'{kind}:' || {x}")
ORACLE["pii_tokenized"] = f"""{_EV} SELECT r.* EXCLUDE (pan, gstin, udyam_number), CASE WHEN t.pt IS NOT NULL THEN {_TOKEN("PAN", "t.pt")} END AS pan_token, CASE WHEN t.gt IS NOT NULL THEN {_TOKEN("GSTIN", "t.gt")} END AS gstin_token,
  CASE WHEN r.udyam_number IS NOT NULL THEN {_TOKEN("UDYAM", "r.udyam_number")} END AS udyam_number_token FROM records r JOIN tok t USING (record_id)"""


@query(f"{_EV} SELECT r.record_id, left(r.pan, 4) || '●●●●' || right(r.pan, 2) AS pan, CASE WHEN pt IS NOT NULL THEN {_TOKEN('PAN', 'pt')} END AS pan_token FROM records r JOIN tok USING (record_id)")
def pii_record_view(spark, d):
    """Masked values beside tokens."""
    return records(spark, d).select("record_id", pii.mask_pan("pan").alias("pan")).join(_tokens(spark, d).select("record_id", "pan_token"), "record_id")


@query(f"{_EV} SELECT x.record_id, count(y.record_id) AS others FROM tok x LEFT JOIN tok y ON y.pt = x.pt AND y.record_id <> x.record_id GROUP BY 1")
def jn_same_pan(spark, d):
    """Optional match by PAN token: how many other records share it; counted by token, so no pairs are made."""
    t = _tokens(spark, d).select("record_id", "pan_token")
    n = t.filter("pan_token is not null").groupBy("pan_token").agg(F.count("*").alias("n"))
    return t.join(n, "pan_token", "left").select("record_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("others"))


@query(f"{_FU} SELECT u.record_id, u.ubid, coalesce(c.status, 'UNKNOWN') AS abi_status FROM ub u LEFT JOIN c ON c.entity_key = u.ubid WHERE u.department = 'shops_establishments'")
def jn_department_records(spark, d):
    m = _members(spark, d)
    c = _cluster_activity(spark, d, m)
    return m.filter("department = 'shops_establishments'").join(c.select("ubid", "status"), "ubid", "left").select("record_id", "ubid", F.coalesce("status", F.lit("UNKNOWN")).alias("abi_status"))


@query(f"{_EV} SELECT CASE WHEN confidence < 0.65 THEN 'reject' WHEN NOT safe OR confidence < 0.92 THEN 'review' ELSE 'auto_link' END AS routed, count(*) AS n, count(*) FILTER (confidence >= 0.65 AND NOT safe) AS blocked FROM ev GROUP BY 1")
def rte_learned_routing(spark, d):
    """Routing by confidence alone, after which whatever isn't rejected and isn't safe goes to review."""
    c = F.col("confidence")
    first = F.when(c >= linkage.AUTO, "auto_link").when(c >= linkage.REVIEW, "review").otherwise("reject")
    blocked = (first != "reject") & ~F.col("safe")
    return _ev(spark, d).groupBy(F.when(blocked, "review").otherwise(first).alias("routed")).agg(F.count("*").alias("n"), F.count_if(blocked).alias("blocked"))


_PCT = "printf('%.1f%%', floor(round(confidence * 1000, 6) + 0.5) / 10)"


@query(f"""{_EV} SELECT a, b, CASE WHEN conflict_pan OR conflict_legal THEN '❌ MERGE BLOCKED: ' || (conflict_pan::INT + conflict_legal::INT) || ' hard negative evidence found. Confidence ' || {_PCT} || ' is irrelevant when hard evidence conflicts exist.'
  WHEN NOT safe THEN '⚠️ MERGE REQUIRES REVIEW: Confidence ' || {_PCT} || ' with ' || ((confidence < 0.65)::INT + coalesce(pan_a = pan_b, false)::INT) || ' warnings.' ELSE '✅ MERGE SAFE: No negative evidence, confidence ' || {_PCT} || '.' END AS summary FROM ev""")
def saf_summaries(spark, d):
    return _ev(spark, d).select("a", "b", serving.safety_summary().alias("summary"))


@query(f"{_CC} SELECT (SELECT count(DISTINCT ubid) FROM ub) AS total_ubids, (SELECT count(*) FROM ub) AS total_records, count(*) AS total_links, round(avg(confidence), 6) AS avg_confidence FROM ev WHERE decision <> 'reject'")
def clu_platform(spark, d):
    """No row where there are no records or no links."""
    e = _kept(spark, d)
    m = _members(spark, d).agg(F.countDistinct("ubid").alias("total_ubids"), F.count("*").alias("total_records"))
    links = e.agg(F.count("*").alias("total_links"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return m.crossJoin(links).filter("total_records > 0 and total_links > 0")  # one row each


@query(f"""{_S}, e AS (SELECT DISTINCT entity_key FROM ({_R} SELECT * FROM records) r), s AS (SELECT *, {_SINCE("signal_date")} AS since FROM signals),
  g AS (SELECT entity_key, coalesce(arg_max(since, signal_date) FILTER (signal_type = 'epf_deposit'), -1) AS days_since_epf, CAST(coalesce(bool_or(signal_type IN ('filing', 'renewal', 'inspection') AND signal_date >= CAST(DATE '{REFERENCE}' - 180 AS VARCHAR) || 'T00:00:00+00:00'), false) AS INT) AS compliant_6m,
    coalesce(arg_max(since, signal_date) FILTER (signal_type = 'filing' AND department = 'commercial_taxes'), -1) AS days_since_gst, CASE WHEN count(*) FILTER (signal_type = 'filing' AND department = 'commercial_taxes') > 0 THEN CAST(bool_or(signal_type = 'filing' AND department = 'commercial_taxes' AND coalesce(status, '') = 'Active') AS INT) ELSE -1 END AS gst_active FROM s GROUP BY 1)
  SELECT e.entity_key, coalesce(days_since_epf, -1) AS days_since_epf, coalesce(compliant_6m, -1) AS compliant_6m, coalesce(days_since_gst, -1) AS days_since_gst, coalesce(gst_active, -1) AS gst_active FROM e LEFT JOIN g USING (entity_key)""")
def act_all_entities(spark, d):
    """Deposits, compliance and tax filings of every entity of the records; -1 where it has no signals."""
    return activity.compliance(signals(spark, d), records(spark, d).select("entity_key").distinct(), REFERENCE)


@query(f"{_EV} SELECT a, b, least(100, CAST(floor(round((1 - confidence) * 150, 9)) AS INT)) AS risk FROM ev WHERE decision = 'review'")
def rev_risk(spark, d):
    return serving.review_risk(_kept(spark, d))


_DIFF = " UNION ALL ".join(f"SELECT e.a, e.b, '{c}' AS field, coalesce(x.{c}, '') AS value_a, coalesce(y.{c}, '') AS value_b FROM ev e JOIN records x ON x.record_id = e.a JOIN records y ON y.record_id = e.b WHERE decision = 'review'" for c in serving.DIFF_FIELDS)


@query(f"{_EV} SELECT *, lower(value_a) = lower(value_b) AS same FROM ({_DIFF}) x")
def rev_differences(spark, d):
    return serving.field_differences(_kept(spark, d).filter("decision = 'review'"), records(spark, d))


def _guided_sql():
    parts = []
    for i, w in serving.GUIDED.items():
        met = [{"sector": f"bool_or(contains(lower(sector), '{w.get('sector', '').lower()}'))", "pincode": f"bool_or(pincode = '{w.get('pincode')}')", "district": f"bool_or(contains(lower(district), '{w.get('district', '').lower()}'))", "status": f"coalesce(max(c.status), '') = '{w.get('status')}'"}[k] for k in w]
        parts.append(f"SELECT '{i}' AS id, count(*) AS clusters, coalesce(sum(records), 0) AS records FROM (SELECT u.ubid, count(*) AS records FROM ub u LEFT JOIN c ON c.entity_key = u.ubid GROUP BY 1 HAVING {' AND '.join(met)}) x")
    return f"{_FU} {' UNION ALL '.join(parts)}"


@query(_guided_sql())
def biq_guided(spark, d):
    m = _members(spark, d)
    return serving.guided(m, linkage.checkpointed(_cluster_activity(spark, d, m)))


_TIMELINE = f"""{_FU}, tl AS (
  SELECT u.ubid, TIMESTAMP '2024-02-01' + INTERVAL 0 SECOND AS "at", 'record_ingested' AS action, 'Record ' || u.record_id || ' ingested from ' || {_LABEL} AS details FROM ev e JOIN ub u ON u.record_id = e.a WHERE decision = 'auto_link'
  UNION ALL SELECT u.ubid, TIMESTAMP '2024-02-01' + INTERVAL 1 SECOND, 'record_ingested', 'Record ' || u.record_id || ' ingested from ' || {_LABEL} FROM ev e JOIN ub u ON u.record_id = e.b WHERE decision = 'auto_link'
  UNION ALL SELECT u.ubid, TIMESTAMP '2024-02-01' + INTERVAL 2 SECOND, 'auto_linked', 'Matched ' || e.a || ' ↔ ' || e.b FROM ev e JOIN ub u ON u.record_id = e.a WHERE decision = 'auto_link'
  UNION ALL SELECT ubid, TIMESTAMP '2024-02-01', 'record_ingested', 'Record ' || record_id || ' ingested from ' || {_LABEL} || ' — standalone UBID created' FROM ub WHERE ubid IN (SELECT ubid FROM ub GROUP BY 1 HAVING count(*) = 1)
  UNION ALL SELECT least(x.ubid, y.ubid), TIMESTAMP '2024-02-01', 'sent_to_review', 'Pair ' || e.a || ' ↔ ' || e.b || ' sent to review' FROM ev e JOIN ub x ON x.record_id = e.a JOIN ub y ON y.record_id = e.b WHERE decision = 'review'
  UNION ALL SELECT entity_key, TIMESTAMP '2024-02-01' + INTERVAL 3 SECOND, 'abi_classified', 'ABI Status set: ' || status FROM c)"""


@query(f"""{_TIMELINE} SELECT ubid, strftime(tl."at", '%Y-%m-%d %H:%M:%S') AS "at", action, details FROM tl""")
def biq_timeline(spark, d):
    m = _members(spark, d)  # nothing is told of rejected pairs
    return serving.timeline(_kept(spark, d), m, _cluster_activity(spark, d, m), "2024-02-01").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""{_TIMELINE}, n AS (SELECT ubid, count(*) AS records FROM ub GROUP BY 1), tn AS (SELECT ubid, count(*) AS events FROM tl GROUP BY 1), rn AS (SELECT least(x.ubid, y.ubid) AS ubid, count(*) AS reviews FROM ev e JOIN ub x ON x.record_id = e.a JOIN ub y ON y.record_id = e.b WHERE decision = 'review' GROUP BY 1),
  vn AS (SELECT ubid, count(*) AS evidence FROM (SELECT DISTINCT u.ubid, e.a, e.b FROM ub u JOIN (SELECT a, b, a AS r FROM ev UNION ALL SELECT a, b, b FROM ev) e ON e.r = u.record_id) x GROUP BY 1)
  SELECT n.ubid, records, coalesce(events, 0) AS events, coalesce(reviews, 0) AS reviews, coalesce(evidence, 0) AS evidence, coalesce(c.status, 'UNKNOWN') AS abi_status FROM n LEFT JOIN tn USING (ubid) LEFT JOIN rn USING (ubid) LEFT JOIN vn USING (ubid) LEFT JOIN c ON c.entity_key = n.ubid""")
def biq_cluster_detail(spark, d):
    """How much each part of a cluster's detail view holds, beside its activity."""
    _, m, c = _built(spark, d)
    c, kept = linkage.checkpointed(c), _kept(spark, d)
    reviews = linkage.sided(kept.filter("decision = 'review'").select("a", "b"), m, ["ubid"]).select(F.least("ubid_a", "ubid_b").alias("ubid"))
    n = lambda df, name: df.groupBy("ubid").agg(F.count("*").alias(name))
    out = n(m, "records").join(n(serving.timeline(kept, m, c, "2024-02-01"), "events"), "ubid", "left").join(n(reviews, "reviews"), "ubid", "left")
    out = out.join(n(_evidence_of_clusters(spark, d), "evidence"), "ubid", "left").join(c.select("ubid", "status"), "ubid", "left")
    return out.select("ubid", "records", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("events", "reviews", "evidence")], F.coalesce("status", F.lit("UNKNOWN")).alias("abi_status"))


@query(f"""{_FU} SELECT (SELECT count(DISTINCT ubid) FROM ub) AS total_ubids, (SELECT count(*) FROM ub) AS total_records, (SELECT count(DISTINCT department) FROM ub) AS departments, count(*) FILTER (decision = 'auto_link') AS auto_linked, count(*) FILTER (decision = 'review') AS sent_to_review,
  count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'review' AND NOT safe) AS blocked_by_safety, count(*) FILTER (decision <> 'reject') AS total_links, round(avg(confidence), 4) AS avg_confidence,
  {", ".join(f"(SELECT count(*) FROM c WHERE status = '{s}') AS {s.lower()}_count" for s in ("ACTIVE", "DORMANT", "CLOSED", "UNCERTAIN"))} FROM ev""")
def biq_statistics(spark, d):
    e, m, c = _built(spark, d)
    return serving.statistics(m, e, c)


_HEALTH = f"SELECT department, {_LABEL} AS label, count(*) AS records, CASE department " + " ".join(f"WHEN '{x}' THEN '{q}'" for x, (q, _, _) in serving.HEALTH.items()) + " ELSE 'Unknown' END AS quality, CASE department " + " ".join(f"WHEN '{x}' THEN {s}" for x, (_, s, _) in serving.HEALTH.items()) + " ELSE 50 END AS quality_score, CASE department " + " ".join(f"WHEN '{x}' THEN {h}" for x, (_, _, h) in serving.HEALTH.items()) + " ELSE 12 END AS stale_hours FROM records GROUP BY 1, 2"


@query(f"{_R} {_HEALTH}")
def biq_health(spark, d):
    return serving.health(records(spark, d))


@query(f"{_R} SELECT * REPLACE (CASE WHEN department = 'shops_establishments' THEN 'Good' ELSE quality END AS quality, CASE WHEN department = 'shops_establishments' THEN least(100, quality_score + 15) ELSE quality_score END AS quality_score, CASE WHEN department = 'shops_establishments' THEN 0 ELSE stale_hours END AS stale_hours) FROM ({_HEALTH}) h")
def biq_synced(spark, d):
    return serving.synced(serving.health(records(spark, d)), "shops_establishments")


@query(f"""{_TABLE}, h AS ({_HEALTH}), al AS (SELECT 'DORMANCY' AS kind, 'warning' AS severity, '' AS subject, count(*) FILTER (abi_status = 'DORMANT') AS n FROM tab HAVING round_even(100 * count(*) FILTER (abi_status = 'DORMANT') / count(*), 0) >= 15
  UNION ALL SELECT 'CLOSED_ACTIVE', 'critical', ubid, months FROM tab WHERE abi_status = 'CLOSED' AND months < 6 UNION ALL SELECT 'UNCERTAIN', 'info', ubid, 1 FROM tab WHERE abi_status = 'UNCERTAIN'
  UNION ALL SELECT 'PENDING', 'warning', '', count(*) FROM ev WHERE decision = 'review' HAVING count(*) > 0 UNION ALL SELECT 'STALE', 'warning', department, stale_hours FROM h WHERE stale_hours >= 6
  UNION ALL SELECT 'COST', 'info', '', count(*) FILTER (decision = 'review' AND NOT safe) FROM ev) SELECT *, kind = 'PENDING' AS acknowledged FROM al""")
def biq_all_alerts(spark, d):
    """All kinds of alerts, of which the pending reviews' is acknowledged."""
    built = _built(spark, d)
    return serving.alerts(linkage.checkpointed(_table(spark, d, built)), _kept(spark, d), serving.health(records(spark, d)), ("PENDING/",))


@query(f"""{_EV}, runs AS (SELECT 1 AS run_id, count(*) FILTER (decision = 'auto_link') AS auto, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'reject') AS reject FROM ev WHERE ea % 2 = 0 AND eb % 2 = 0
  UNION ALL SELECT 2, count(*) FILTER (decision = 'auto_link'), count(*) FILTER (decision = 'review'), count(*) FILTER (decision = 'reject') FROM ev)
  SELECT series, string_agg(CAST(v AS VARCHAR), ',' ORDER BY run_id) AS points FROM (SELECT run_id, 'auto' AS series, auto AS v FROM runs UNION ALL SELECT run_id, 'review', review FROM runs UNION ALL SELECT run_id, 'reject', reject FROM runs) x GROUP BY 1""")
def biq_sparklines(spark, d):
    """Counters over two runs, the first on even entities alone."""
    n = lambda df, i: df.agg(F.lit(i).alias("run_id"), *[F.count_if(F.col("decision") == v).alias(k) for k, v in (("auto", "auto_link"), ("review", "review"), ("reject", "reject"))])
    e = _ev(spark, d)
    return serving.sparklines(n(e.filter("entity_key_a % 2 = 0 and entity_key_b % 2 = 0"), 1).unionByName(n(e, 2)))


@query(f"{_EV} SELECT a, b, decision FROM ev WHERE decision = 'auto_link'")
def biq_linked_evidence(spark, d):
    return _kept(spark, d).filter("decision = 'auto_link'").select("a", "b", "decision")


_FEA = ORACLE["fea_pairs"]
_SENTENCES = " UNION ALL ".join(
    f"SELECT a, b, '{f}' AS feature, {f} AS value FROM fea" for f in features.NAMES
)


@query(f"""WITH fea AS ({_FEA}), l AS ({_SENTENCES}) SELECT a, b, feature, CASE WHEN feature = 'pan_token_match' THEN CASE WHEN value > 0.5 THEN 'Both records share the same PAN number' ELSE 'PAN numbers do not match or are unavailable' END
  WHEN feature = 'gstin_token_match' THEN CASE WHEN value > 0.5 THEN 'Both records have the same GSTIN' ELSE 'GSTINs differ or are unavailable' END
  WHEN contains(feature, 'jaro_winkler') OR contains(feature, 'cosine') THEN label || ': ' || CASE WHEN value > 0.85 THEN 'Very high' WHEN value > 0.65 THEN 'Moderate' ELSE 'Low' END || printf(' similarity (%d%%)', CAST(round_even(value * 100, 0) AS INT))
  WHEN feature IN ('udyam_token_match', 'name_levenshtein_norm', 'name_token_overlap') THEN label || printf(': value=%.3f', value)
  ELSE label || CASE WHEN value > 0.5 THEN ': Match confirmed' ELSE ': No match' END END || ' (impact: +0.100)' AS sentence
  FROM l JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in serving.FEATURE_LABELS.items())}) n(feature, label) USING (feature)""")
def fmt_features(spark, d):
    """A sentence for each feature of each pair, with a constant impact."""
    long = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in features.NAMES])
    rows = QUERIES["fea_pairs"](spark, d).select("a", "b", F.explode(long).alias("f")).select("a", "b", "f.*")
    return rows.select("a", "b", "feature", serving.feature_sentence(F.col("feature"), F.col("value"), F.lit(0.1)).alias("sentence"))
