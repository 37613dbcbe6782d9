"""More registered queries: safety details, graph views, risk flags, shares, explanations, keyed updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane import tables
from corvane.functions import phonetics, pii, text
from corvane.operators import activity, attribution, console, features, keyed, learning, linkage, normalize
from corvane.sources.records import SIGNALS_SQL, from_text, records, signals

from .registry import _CASES, _CC, _EV, _F, _R, KEY, ORACLE, QUERIES, REFERENCE, _act, _blocked_records, _cases, _described, _ev, _kept, _members, _pads, _pair_features, query

_IDS = """SELECT c_custkey AS k, 'UDYAM-KA-' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey AS STRING), CAST(6 + c_custkey % 3 AS INT), '0') AS udyam,
  CAST(2 + c_custkey % 9 AS STRING) || ' ' || lpad(CAST(c_custkey * 7 AS STRING), 11, '0') AS aadhaar FROM customer"""
_HMAC = f"sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || encode(%s))))"


@query(f"""WITH i AS (SELECT *, regexp_matches(udyam, '{pii.UDYAM}') AS udyam_ok, regexp_matches(replace(aadhaar, ' ', ''), '{pii.AADHAAR}') AS aadhaar_ok FROM ({_IDS}) x)
  SELECT k, udyam_ok, aadhaar_ok, CASE WHEN udyam_ok THEN {_HMAC % "'UDYAM:' || udyam"} END AS udyam_token, CASE WHEN aadhaar_ok THEN {_HMAC % "'AADHAAR:' || replace(aadhaar, ' ', '')"} END AS aadhaar_token FROM i""")
def pii_other_tokens(spark, d):
    i = from_text(spark, d, _IDS)
    return i.select("k", pii.valid_udyam("udyam").alias("udyam_ok"), pii.valid_aadhaar("aadhaar").alias("aadhaar_ok"), pii.udyam_token("udyam", KEY).alias("udyam_token"), pii.aadhaar_token("aadhaar", KEY).alias("aadhaar_token"))


_FB = """SELECT 'F' || CAST(s_suppkey AS STRING) AS factory_license_no, 'WORKS ' || CAST(s_suppkey AS STRING) AS factory_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'AABCU1234R' END AS pan_of_occupier,
  'Partnership' AS ownership_type, 'Plot ' || CAST(s_suppkey AS STRING) AS factory_address, n_name AS city, n_name AS district, CAST(560000 + s_suppkey % 90 AS STRING) AS pin_code,
  CASE s_suppkey % 6 WHEN 0 THEN 'VALID' WHEN 1 THEN 'RENEWED' WHEN 2 THEN 'EXPIRED' WHEN 3 THEN 'REVOKED' WHEN 4 THEN '' ELSE 'odd' END AS license_status FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


@query(f"""SELECT factory_license_no AS record_id, 'factories_board' AS department, CAST(NULL AS VARCHAR) AS gstin, pan_of_occupier AS pan, factory_name AS business_name, factory_name AS trade_name, ownership_type AS legal_status,
  'Manufacturing' AS business_type, factory_address AS address_line1, '' AS address_line2, city, district, pin_code AS pincode,
  CASE license_status WHEN '' THEN NULL WHEN 'VALID' THEN 'Active' WHEN 'RENEWED' THEN 'Active' WHEN 'EXPIRED' THEN 'Suspended' WHEN 'REVOKED' THEN 'Cancelled' ELSE license_status END AS status FROM ({_FB}) x""")
def nrm_factories(spark, d):
    return normalize.normalised("factories_board", from_text(spark, d, _FB))


@query(f"{_EV} SELECT a, b, NOT conflict_pan AND NOT conflict_legal AS safe, CASE WHEN conflict_pan THEN 'Conflicting PAN' WHEN conflict_legal THEN 'Incompatible legal status' END AS reason FROM ev")
def rte_constant_split(spark, d):
    """Safe and blocked pairs where every pair has the constant confidence 0.85."""
    p = linkage.safety(_ev(spark, d).drop("conflict_pan", "conflict_legal", "far_apart", "safe").withColumn("confidence", F.lit(0.85)))
    return p.select("a", "b", "safe", F.when(F.col("conflict_pan"), "Conflicting PAN").when(F.col("conflict_legal"), "Incompatible legal status").alias("reason"))


@query(f"WITH sw AS ({ORACLE['saf_sweep']}) SELECT CAST(coalesce(min(pct) FILTER (round(tp / greatest(tp + fp, 1), 3) >= 0.99), 95) AS INT) AS auto_pct, (SELECT pct FROM sw ORDER BY cost, pct LIMIT 1) AS review_pct FROM sw")
def saf_recommend(spark, d):
    precise = F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), 3) >= 0.99
    return QUERIES["saf_sweep"](spark, d).agg(F.coalesce(F.min(F.when(precise, F.col("pct"))), F.lit(95)).alias("auto_pct"), F.min_by("pct", F.struct("cost", "pct")).alias("review_pct"))


@query(f"""{_EV} SELECT a, b, CAST(conflict_pan AS INT) + CAST(conflict_legal AS INT) AS hard, CAST(far_apart AS INT) AS soft,
  concat_ws('; ', CASE WHEN confidence < 0.65 THEN 'Confidence below review threshold' END, CASE WHEN pan_a = pan_b AND jaro_winkler_similarity(upper(trim(na)), upper(trim(nb))) < 0.5 THEN 'PAN match with unlike names' END) AS warnings FROM ev""")
def saf_evidence(spark, d):
    n = lambda c: F.col(c).cast("int")
    like = text.similar(*[text.trimmed(F.col(f"business_name_{x}")) for x in "ab"])
    alike = F.when((F.col("pan_token_a") == F.col("pan_token_b")) & (like < 0.5), "PAN match with unlike names")
    warnings = F.concat_ws("; ", F.when(F.col("confidence") < 0.65, "Confidence below review threshold"), alike)
    return _ev(spark, d).select("a", "b", (n("conflict_pan") + n("conflict_legal")).alias("hard"), n("far_apart").alias("soft"), warnings.alias("warnings"))


@query(f"""{_CC} SELECT 'node' AS kind, ubid AS source, '' AS target, 15 + 5 * count(*) AS size FROM ub GROUP BY ubid UNION ALL SELECT 'record', record_id, '', 10 FROM ub
  UNION ALL SELECT 'member', ubid, record_id, 0 FROM ub UNION ALL SELECT 'evidence', a, b, 0 FROM ev WHERE decision <> 'reject'""")
def clu_graph(spark, d):
    e = _kept(spark, d)
    m, row = _members(spark, d), lambda kind, x, y, n: (F.lit(kind).alias("kind"), x.alias("source"), y.alias("target"), n.cast("long").alias("size"))
    nodes = m.groupBy("ubid").count().select(*row("node", F.col("ubid"), F.lit(""), 15 + 5 * F.col("count")))
    parts = [m.select(*row("record", F.col("record_id"), F.lit(""), F.lit(10))), m.select(*row("member", F.col("ubid"), F.col("record_id"), F.lit(0))), e.filter("decision <> 'reject'").select(*row("evidence", F.col("a"), F.col("b"), F.lit(0)))]
    for p in parts:
        nodes = nodes.unionByName(p)
    return nodes


@query(f"{_CC}, s AS (SELECT ubid, CAST(bool_or(pan IS NOT NULL) AS INT) + CAST(bool_or(gstin IS NOT NULL) AS INT) + CAST(bool_or(email IS NOT NULL) AS INT) + CAST(bool_or(phone IS NOT NULL) AS INT) + CAST(bool_or(udyam_number IS NOT NULL) AS INT) AS score FROM ub GROUP BY 1) SELECT *, score >= 4 AS ready FROM s")
def clu_readiness(spark, d):
    """How many kinds of identifiers and contacts a cluster has; four make it ready."""
    return console.readiness(_members(spark, d))


#: The activity of a cluster: of all signals of its records' entities.
_FU = f"""{_CC}, signals AS (SELECT u.ubid AS entity_key, g.* EXCLUDE (entity_key) FROM ({SIGNALS_SQL}) g JOIN (SELECT DISTINCT ubid, entity_key FROM ub) u USING (entity_key)), {_F.partition("signals AS (" + SIGNALS_SQL + "), ")[2]}"""
_RISK = f"""{_FU}, unsafe AS (SELECT DISTINCT u.ubid FROM ev JOIN ub u ON u.record_id = ev.a WHERE NOT safe),
  rk AS (SELECT u.ubid, count(DISTINCT department) AS departments, count(DISTINCT pincode) AS pincodes, string_agg(DISTINCT pincode, ', ' ORDER BY pincode) AS places, count(DISTINCT business_name) AS names, max(c.status) AS abi, count(x.ubid) > 0 AS unsafe FROM ub u LEFT JOIN c ON c.entity_key = u.ubid LEFT JOIN unsafe x ON x.ubid = u.ubid GROUP BY 1),
  risk AS (SELECT *, least(100, CASE WHEN departments >= 3 THEN 15 ELSE 0 END + CASE abi WHEN 'UNCERTAIN' THEN 30 WHEN 'DORMANT' THEN 15 ELSE 0 END + CASE WHEN pincodes > 1 THEN 20 ELSE 0 END + CASE WHEN names > 1 THEN 10 ELSE 0 END + CASE WHEN unsafe THEN 15 ELSE 0 END) AS risk FROM rk)"""


def _cluster_activity(spark, d, members):
    """status and features of each cluster that has signals, by ubid."""
    own = members.select("ubid", "entity_key").distinct()
    s = signals(spark, d).join(own, "entity_key").drop("entity_key").withColumnRenamed("ubid", "entity_key")
    return activity.classified(activity.features(s, REFERENCE)).withColumnRenamed("entity_key", "ubid")


def _evidence_of_clusters(spark, d):
    """(ubid, a, b, decision, confidence) of each cluster and pair that touches it: the records bring their UBIDs to the pairs, so no pair is shuffled."""
    rows = linkage.checkpointed(_blocked_records(spark, d).join(_members(spark, d).select("record_id", "ubid"), "record_id"))
    return linkage.of_clusters(linkage.evidence_of(rows, ("ubid",)))


def _risk(spark, d):
    e = _ev(spark, d)
    m = _members(spark, d)
    return linkage.risk(m, e, _cluster_activity(spark, d, m))


@query(f"{_RISK} SELECT ubid, risk FROM risk")
def rsk_base(spark, d):
    return _risk(spark, d).select("ubid", "risk")


@query(f"""{_RISK} SELECT ubid, concat_ws('; ', CASE WHEN departments >= 3 THEN 'Complex multi-dept entity +15 medium' END, CASE abi WHEN 'UNCERTAIN' THEN 'Conflicting ABI signals +30 high' WHEN 'DORMANT' THEN 'Dormant classification +15 medium' END,
  CASE WHEN pincodes > 1 THEN 'Address inconsistency: ' || pincodes || ' pincodes (' || places || ') +20 high' END, CASE WHEN names > 1 THEN 'Name variations: ' || names || ' variants +10 low' END, CASE WHEN unsafe THEN 'Safety block on merge +15 high' END) AS factors FROM risk""")
def rsk_factors(spark, d):
    one = F.transform("risk_factors", lambda f: F.concat(f["factor"], F.lit(" +"), f["contribution"].cast("string"), F.lit(" "), f["severity"]))
    return _risk(spark, d).select("ubid", F.array_join(one, "; ").alias("factors"))


@query(f"{_RISK} SELECT CASE WHEN risk >= 50 THEN 'red' WHEN risk >= 25 THEN 'yellow' ELSE 'green' END AS band, count(*) AS n FROM risk GROUP BY 1")
def rsk_bands(spark, d):
    risk = F.col("risk")
    return _risk(spark, d).groupBy(F.when(risk >= 50, "red").when(risk >= 25, "yellow").otherwise("green").alias("band")).agg(F.count("*").alias("n"))


@query(f"""SELECT ubid, CASE WHEN count(pan) > 0 AND count(DISTINCT business_name) > 2 THEN 'Flagged' WHEN bool_or(coalesce(status, '') = 'CLOSED') THEN 'Watch' WHEN count(DISTINCT department) = 1 AND count(DISTINCT pincode) > 1 THEN 'Watch'
  WHEN count(DISTINCT department) = 1 AND min(days_since_any) < 30 THEN 'Watch' ELSE 'Clean' END AS flag FROM ({_CC} SELECT * FROM ub) u LEFT JOIN ({_F} SELECT entity_key, status, days_since_any FROM c) c USING (entity_key) GROUP BY 1""")
def rsk_flags(spark, d):
    return console.security_flags(_members(spark, d), _act(spark, d))


@query(f"""SELECT ubid, coalesce(min(status), 'UNKNOWN') AS status FROM ({_CC} SELECT * FROM ub) u LEFT JOIN ({_F} SELECT entity_key, status FROM c) c USING (entity_key) GROUP BY 1""")
def jn_cluster_status(spark, d):
    return _members(spark, d).join(_act(spark, d).select("entity_key", "status"), "entity_key", "left").groupBy("ubid").agg(F.coalesce(F.min("status"), F.lit("UNKNOWN")).alias("status"))


@query(f"{_CC} SELECT ubid, count(*) AS pairs FROM (SELECT DISTINCT u.ubid, e.a, e.b FROM ub u JOIN (SELECT a, b, a AS r FROM ev UNION ALL SELECT a, b, b FROM ev) e ON e.r = u.record_id) x GROUP BY 1")
def jn_cluster_evidence(spark, d):
    """How many evidence rows touch a cluster, on either side."""
    return _evidence_of_clusters(spark, d).groupBy("ubid").agg(F.count("*").alias("pairs"))


@query(f"{_CC} SELECT e.a, e.b, least(x.ubid, y.ubid) AS ubid FROM ev e JOIN ub x ON x.record_id = e.a JOIN ub y ON y.record_id = e.b WHERE decision = 'review'")
def rev_clusters(spark, d):
    e = _kept(spark, d)
    m = _members(spark, d)
    return linkage.sided(e.filter("decision = 'review'").select("a", "b"), m, ["ubid"]).select("a", "b", F.least("ubid_a", "ubid_b").alias("ubid"))


#: A log over the queue: each third case is assigned, of these each second decided later, of these each third taken back.
_LOG = f"""{_CASES}, i AS (SELECT *, CAST(substr(case_id, 5) AS INT) AS i FROM cases), log AS (SELECT case_id, 1 AS t, 'assign' AS decision, 'R' || (i % 4) AS reviewer FROM i WHERE i % 3 = 0
  UNION ALL SELECT case_id, 2, CASE i % 4 WHEN 0 THEN 'approve' WHEN 2 THEN 'reject' END, 'R' || (i % 4) FROM i WHERE i % 6 = 0 UNION ALL SELECT case_id, 3, 'undo', 'R' || (i % 4) FROM i WHERE i % 18 = 0),
  state AS (SELECT c.*, CASE WHEN l.decision IS NULL OR l.decision = 'undo' THEN 'pending' WHEN l.decision = 'assign' THEN 'in_review' ELSE 'completed' END AS status, CASE WHEN l.decision IN ('approve', 'reject') THEN l.decision END AS decision,
    CASE WHEN l.decision <> 'undo' THEN l.reviewer END AS reviewer FROM cases c LEFT JOIN (SELECT case_id, arg_max(decision, t) AS decision, arg_max(reviewer, t) AS reviewer FROM log GROUP BY 1) l USING (case_id))"""


def _log(spark, d):
    """(queue, log): assignments, decisions and what takes some back, as the console's functions write them."""
    q = tables.settled(_cases(spark, d), "review-cases")
    i = F.substring("case_id", 5, 6).cast("int")
    row = lambda ok, at, decision: q.filter(ok).select("case_id", F.lit(at).alias("at"), decision.alias("decision"), F.concat(F.lit("R"), i % 4).alias("reviewer"))
    log = row(i % 3 == 0, 1, F.lit("assign")).unionByName(row(i % 6 == 0, 2, F.when(i % 4 == 0, "approve").otherwise("reject")))
    log = tables.settled(log, "review-log")
    back = console.compensated(console.review_state(q, log), log, q.filter(i % 18 == 0), 3)
    return q, tables.settled(log.unionByName(back), "review-log")


@query(f"{_LOG} SELECT case_id, priority, status, decision, reviewer FROM state")
def rev_state(spark, d):
    """Every case as the latest row of the decision log leaves it."""
    return console.review_state(*_log(spark, d)).select("case_id", "priority", "status", "decision", "reviewer")


@query(f"{_LOG} SELECT case_id, label FROM (SELECT case_id, CASE decision WHEN 'approve' THEN 1 WHEN 'reject' THEN 0 END AS label FROM state) x WHERE label IS NOT NULL")
def rev_training(spark, d):
    return console.training_rows(console.review_state(*_log(spark, d))).select("case_id", "label")


@query(f"{_LOG} SELECT status, count(*) AS cases, min(case_id) AS first_case FROM state GROUP BY 1")
def rev_by_status(spark, d):
    return console.review_state(*_log(spark, d)).groupBy("status").agg(F.count("*").alias("cases"), F.min("case_id").alias("first_case"))


@query(f"""{_LOG} SELECT count(*) AS total_cases, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "in_review", "completed"))}, {", ".join(f"count(*) FILTER (status = 'pending' AND priority = '{p}') AS pending_{p}" for p in console.PRIORITIES)},
  round(count(*) FILTER (decision = 'approve') / nullif(count(*) FILTER (decision IN ('approve', 'reject')), 0), 3) AS approval_rate, count(DISTINCT reviewer) AS reviewers,
  (SELECT count(*) FROM log WHERE decision IN ('approve', 'reject')) AS total_reviewed, (SELECT count(*) FROM log WHERE decision = 'undo') AS rollback_count FROM state""")
def rev_statistics(spark, d):
    q, log = _log(spark, d)
    return console.review_statistics(console.review_state(q, log), log)


_FIRST = f"""{_CC}, edge1 AS (SELECT a AS x, b AS y FROM ev WHERE decision = 'auto_link' AND substr(b, 1, 2) <> 'SE' UNION SELECT b, a FROM ev WHERE decision = 'auto_link' AND substr(b, 1, 2) <> 'SE'),
  reach1(node, other) AS (SELECT x, y FROM edge1 UNION SELECT reach1.node, edge1.y FROM reach1 JOIN edge1 ON reach1.other = edge1.x),
  was AS (SELECT r.record_id, coalesce(least(r.record_id, m.least_other), r.record_id) AS root1 FROM records r LEFT JOIN (SELECT node, min(other) AS least_other FROM reach1 GROUP BY 1) m ON m.node = r.record_id)"""


def _united(spark, d):
    """Clusters of the links among two departments, then united by the links to the third."""
    links = _kept(spark, d).filter("decision = 'auto_link'").select("a", "b")
    late = F.col("b").startswith("SE")
    before = tables.settled(linkage.clusters(records(spark, d), links.filter(~late)), "clusters")
    return linkage.united(before, links.filter(late))


@query(f"{_CC} SELECT record_id, root, ubid FROM ub")
def clu_incremental(spark, d):
    """Members after new links were united with stored clusters: as a rebuild over all links."""
    return _united(spark, d)[0].select("record_id", "root", "ubid")


@query(f"""{_FIRST} SELECT 'UBID-KA-' || upper(substr(sha256(root1), 1, 12)) AS ubid, 'MERGED' AS status, u.ubid AS merged_into, count(*) AS moved, any_value(n.record_count) AS record_count
  FROM was JOIN ub u USING (record_id) JOIN (SELECT root, count(*) AS record_count FROM ub GROUP BY 1) n ON n.root = u.root WHERE root1 <> u.root GROUP BY root1, u.ubid""")
def clu_merge_log(spark, d):
    """The clusters that lost their UBID to another one, and the winner's count afterwards."""
    return _united(spark, d)[1]


@query()
def snk_keyed_ubids(spark, d):
    """The table of UBIDs, keyed at write time, after a first load and the merges of new links."""
    now, merges = _united(spark, d)
    merges = tables.settled(merges, "merges")
    store = keyed.KeyedTable(spark, f"{tables.shared_dir(spark)}/corvane/keyed-{uuid.uuid4().hex}", "ubid string, status string, merged_into string, record_count long", ["ubid"])
    store.put(merges.select("ubid", F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("merged_into"), F.col("moved").alias("record_count")), merge=False)
    store.put(merges.select("ubid", "status", "merged_into", F.lit(0).cast("long").alias("record_count")))
    store.put(now.groupBy("ubid").agg(F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("merged_into"), F.count("*").alias("record_count")))
    return store.current()


ORACLE["snk_keyed_ubids"] = f"{_FIRST}, merges AS ({ORACLE['clu_merge_log'].partition(_FIRST)[2]}) SELECT ubid, 'ACTIVE' AS status, CAST(NULL AS VARCHAR) AS merged_into, count(*) AS record_count FROM ub GROUP BY 1 UNION ALL SELECT ubid, 'MERGED', merged_into, 0 FROM merges"


@query(f"{_F} SELECT entity_key, CAST(floor(days_since_any / 30) AS BIGINT) AS months FROM c WHERE status = 'DORMANT' AND floor(days_since_any / 30) <= 24")
def acq_filtered(spark, d):
    months = F.floor(F.col("days_since_any") / 30)
    return _act(spark, d).filter((F.col("status") == "DORMANT") & (months <= 24)).select("entity_key", months.alias("months"))


@query(f"{_F} SELECT status, round(100.0 * count(*) / (SELECT count(*) FROM c), 4) AS share FROM c GROUP BY 1")
def acq_shares(spark, d):
    n = _act(spark, d).groupBy("status").agg(F.count("*").alias("n"))  # four rows at most
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("status", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("share"))


@query(f"""{_EV}, p AS (SELECT a, b, unnest(list_filter([
    CASE WHEN pan_a = pan_b THEN {{'place': 0, 'feature': 'PAN Token Match', 'size': 0.55::DOUBLE}} WHEN pan_a <> pan_b THEN {{'place': 1, 'feature': 'PAN Token Conflict', 'size': -0.40::DOUBLE}} END,
    CASE WHEN gst_a = gst_b THEN {{'place': 2, 'feature': 'GSTIN Match', 'size': 0.15::DOUBLE}} END, {{'place': 3, 'feature': 'Name Similarity', 'size': 0.30::DOUBLE * name_sim}},
    CASE WHEN da = db THEN {{'place': 4, 'feature': 'District Match', 'size': 0.05::DOUBLE}} END, CASE WHEN pa = pb THEN {{'place': 5, 'feature': 'Pincode Match', 'size': 0.05::DOUBLE}} END, CASE WHEN ha = hb THEN {{'place': 6, 'feature': 'Phone Match', 'size': 0.05::DOUBLE}} END,
    CASE WHEN la = lb THEN {{'place': 7, 'feature': 'Legal Status Match', 'size': 0.05::DOUBLE}} ELSE {{'place': 8, 'feature': 'Legal Status Conflict', 'size': -0.10::DOUBLE}} END], lambda x: x IS NOT NULL)) AS p FROM ev)
  SELECT a, b, p.place AS place, p.feature AS feature, round(p.size, 3) AS contribution, CASE WHEN p.size > 0 OR p.place = 3 THEN 'positive' ELSE 'negative' END AS direction,
    CASE WHEN abs(p.size) > 0.15 THEN 'strong' WHEN abs(p.size) > 0.05 THEN 'moderate' ELSE 'weak' END AS strength, CAST(trunc(abs(p.size * 100)) AS INT) AS bar_pct FROM p""")
def scr_contributions(spark, d):
    return attribution.additive(_ev(spark, d))


@query(f"""{_R}, t AS (SELECT record_id, business_name, pan FROM records WHERE department = 'commercial_taxes'), n AS (SELECT record_id, business_name || ' NEW' AS business_name, 'X' AS pan FROM records WHERE entity_key % 4 = 0)
  SELECT coalesce(t.record_id, n.record_id) AS record_id, coalesce(n.business_name, t.business_name) AS business_name, CASE WHEN t.record_id IS NOT NULL THEN t.pan ELSE n.pan END AS pan FROM t FULL JOIN n ON n.record_id = t.record_id""")
def snk_upserted(spark, d):
    r = records(spark, d)
    changes = r.filter("entity_key % 4 = 0").select("record_id", F.concat("business_name", F.lit(" NEW")).alias("business_name"), F.lit("X").alias("pan"))
    return console.upserted(r.filter("department = 'commercial_taxes'").select("record_id", "business_name", "pan"), changes, ["record_id"], ["business_name"])


@query()
def blk_metaphone(spark, d):
    """How many words of names share each Metaphone code; distinct words are coded."""
    words = records(spark, d).select(F.explode(F.split("business_name", r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("code", phonetics.metaphone_code(F.col("word"))).filter("code <> ''").groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("words"))


def _scorer(spark, d):
    """(features of all pairs, the calibrated scorer that the rule's labels of a bounded sample teach)."""
    x, described = _pair_features(spark, d), _described(spark, d)
    # the sample is drawn by keys, so features are made of its pairs alone
    drawn = tables.settled(learning.sampled(linkage.paired(described.select("record_id", "blocks", "made"), []).select("a", "b"), ["a", "b"]).select("a", "b"), "learning-pairs")
    return x, learning.fit_scorer(features.of_few(drawn, described).withColumn("label", learning.rule_label(F.concat("a", F.lit("___"), "b"))), ["a", "b"])


_RULE = "CASE WHEN pan_token_match > 0.8 OR (name_jaro_winkler > 0.85 AND address_sbert_cosine > 0.8) OR (name_jaro_winkler > 0.9 AND pincode_match > 0.8 AND substr(md5(a || '___' || b), 1, 2) < 'b3') THEN 1 ELSE 0 END"


@query(f"SELECT {_RULE} AS label, count(*) AS pairs FROM ({ORACLE['fea_pairs']}) f GROUP BY 1")
def clf_rule_labels(spark, d):
    x = _pair_features(spark, d, ("pan_token_match", "name_jaro_winkler", "address_sbert_cosine", "pincode_match"))
    return x.groupBy(learning.rule_label(F.concat("a", F.lit("___"), "b")).alias("label")).agg(F.count("*").alias("pairs"))


@query()
def clf_boosted(spark, d):
    """Raw score, calibrated confidence and decision of every pair by 300 trees of depth 6 and their cross-fitted calibration."""
    return learning.scored_pairs(*_scorer(spark, d))


@query()
def shp_boosted(spark, d):
    """Shapley values of all 16 features for each pair."""
    return learning.shapley_values(*_scorer(spark, d))


@query()
def clf_explained(spark, d):
    """The five features that count most in each pair that isn't rejected, and the decision in words."""
    x, scorer = _scorer(spark, d)
    scores = tables.settled(learning.scored_pairs(x, scorer).filter("decision <> 'reject'"), "clf-scores")
    own = x.join(scores.select("a", "b"), ["a", "b"])
    top = tables.settled(learning.top_contributors(own, learning.shapley_values(own, scorer), scorer.features), "clf-top")
    five = top.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda t: t["feature"]), ",").alias("top"))  # five at most
    return learning.explained(scores, top).join(five, ["a", "b"])


@query()
def act_model(spark, d):
    """Status and confidence of every entity of the records: the first rule that fires, else the four-class model that the rules' own entities teach."""
    t = tables.settled(learning.activity_table(signals(spark, d), records(spark, d).select("entity_key").distinct(), REFERENCE), "activity")
    places = F.create_map(*[F.lit(v) for i, s in enumerate(learning.STATUSES) for v in (s, i)])
    # where no rule fires, an entity without a readable date teaches what is uncertain
    taught = t.filter("rule <> 'none' or days_since_any < 0").withColumn("label", places[F.col("status")])
    return learning.classified_activity(t, learning.fit_activity(taught, ["entity_key"]))
