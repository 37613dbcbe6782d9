"""Registered queries of the linkage and activity operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane import tables
from corvane.functions import pii, text
from corvane.operators import activity, console, features, learning, linkage
from corvane.sources.records import RECORDS_SQL, SIGNALS_SQL, records, signals

KEY, REFERENCE = "test_key_for_proof", "2024-02-01"
QUERIES: dict = {}
ORACLE: dict = {}
_R = f"WITH records AS ({RECORDS_SQL})"
_SIM = """CASE WHEN x.bn IS NULL OR y.bn IS NULL OR x.bn = '' OR y.bn = '' THEN 0.0 WHEN x.bn = y.bn THEN 1.0 ELSE least(1.0,
  len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) + least(0.15, len(list_filter(range(1, least(length(x.s), length(y.s)) + 1), lambda i: substr(x.s, i, 1) = substr(y.s, i, 1))) / greatest(length(x.s), length(y.s)))) END"""
_GSTIN_OK, _PAN_OK = (f"coalesce(regexp_matches(upper(trim({c})), '{r}'), false)" for c, r in (("gstin", pii.GSTIN), ("pan", pii.PAN)))
#: Codes of words that are made of consonants, each followed by A, E, O or U: Soundex and Metaphone by their rules.
_SX = "'SX:' || substr(w, 1, 1) || rpad(substr(replace(substr(translate(w, 'BFPVCJKSZDTLMNRAEOU', '1111222223345560000'), 2), '0', ''), 1, 3), 3, '0')"
_MP = "'MP:' || translate(w, 'DVZCAEOU', 'TFSK')"
#: tok: pt and gt are the PAN and GSTIN that tokens are made of, equal where the tokens are.
_EV = f"""{_R}, tok AS (SELECT *, CASE WHEN coalesce(pan, '') <> '' THEN CASE WHEN {_PAN_OK} THEN upper(trim(pan)) END WHEN {_GSTIN_OK} THEN upper(substr(gstin, 3, 10)) END AS pt, CASE WHEN {_GSTIN_OK} THEN upper(trim(gstin)) END AS gt FROM records),
  named AS (SELECT *, upper(business_name) AS bn, replace(replace(upper(business_name), 'PVT', 'PRIVATE'), 'LTD', 'LIMITED') AS s,
    list_distinct(string_split(replace(replace(upper(business_name), 'PVT', 'PRIVATE'), 'LTD', 'LIMITED'), ' ')) AS w FROM tok),
  words AS (SELECT record_id, unnest(list_filter(string_split(upper(business_name), ' ')[1:3], lambda x: length(x) >= 3)) AS w FROM records),
  keys AS (SELECT record_id, 'pan' AS strategy, pt AS key FROM tok WHERE pt IS NOT NULL UNION SELECT record_id, 'gstin', gt FROM tok WHERE gt IS NOT NULL UNION SELECT record_id, 'phone', trim(phone) FROM tok WHERE trim(phone) <> ''
    UNION SELECT record_id, 'pin_prefix', pincode || ':' || upper(substr(business_name, 1, 3)) FROM tok WHERE pincode <> '' AND length(business_name) >= 3
    UNION SELECT record_id, 'phonetic', {_SX} FROM words UNION SELECT record_id, 'phonetic', {_MP} FROM words),
  sized AS (SELECT *, count(*) OVER (PARTITION BY strategy, key) AS n FROM keys),
  pairs AS (SELECT a.record_id AS a, b.record_id AS b, string_agg(DISTINCT a.strategy, ',' ORDER BY a.strategy) AS strategies FROM sized a JOIN sized b ON a.strategy = b.strategy AND a.key = b.key AND a.record_id < b.record_id WHERE a.n <= 1000 GROUP BY 1, 2),
  sim AS (SELECT p.*, x.pt AS pan_a, y.pt AS pan_b, x.gt AS gst_a, y.gt AS gst_b, upper(x.legal_status) AS la, upper(y.legal_status) AS lb, x.district AS da, y.district AS db, x.pincode AS pa, y.pincode AS pb, x.phone AS ha, y.phone AS hb,
    x.business_name AS na, y.business_name AS nb, x.department AS ta, y.department AS tb, x.entity_key AS ea, y.entity_key AS eb, {_SIM} AS name_sim FROM pairs p JOIN named x ON x.record_id = p.a JOIN named y ON y.record_id = p.b),
  conf AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN pan_a = pan_b THEN 0.55 WHEN pan_a <> pan_b THEN -0.40 ELSE 0.0 END + CASE WHEN gst_a = gst_b THEN 0.15 ELSE 0.0 END + 0.30 * name_sim + CASE WHEN da = db THEN 0.05 ELSE 0 END + CASE WHEN pa = pb THEN 0.05 ELSE 0 END
    + CASE WHEN ha = hb THEN 0.05 ELSE 0 END + CASE WHEN la = lb THEN 0.05 ELSE -0.10 END)) AS confidence, coalesce(pan_a <> pan_b, false) AS conflict_pan,
    (contains(la, 'PROPRIETORSHIP') AND (contains(lb, 'PRIVATE LIMITED') OR contains(lb, 'PUBLIC LIMITED'))) OR (contains(lb, 'PROPRIETORSHIP') AND (contains(la, 'PRIVATE LIMITED') OR contains(la, 'PUBLIC LIMITED')))
    OR (contains(la, 'PARTNERSHIP') AND contains(lb, 'PRIVATE LIMITED')) OR (contains(lb, 'PARTNERSHIP') AND contains(la, 'PRIVATE LIMITED'))
    OR (contains(la, 'LLP') AND contains(lb, 'PRIVATE LIMITED')) OR (contains(lb, 'LLP') AND contains(la, 'PRIVATE LIMITED')) AS conflict_legal,
    da <> db AND substr(pa, 1, 3) <> substr(pb, 1, 3) AS far_apart FROM sim),
  ev AS (SELECT *, NOT conflict_pan AND NOT conflict_legal AND confidence >= 0.65 AS safe, CASE WHEN confidence >= 0.92 AND NOT conflict_pan AND NOT conflict_legal THEN 'auto_link' WHEN confidence >= 0.65 THEN 'review' ELSE 'reject' END AS decision FROM conf)"""
_CC = f"""{_EV.replace("WITH records", "WITH RECURSIVE records")}, edge AS (SELECT a AS x, b AS y FROM ev WHERE decision = 'auto_link' UNION SELECT b, a FROM ev WHERE decision = 'auto_link'),
  reach(node, other) AS (SELECT x, y FROM edge UNION SELECT reach.node, edge.y FROM reach JOIN edge ON reach.other = edge.x),
  members AS (SELECT r.*, coalesce(least(r.record_id, m.least_other), r.record_id) AS root FROM records r LEFT JOIN (SELECT node, min(other) AS least_other FROM reach GROUP BY 1) m ON m.node = r.record_id),
  ub AS (SELECT *, 'UBID-KA-' || upper(substr(sha256(root), 1, 12)) AS ubid FROM members)"""
_S = f"WITH signals AS ({SIGNALS_SQL})"
_SINCE = lambda d: f"CASE WHEN TRY_CAST({d} AS DATE) IS NULL THEN -1 ELSE greatest(0, date_diff('day', TRY_CAST({d} AS DATE), DATE '{REFERENCE}')) END"
_F = f"""{_S}, s AS (SELECT *, {_SINCE("signal_date")} AS since FROM signals),
  v AS (SELECT entity_key, value, row_number() OVER (PARTITION BY entity_key ORDER BY signal_date NULLS FIRST, value) AS i FROM s WHERE signal_type = 'consumption' AND value IS NOT NULL),
  sl AS (SELECT entity_key, regr_slope(value, i) AS slope, max_by(value, i) AS last_value, count(*) AS n_values FROM v GROUP BY 1),
  g AS (SELECT entity_key, coalesce(arg_max(since, signal_date) FILTER (signal_type = 'filing'), -1) AS days_since_filing, count(*) FILTER (signal_type = 'filing' AND signal_date >= CAST(DATE '{REFERENCE}' - 365 AS VARCHAR) || 'T00:00:00+00:00') AS filings_12m,
    coalesce(arg_max(since, signal_date) FILTER (signal_type = 'inspection'), -1) AS days_since_inspection, coalesce(max(overdue_days) FILTER (overdue_days > 0), 0) AS max_overdue,
    count(*) FILTER (signal_type = 'renewal' AND signal_date >= CAST(DATE '{REFERENCE}' - 1095 AS VARCHAR) || 'T00:00:00+00:00') AS renewals_3y, count(*) FILTER (status = 'Active') AS n_active, count(*) FILTER (status = 'Cancelled') AS n_cancelled,
    count(DISTINCT department) FILTER (since < 365) AS departments_12m, {_SINCE("max(signal_date)")} AS days_since_any, bool_or(formal_closure AND signal_type = 'closure') AS formally_closed, count(*) AS n_signals FROM s GROUP BY 1),
  f AS (SELECT g.*, CASE WHEN n_values >= 2 THEN slope ELSE -1 END AS slope, CASE WHEN n_values >= 2 THEN last_value ELSE -1 END AS last_value FROM g LEFT JOIN sl USING (entity_key)),
  c AS (SELECT *, CASE WHEN formally_closed THEN 'explicit_closure' WHEN n_active = 0 AND n_cancelled > 0 THEN 'all_cancelled' WHEN departments_12m >= 3 AND days_since_any < 180 THEN 'multi_department' WHEN days_since_any >= 540 AND n_active > 0 THEN 'dormant' ELSE 'none' END AS rule,
    CASE WHEN formally_closed OR (n_active = 0 AND n_cancelled > 0) THEN 'CLOSED' WHEN departments_12m >= 3 AND days_since_any < 180 THEN 'ACTIVE' WHEN days_since_any >= 540 AND n_active > 0 THEN 'DORMANT' ELSE 'UNCERTAIN' END AS status FROM f)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SOURCES = ("customer", "supplier", "orders", "part", "nation")


def _blocked_records(spark, d):
    """The records with their blocks, a table that all queries of an application read."""
    return tables.once(spark, "blocked", d, _SOURCES, lambda: linkage.blocked(records(spark, d), KEY))


def _ev(spark, d):
    """The evidence of all candidate pairs, made as it is read: pairs grow with the square of their blocks, so they are never written."""
    return linkage.evidence_of(_blocked_records(spark, d))


def _kept(spark, d):
    """The evidence that isn't rejected, worked out once."""
    return tables.once(spark, "evidence", d, _SOURCES, lambda: linkage.kept_evidence(_blocked_records(spark, d)))


def _members(spark, d):
    """Cluster members; like the kept evidence, worked out once."""
    return tables.once(spark, "members", d, _SOURCES, lambda: linkage.clusters(records(spark, d), _kept(spark, d).filter("decision = 'auto_link'").select("a", "b")))


def _described(spark, d):
    """What features need of each record in a block."""
    return tables.once(spark, "described", d, _SOURCES, lambda: features.described(records(spark, d), KEY, blocks=_blocked_records(spark, d).select("record_id", "blocks", "made")))


def _pair_features(spark, d, names=features.NAMES):
    """The named features of all candidate pairs, made as they are read."""
    return features.of_pairs(_described(spark, d), names=names)


def _tokens(spark, d):
    return linkage.checkpointed(pii.tokenized(records(spark, d), KEY))


def _act(spark, d):
    return activity.classified(activity.features(signals(spark, d), REFERENCE))


@query(f"{_EV} SELECT decision, count(*) AS pairs, count(*) FILTER (conflict_pan OR conflict_legal) AS blocked FROM ev GROUP BY 1")
def flagship_decisions(spark, d):
    return _ev(spark, d).groupBy("decision").agg(F.count("*").alias("pairs"), F.count_if(F.col("conflict_pan") | F.col("conflict_legal")).alias("blocked"))


@query(f"{_R} SELECT * FROM records")
def src_records(spark, d):
    return records(spark, d)


@query(f"{_S} SELECT * FROM signals")
def src_signals(spark, d):
    return signals(spark, d)


@query(rf"""{_R} SELECT record_id, coalesce(regexp_matches(upper(trim(gstin)), '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$'), false) AS gstin_ok, coalesce(regexp_matches(upper(trim(pan)), '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$'), false) AS pan_ok,
  CASE WHEN regexp_matches(upper(trim(gstin)), '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$') THEN substr(gstin, 3, 10) END AS gstin_pan FROM records""")
def val_identifiers(spark, d):
    return records(spark, d).select("record_id", pii.valid_gstin("gstin").alias("gstin_ok"), pii.valid_pan("pan").alias("pan_ok"), pii.pan_of_gstin("gstin").alias("gstin_pan"))


def _pads():
    k = KEY.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


@query(f"{_R} SELECT record_id, sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || encode('PAN:' || pan)))) AS pan_token FROM records")
def pii_pan_token(spark, d):
    return records(spark, d).select("record_id", pii.pan_token("pan", KEY).alias("pan_token"))


@query(f"{_R} SELECT record_id, left(pan, 4) || '●●●●' || right(pan, 2) AS pan, left(gstin, 5) || '●●●●●●●●' || right(gstin, 2) AS gstin FROM records")
def pii_masks(spark, d):
    return records(spark, d).select("record_id", pii.mask_pan("pan").alias("pan"), pii.mask_gstin("gstin").alias("gstin"))


@query()
def pii_tokenized(spark, d):
    return pii.tokenized(records(spark, d), KEY)


@query(f"{_EV} SELECT a, b, strategies FROM pairs")
def blk_pairs(spark, d):
    return linkage.candidate_pairs(linkage.block_keys(_tokens(spark, d)))


def _blocked(strategy):
    f = lambda spark, d: linkage.candidate_pairs(linkage.block_keys(_tokens(spark, d), (strategy,)))
    f.__name__ = f"blk_{strategy}"
    query(f"{_EV} SELECT DISTINCT x.record_id AS a, y.record_id AS b, '{strategy}' AS strategies FROM sized x JOIN sized y USING (strategy, key) WHERE strategy = '{strategy}' AND x.record_id < y.record_id AND x.n <= 1000")(f)


for _strategy in linkage.STRATEGIES:
    _blocked(_strategy)


@query(f"{_EV} SELECT round(100 * (1 - (SELECT count(*) FROM pairs) / (n * (n - 1) / 2)), 6) AS reduction FROM (SELECT count(*) AS n FROM records)")
def blk_reduction(spark, d):
    r = records(spark, d)
    pairs = linkage.candidate_pairs(linkage.block_keys(_tokens(spark, d))).agg(F.count("*").alias("p"))
    return r.agg(F.count("*").alias("n")).join(pairs).select(F.round(100 * (1 - F.col("p") / (F.col("n") * (F.col("n") - 1) / 2)), 6).alias("reduction"))


@query(f"{_EV} SELECT a, b, round(name_sim, 6) AS name_sim, round(confidence, 6) AS confidence, conflict_pan, conflict_legal, far_apart, safe, decision FROM ev")
def evd_rows(spark, d):
    return _ev(spark, d).select("a", "b", F.round("name_sim", 6).alias("name_sim"), F.round("confidence", 6).alias("confidence"), "conflict_pan", "conflict_legal", "far_apart", "safe", "decision")


@query(f"""{_EV}, t AS (SELECT range + 50 AS pct FROM range(49)), e AS (SELECT CAST(floor(round(confidence, 9) * 100) AS INT) AS bin, ea = eb AS truth FROM ev)
  SELECT CAST(pct AS INT) AS pct, count(*) FILTER (bin >= pct AND truth) AS tp, count(*) FILTER (bin >= pct AND NOT truth) AS fp, count(*) FILTER (bin < pct AND truth) AS fn, count(*) FILTER (bin < pct AND NOT truth) AS tn,
  round(count(*) FILTER (bin >= pct AND truth) / greatest(count(*) FILTER (bin >= pct), 1), 4) AS precision, round(count(*) FILTER (bin >= pct AND truth) / greatest(count(*) FILTER (truth), 1), 4) AS recall,
  CAST(5 * count(*) FILTER (bin >= pct AND NOT truth) + count(*) FILTER (bin < pct AND truth) AS DOUBLE) AS cost FROM t, e GROUP BY 1""")
def saf_sweep(spark, d):
    return linkage.threshold_sweep(_ev(spark, d), F.col("entity_key_a") == F.col("entity_key_b"))


@query(f"{_CC} SELECT record_id, root, ubid FROM ub")
def clu_members(spark, d):
    return _members(spark, d).select("record_id", "root", "ubid")


@query(f"{_CC} SELECT ubid, count(*) AS total_records, count(DISTINCT department) AS departments_covered, min_by(business_name, record_id) AS business_name, string_agg(record_id, ',' ORDER BY record_id) AS record_ids, count(DISTINCT pincode) AS pincodes, count(DISTINCT business_name) AS names FROM ub GROUP BY 1")
def clu_attributes(spark, d):
    return linkage.cluster_attributes(_members(spark, d))


@query(f"{_CC} SELECT ubid, count(*) AS records, count(DISTINCT department) AS departments FROM ub GROUP BY 1 HAVING count(DISTINCT department) >= 2 ORDER BY records DESC, ubid LIMIT 20")
def clu_cross_department(spark, d):
    m = _members(spark, d).groupBy("ubid").agg(F.count("*").alias("records"), F.countDistinct("department").alias("departments"))
    return m.filter("departments >= 2").orderBy(F.desc("records"), "ubid").limit(20)


@query(f"{_CC} SELECT record_id, department FROM ub u WHERE NOT EXISTS (SELECT 1 FROM ub v WHERE v.ubid = u.ubid AND v.record_id <> u.record_id)")
def jn_unlinked(spark, d):
    m = _members(spark, d)
    linked = m.groupBy("ubid").count().filter("count > 1").select("ubid")
    return m.join(linked, "ubid", "left_anti").select("record_id", "department")


@query(f"""{_EV} SELECT printf('REV-%06d', row_number() OVER (ORDER BY a, b) - 1) AS case_id, a, b, CASE WHEN confidence >= 0.75 AND confidence < 0.85 THEN 'critical' WHEN confidence >= 0.85 AND confidence < 0.92 THEN 'high'
  WHEN confidence >= 0.70 AND confidence < 0.75 THEN 'normal' ELSE 'low' END AS priority FROM ev WHERE decision = 'review'""")
def rev_queue(spark, d):
    return linkage.review_queue(_kept(spark, d)).select("case_id", "a", "b", "priority")


@query(f"{_F} SELECT * REPLACE (round(slope, 6) AS slope, CAST(last_value AS DOUBLE) AS last_value) FROM f")
def act_features(spark, d):
    return activity.features(signals(spark, d), REFERENCE).withColumn("slope", F.round("slope", 6))


@query(f"{_F} SELECT entity_key, rule, status FROM c")
def act_status(spark, d):
    return _act(spark, d).select("entity_key", "rule", "status")


@query(f"{_F} SELECT status, count(*) AS n FROM c GROUP BY 1")
def acq_counts(spark, d):
    return _act(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{_F}, r AS ({RECORDS_SQL}) SELECT r.district, count(*) FILTER (c.status = 'ACTIVE') AS active, count(*) FILTER (c.status = 'DORMANT') AS dormant, count(*) FILTER (c.status = 'CLOSED') AS closed, count(*) FILTER (c.status = 'UNCERTAIN') AS uncertain
  FROM r LEFT JOIN c ON c.entity_key = r.entity_key GROUP BY 1""")
def acq_heatmap(spark, d):
    r, c = records(spark, d).select("district", "entity_key"), _act(spark, d).select("entity_key", "status")
    return r.join(c, "entity_key", "left").groupBy("district").agg(*[F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s.lower()) for s in ("ACTIVE", "DORMANT", "CLOSED", "UNCERTAIN")])


@query(f"{_R} SELECT department, count(*) AS records, min(record_id) AS first_id, count(pan) AS with_pan FROM records GROUP BY 1")
def biq_departments(spark, d):
    return records(spark, d).groupBy("department").agg(F.count("*").alias("records"), F.min("record_id").alias("first_id"), F.count("pan").alias("with_pan"))


@query(f"{_CC} SELECT DISTINCT ubid FROM ub u WHERE EXISTS (SELECT 1 FROM ub v WHERE v.ubid = u.ubid AND upper(v.district) LIKE '%ON%') AND EXISTS (SELECT 1 FROM ub v WHERE v.ubid = u.ubid AND v.department = 'commercial_taxes')")
def biq_conjunctive(spark, d):
    m = _members(spark, d).groupBy("ubid").agg(F.max(F.contains(F.upper("district"), F.lit("ON"))).alias("x"), F.max(F.col("department") == "commercial_taxes").alias("y"))
    return m.filter("x and y").select("ubid")


@query(f"{_EV} SELECT count(*) AS pairs, count(*) FILTER (decision <> 'reject') AS links, round(avg(confidence), 6) AS mean_confidence FROM ev")
def run_metrics(spark, d):
    return _ev(spark, d).agg(F.count("*").alias("pairs"), F.count_if(F.col("decision") != "reject").alias("links"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


_STOP = "('PVT', 'LTD', 'PRIVATE', 'LIMITED', 'AND', '&', 'THE', '')"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: substr(' ' || {0} || ' ', i, 3)))"
_COS = lambda x, y: f"coalesce(CASE WHEN {x} <> '' AND {y} <> '' THEN len(list_intersect({_GRAMS.format(x)}, {_GRAMS.format(y)})) / sqrt(len({_GRAMS.format(x)}) * len({_GRAMS.format(y)})) END, 0.0)"
_SAME = lambda c: f"CASE WHEN coalesce(upper(trim(x.{c})), '') <> '' AND upper(trim(x.{c})) = upper(trim(y.{c})) THEN 1.0::DOUBLE ELSE 0 END"
_LIKE = lambda c: f"coalesce(CASE WHEN trim(x.{c}) <> '' AND trim(y.{c}) <> '' THEN round(jaro_winkler_similarity(upper(trim(x.{c})), upper(trim(y.{c}))), 6) END, 0.0)"
_ADDRESS = lambda t: f"concat_ws(' ', nullif({t}.address_line1, ''), nullif({t}.address_line2, ''), nullif({t}.city, ''), nullif({t}.district, ''), nullif({t}.pincode, ''))"
_PHONE = lambda t: f"right(regexp_replace({t}.phone, '[\\s\\-+]', '', 'g'), 10)"


@query(f"""{_EV}, w AS (SELECT record_id, list_distinct(list_filter(string_split(upper(business_name), ' '), lambda v: v NOT IN {_STOP})) AS t, upper(trim(business_name)) AS n FROM records),
  j AS (SELECT p.a, p.b, u.n AS n1, v.n AS n2, u.t AS t1, v.t AS t2, {_ADDRESS("x")} AS a1, {_ADDRESS("y")} AS a2, CASE WHEN x.pt = y.pt THEN 1.0::DOUBLE ELSE 0 END AS pan_token_match, CASE WHEN x.gt = y.gt THEN 1.0::DOUBLE ELSE 0 END AS gstin_token_match, {_SAME("udyam_number")} AS udyam_token_match,
    {_LIKE("business_name")} AS name_jaro_winkler, {_LIKE("trade_name")} AS trade_name_jaro_winkler, {_SAME("pincode")} AS pincode_match, {_SAME("district")} AS district_match, {_LIKE("city")} AS city_jaro_winkler,
    CASE WHEN length({_PHONE("x")}) = 10 AND {_PHONE("x")} = {_PHONE("y")} THEN 1.0::DOUBLE ELSE 0 END AS phone_match, {_SAME("email")} AS email_match, {_LIKE("legal_status")} AS legal_status_match, {_LIKE("business_type")} AS business_type_match
    FROM pairs p JOIN tok x ON x.record_id = p.a JOIN tok y ON y.record_id = p.b JOIN w u ON u.record_id = p.a JOIN w v ON v.record_id = p.b)
  SELECT * EXCLUDE (n1, n2, t1, t2, a1, a2), round(1 - levenshtein(n1, n2) / greatest(length(n1), length(n2)), 6) AS name_levenshtein_norm, round(len(list_intersect(t1, t2)) / len(list_distinct(t1 || t2)), 6) AS name_token_overlap,
    round({_COS("n1", "n2")}, 6) AS name_sbert_cosine, round({_COS("a1", "a2")}, 6) AS address_sbert_cosine FROM j""")
def fea_pairs(spark, d):
    """All 16 features of each candidate pair; Jaro-Winkler runs on distinct values in Arrow batches, the rest in built-ins."""
    return _pair_features(spark, d)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def str_cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(n, e.vec_id == n.a).select("a", "b", F.round(text.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query(f"""{_EV} SELECT a, b, concat_ws('; ', CASE WHEN pan_a = pan_b THEN 'PAN: EXACT MATCH (+0.55)' WHEN pan_a <> pan_b THEN 'PAN: DIFFERENT (-0.40)' END, CASE WHEN gst_a = gst_b THEN 'GSTIN: MATCH (+0.15)' END,
  printf('Name sim: %.2f (+%.3f)', floor(name_sim * 100 + 0.5) / 100, floor(name_sim * 300 + 0.5) / 1000), CASE WHEN da = db THEN 'District: MATCH (+0.05)' END, CASE WHEN pa = pb THEN 'Pincode: MATCH (+0.05)' END, CASE WHEN ha = hb THEN 'Phone: MATCH (+0.05)' END,
  CASE WHEN la = lb THEN 'Legal status: MATCH (+0.05)' ELSE 'Legal status: CONFLICT (-0.10)' END) AS explanation FROM ev""")
def scr_explanations(spark, d):
    return _ev(spark, d).select("a", "b", linkage.explanation().alias("explanation"))


@query(f"{_EV}, t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.92, 0.95, 0.98]) AS t) SELECT CAST(round(t * 100) AS INT) AS pct, count(*) FILTER (confidence >= t AND safe) AS auto, count(*) FILTER (confidence < t AND confidence >= 0.65) AS review, count(*) FILTER (confidence < 0.65) AS rejected, count(*) AS total, greatest(0, 100 - CAST(floor(t * 100) AS INT)) AS fp_risk FROM t, (SELECT round(confidence, 4) AS confidence, safe FROM ev) e GROUP BY t")
def saf_calibration(spark, d):
    return linkage.calibration(_ev(spark, d))


_RANK = "CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END"


def _cases(spark, d):
    return linkage.review_queue(_kept(spark, d)).select("case_id", "a", "b", "priority", F.round("confidence", 6).alias("confidence"))


_CASES = f"""{_EV}, cases AS (SELECT printf('REV-%06d', row_number() OVER (ORDER BY a, b) - 1) AS case_id, a, b, CASE WHEN confidence >= 0.75 AND confidence < 0.85 THEN 'critical' WHEN confidence >= 0.85 AND confidence < 0.92 THEN 'high'
  WHEN confidence >= 0.70 AND confidence < 0.75 THEN 'normal' ELSE 'low' END AS priority, round(confidence, 6) AS confidence FROM ev WHERE decision = 'review')"""


@query(f"{_CASES} SELECT case_id, priority, confidence FROM cases ORDER BY {_RANK}, abs(confidence - 0.785), case_id LIMIT 10")
def rev_next(spark, d):
    """The ten cases that a reviewer gets first."""
    q = _cases(spark, d).withColumn("status", F.lit("pending"))
    return console.next_cases(q).select("case_id", "priority", "confidence")


@query(f"{_CC}, act AS (SELECT entity_key, max(status) AS status FROM (SELECT user_id AS entity_key, event_type AS status FROM events) GROUP BY 1) SELECT u.ubid, coalesce(max(a.status), 'UNKNOWN') AS status FROM ub u LEFT JOIN act a ON a.entity_key = u.entity_key GROUP BY 1")
def jn_cluster_events(spark, d):
    act = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("entity_key")).agg(F.max("event_type").alias("status"))
    return _members(spark, d).join(act, "entity_key", "left").groupBy("ubid").agg(F.coalesce(F.max("status"), F.lit("UNKNOWN")).alias("status"))


@query(f"{_R} SELECT district, department, count(*) AS n, grouping(district) + grouping(department) AS level FROM records GROUP BY ROLLUP (district, department)")
def ext_rollup(spark, d):
    return records(spark, d).rollup("district", "department").agg(F.count("*").alias("n"), (F.grouping("district") + F.grouping("department")).cast("long").alias("level"))


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def ext_hourly(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(F.count("*").alias("n"))


@query()
def ext_minhash_names(spark, d):
    """Pairs of similar names by MinHash LSH."""
    return learning.minhash_pairs(records(spark, d))


@query(f"{_EV} SELECT a || '___' || b AS pair_id, a AS record_id FROM ev WHERE decision <> 'reject' UNION ALL SELECT a || '___' || b, b FROM ev WHERE decision <> 'reject'")
def snk_linked_via(spark, d):
    e = _kept(spark, d).withColumn("pair_id", F.concat("a", F.lit("___"), "b"))
    return e.select("pair_id", F.explode(F.array("a", "b")).alias("record_id"))


@query(f"{_EV}, l AS (SELECT a, b, confidence FROM ev WHERE decision <> 'reject') SELECT a AS source, b AS other, round(confidence, 6) AS confidence FROM l UNION ALL SELECT b, a, round(confidence, 6) FROM l")
def jn_evidence_paths(spark, d):
    e = _kept(spark, d).withColumn("c", F.round("confidence", 6))
    return e.select(F.col("a").alias("source"), F.col("b").alias("other"), F.col("c").alias("confidence")).unionByName(e.select(F.col("b").alias("source"), F.col("a").alias("other"), F.col("c").alias("confidence")))


@query(f"{_F} SELECT 'DORMANCY' AS kind, CAST(count(*) FILTER (status = 'DORMANT') * 100 / count(*) >= 15 AS BOOLEAN) AS raised, count(*) FILTER (status = 'DORMANT') AS n FROM c UNION ALL SELECT 'UNCERTAIN', count(*) FILTER (status = 'UNCERTAIN') > 0, count(*) FILTER (status = 'UNCERTAIN') FROM c")
def biq_alerts(spark, d):
    one = _act(spark, d).agg(F.count("*").alias("all"), F.count_if(F.col("status") == "DORMANT").alias("dormant"), F.count_if(F.col("status") == "UNCERTAIN").alias("uncertain"))
    kinds = F.array(F.struct(F.lit("DORMANCY").alias("kind"), (F.col("dormant") * 100 / F.col("all") >= 15).alias("raised"), F.col("dormant").alias("n")), F.struct(F.lit("UNCERTAIN").alias("kind"), (F.col("uncertain") > 0).alias("raised"), F.col("uncertain").alias("n")))
    return one.select(F.explode(kinds).alias("x")).select("x.*")


@query(f"{_CC} SELECT ubid, CASE WHEN bool_or(contains(lower(ubid), 'ct-000001')) THEN 'UBID' WHEN bool_or(contains(lower(business_name), 'ct-000001')) THEN 'name' ELSE 'record id' END AS reason FROM ub GROUP BY 1 HAVING bool_or(contains(lower(record_id), 'ct-000001'))")
def biq_search(spark, d):
    return console.searched(_members(spark, d), "ct-000001")


@query(f"""{_CC}, alone AS (SELECT ubid FROM ub GROUP BY 1 HAVING count(*) = 1) SELECT event, count(*) AS n FROM (SELECT 'ingested' AS event, a FROM ev WHERE decision = 'auto_link' UNION ALL SELECT 'ingested', b FROM ev WHERE decision = 'auto_link'
  UNION ALL SELECT 'auto_linked', a FROM ev WHERE decision = 'auto_link' UNION ALL SELECT 'sent_to_review', a FROM ev WHERE decision = 'review' UNION ALL SELECT 'standalone', ubid FROM alone) x GROUP BY 1""")
def aud_events(spark, d):
    e = _kept(spark, d)
    return console.audit_events(e, _members(spark, d)).groupBy("event").agg(F.count("*").alias("n"))
