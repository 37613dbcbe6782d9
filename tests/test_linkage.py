import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane import tables
from corvane.functions import pii, text
from corvane.operators import features, linkage, normalize
from corvane.operators.components import components as connected
from corvane.plans.registry import QUERIES
from corvane.sources import records

SF = "/root/testdata/sf0.001"


def test_flagship_counts(spark):
    got = {r.decision: (r.pairs, r.blocked) for r in QUERIES["flagship_decisions"](spark, SF).collect()}
    assert got == {'review': (21, 6), 'reject': (2021, 1897), 'auto_link': (34, 0)}


def test_pan_token_is_hmac(spark):
    df = spark.createDataFrame([("AABCU1234R", "29AABCU1234R1Z5"), ("AAAA0001A", "29AABCU1234R1Z5"), (None, "29AABCU1234R1Z5")], "pan string, gstin string")
    got = [r.pan_token for r in pii.tokenized(df, "test_key_for_proof").collect()]
    want = hmac.new(b"test_key_for_proof", b"PAN:AABCU1234R", hashlib.sha256).hexdigest()
    assert want == "ae07843948228c1e5f654de6a1b24430085d83269236b339d42dc78cd57d7c91"
    assert got == [want, None, want]


def test_aadhaar(spark):
    df = spark.createDataFrame([("2345 6789-0123",), ("1234 5678 9012",), (None,)], "a string")
    assert [r.v for r in df.select(pii.valid_aadhaar("a").alias("v")).collect()] == [True, False, False]


def test_chain_is_one_component(spark):
    """Ordered ids are the worst case: pointers double, so rounds are as many as the length's binary digits."""
    edges = spark.range(10_000).selectExpr("format_string('n%05d', id) as a", "format_string('n%05d', id + 1) as b")
    rounds = []
    labels = connected(edges, lambda df, name: rounds.append(name) or tables.settled(df, name))
    assert [tuple(r) for r in labels.groupBy("label").count().collect()] == [("n00000", 10_001)]
    assert rounds.count("cc-step") <= 20


def test_components_of_random_links(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)] + [(5, 5)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == label
    assert linkage.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_block_cap(spark):
    keys = spark.range(1001).select(F.col("id").cast("string").alias("record_id"), F.lit("pan").alias("strategy"), F.when(F.col("id") < 1000, "x").otherwise("x").alias("key"))
    assert linkage.candidate_pairs(keys).count() == 0
    assert linkage.candidate_pairs(keys.filter("record_id <> '5'")).count() == 1000 * 999 // 2


def test_pairs_are_not_written(spark, tmp_path, monkeypatch):
    """Pairs grow with the square of their blocks: what is written for the counts of all pairs has rows as records and keys have."""
    (tmp_path / "sf").symlink_to(SF)
    written, settled = [], tables.settled
    monkeypatch.setattr(tables, "settled", lambda df, name, keep=False: (out := settled(df, name, keep), written.append(out.count()))[0])
    pairs = QUERIES["flagship_decisions"](spark, str(tmp_path / "sf")).agg(F.sum("pairs")).first()[0]
    assert pairs == 2076 and 0 < max(written) < pairs // 2


def test_pair_of_several_blocks_comes_once(spark):
    rows = [("x", s, k) for s, k in (("pan", "p"), ("phone", "1"), ("phonetic", "SX:A"))] + [("y", s, k) for s, k in (("phone", "1"), ("phonetic", "SX:A"), ("gstin", "g"))]
    got = linkage.candidate_pairs(spark.createDataFrame(rows, "record_id string, strategy string, key string")).collect()
    assert [tuple(r) for r in got] == [("x", "y", "phone,phonetic")]


def test_kept_evidence_is_all_that_is_not_rejected(spark):
    """A GSTIN alone can carry a pair to review, with a PAN that isn't valid; nothing but PAN and GSTIN can."""
    row = ("ACME FOODS", "d", "29AABCU1234R1Z5", "Partnership", "BIDAR", "585401", "98450", 1)
    same = [(f"R{i}", pan, *row) for i, pan in enumerate(("bad", "bad", "AABCU1234R", "AABCU1234R", ""))] + [("R5", "", *row[:2], None, *row[3:]), ("R6", "", *row[:2], None, *row[3:])]
    odd = spark.createDataFrame(same, "record_id string, pan string, business_name string, department string, gstin string, legal_status string, district string, pincode string, phone string, entity_key long")
    for r in (odd, records.records(spark, SF)):
        rows = linkage.blocked(r, "k")
        want = linkage.evidence_of(rows).filter("decision <> 'reject'")
        got = linkage.kept_evidence(rows)
        assert want.count() > 0 and sorted(map(tuple, got.select("a", "b", "strategies", "confidence", "decision").collect())) == sorted(map(tuple, want.select("a", "b", "strategies", "confidence", "decision").collect()))


def test_pairs_with_an_equal_token_meet_once(spark):
    """Where more records than the cap share a PAN, its block is gone and they meet in their other ones; of two equal tokens one makes the pair."""
    rows = [("a", "p", "g", "1"), ("b", "p", "g", "1"), ("c", "p", "", "1"), ("d", "p", None, ""), ("e", "q", "h", "2"), ("f", "q", "h", "2"), ("g", None, "h", "2"), ("h", "r", None, "2")]
    rows = spark.createDataFrame(rows, "record_id string, pan_token string, gstin_token string, phone string")
    keys = linkage.block_keys(rows.withColumns({"business_name": F.lit(None).cast("string"), "pincode": F.lit(None).cast("string")}), ("pan", "gstin", "phone"))
    rows = rows.join(linkage.blocks(keys, 3), "record_id")
    got = linkage.paired(rows, ["pan_token", "gstin_token"], ("pan", "gstin")).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [("a", "b"), ("a", "c"), ("b", "c"), ("e", "f"), ("e", "g"), ("f", "g")]


def test_blocks_within_lesser_ones_make_no_pairs(spark):
    rows = [(r, "phonetic", "SX:A") for r in "abcd"] + [(r, "pan", "p") for r in "ab"] + [(r, "phone", "1") for r in "de"]
    keys = spark.createDataFrame(rows, "record_id string, strategy string, key string")
    assert {r.record_id: (len(r.blocks), len(r.made)) for r in linkage.blocks(keys).collect()} == {"a": (2, 1), "b": (2, 1), "c": (1, 1), "d": (2, 2), "e": (1, 1)}
    got = linkage.candidate_pairs(keys).collect()
    assert sorted(map(tuple, got)) == [("a", "b", "pan,phonetic"), ("a", "c", "phonetic"), ("a", "d", "phonetic"), ("b", "c", "phonetic"), ("b", "d", "phonetic"), ("c", "d", "phonetic"), ("d", "e", "phone")]


def test_records_are_dealt_once_for_both_sides(spark):
    """The pairs' two sides read one shuffle; words and light vectors aren't in it."""
    rows = spark.createDataFrame([("x", [1, 7], [1], "A B", "R")], "record_id string, blocks array<long>, made array<long>, name string, address string")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        p = linkage.paired(rows, ["name", "address"], beside=lambda df: features.worded(df, text.TRIGRAMS)).select("a", "b", "words_a", "words_b", "name_vector_a", "name_vector_b", "address_vector_a", "address_vector_b")
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") == 1 and plan.count("+- Exchange hashpartitioning") == 1
        assert "array_distinct" in plan.partition("+- Exchange hashpartitioning")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_partitions_grow_with_dealt_records(spark):
    """However few partitions the session has, one gets a bounded number of records, which are sorted in memory."""
    n = 6 * linkage.DEALT
    rows = spark.range(n).selectExpr("format_string('r%06d', id) as record_id", "array(id div 2 * 5) as blocks", "array(id div 2 * 5) as made", "array() as wide", "concat('t', id div 2) as pan_token")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        for tokens in ((), ("pan",)):
            pairs = linkage.paired(rows, ["pan_token"], tokens).withColumn("part", F.spark_partition_id())
            got = pairs.groupBy("part").count().collect()
            assert len(got) == 7 and sum(r["count"] for r in got) == n // 2 and max(r["count"] for r in got) < linkage.DEALT
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scores_wait_for_no_python(spark):
    """Rows that wait for a Python function are queued on disk where memory is short; all pairs' scores do without one."""
    plan = QUERIES["flagship_decisions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_light_trigrams_are_the_encoder_s(spark):
    texts = ["", "A", "AB", "ABAB ABAB", "É😀 X"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.TRIGRAMS.light(F.col("t")).alias("v")).collect()
    assert {r.t: sorted(r.v) for r in got} == {t: v.tolist() for t, v in zip(texts, text.TRIGRAMS.encode(texts))}


def test_kept_tables_leave_nothing_else(spark, tmp_path):
    """What was written on the way to a table that is kept is deleted."""
    made = []

    def build():
        made.append(tables.settled(spark.range(3), "way"))
        return made[0].filter("id > 0")

    kept = tables.once(spark, "kept-test", str(tmp_path), (), build)
    assert kept.count() == 2
    folder = spark._jvm.org.apache.hadoop.fs.Path(made[0].inputFiles()[0]).getParent() if made[0].inputFiles() else None
    assert folder is None or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def test_incompatible_legal_forms(spark):
    p = spark.createDataFrame([("Proprietorship", "Private Limited Company", 0.81)], "legal_status_a string, legal_status_b string, confidence double")
    for c in ("pan_token_a", "pan_token_b", "district_a", "district_b", "pincode_a", "pincode_b"):
        p = p.withColumn(c, F.lit(None).cast("string"))
    r = linkage.safety(p).first()
    assert r.conflict_legal and not r.conflict_pan and not r.safe


def test_json_shapes(spark, tmp_path):
    row = {"record_id": "A", "pan": "AABCU1234R"}
    for n, body in (("a", [row]), ("b", {"records": [row]})):
        (tmp_path / f"{n}.json").write_text(json.dumps(body))
        assert records.read_records(spark, str(tmp_path / f"{n}.json")).first().record_id == "A"
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path / "c.json"))
    with pytest.raises(ValueError):
        records.read_records(spark, "x.orc")


def test_factory_status(spark):
    df = spark.createDataFrame([("RENEWED",), ("EXPIRED",), ("REVOKED",), ("odd",), ("",)], "s string")
    assert [r.v for r in df.select(normalize.factory_status(F.col("s")).alias("v")).collect()] == ["Active", "Suspended", "Cancelled", "odd", None]


def test_activity_rules_all_fire(spark):
    got = {r.rule: r.n for r in QUERIES["act_status"](spark, "/root/testdata/sf0.01").groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert got == {"explicit_closure": 7, "all_cancelled": 13, "multi_department": 51, "dormant": 22, "none": 57}


def test_every_strategy_and_term_occurs(spark):
    """The derived records give each kind of block, score term and risk factor at least one row."""
    for strategy in linkage.STRATEGIES:
        assert QUERIES[f"blk_{strategy}"](spark, SF).limit(1).count() == 1
    text = QUERIES["scr_explanations"](spark, SF).agg(F.concat_ws("|", F.collect_set("explanation")).alias("t")).first().t
    assert all(x in text for x in ("PAN: EXACT", "PAN: DIFFERENT", "GSTIN: MATCH", "District", "Pincode", "Phone", "Legal status: MATCH", "Legal status: CONFLICT"))


def test_days_since(spark):
    from corvane.operators import activity

    texts = [("2024-01-31",), ("2024-01-31T23:59:59Z",), ("2024-01-31T12:00:00",), ("2024-01-30T23:00:00-05:00",), ("2025-01-01",), ("no date",), (None,)]
    got = [r.v for r in spark.createDataFrame(texts, "t string").select(activity.days_since(F.col("t"), "2024-02-01").alias("v")).collect()]
    assert got == [1, 0, 0, 0, 0, -1, -1]


def test_jaro_winkler_of_many_pairs():
    from corvane.functions.text import jaro_winkler

    pairs = [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("", "", 1.0), ("A", "", 0.0), ("ABC", "XYZ", 0.0), ("SAME é", "SAME é", 1.0)]
    assert all(abs(x - w) < 1e-4 for x, (_, _, w) in zip(jaro_winkler([p[0] for p in pairs], [p[1] for p in pairs]), pairs))


def test_pairs_wait_for_no_python_function(spark):
    """Rows beside a Python function's arguments are queued, on disk where memory is short; pairs pass through Arrow batches instead."""
    for name in ("fea_pairs", "fmt_features", "clf_rule_labels"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "MapInArrow" in plan
    df = spark.createDataFrame([(1, "MARTHA", "MARHTA"), (2, "", ""), (3, None, "X"), (4, "X", ""), (5, "MARTHA", "MARTHA")], "id int, x string, y string")
    got = {r.id: round(r.s, 4) for r in text.with_similar(df, {"s": ("x", "y")}).collect()}
    assert got == {1: 0.9611, 2: 0.0, 3: 0.0, 4: 0.0, 5: 1.0}
    assert text.with_similar(df.limit(0), {"s": ("x", "y")}).collect() == []
