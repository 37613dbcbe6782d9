import random

import pytest

from corvane.operators import console, keyed, linkage


def test_upsert_changes_only_what_it_may(spark):
    t = spark.createDataFrame([("a", "old", "x"), ("b", "old", "y")], "id string, status string, kind string")
    c = spark.createDataFrame([("a", "new", "z"), ("c", "new", "w")], "id string, status string, kind string")
    assert sorted(map(tuple, console.upserted(t, c, ["id"], ["status"]).collect())) == [("a", "new", "x"), ("b", "old", "y"), ("c", "new", "w")]


def test_questions():
    p = console.parsed_question("inactive in Mysuru 570001 for 18 months", ["Mysuru"], ["factories_board"])
    assert p == {"status": "ACTIVE", "district": "Mysuru", "pincode": "570001", "months": 18}
    assert console.parsed_question("textiles", [], []) == {"keyword": "textiles"}


def test_search_reasons(spark):
    m = spark.createDataFrame([("U1", "CT-1", "ACME", "P1", None, "560001"), ("U2", "CT-2", "OTHER", "ACMEP", None, "560002")], "ubid string, record_id string, business_name string, pan string, gstin string, pincode string")
    assert {r.ubid: r.reason for r in console.searched(m, "acme").collect()} == {"U1": "name", "U2": "PAN"}


QUEUE = [("1", "low", 0.7), ("2", "critical", 0.8), ("3", "critical", 0.79), ("4", "high", 0.9), ("5", "critical", 0.77)]
LOG = "case_id string, at int, decision string, reviewer string"


def test_a_log_of_decisions(spark, tmp_path):
    q = spark.createDataFrame(QUEUE, "case_id string, priority string, confidence double")
    path = f"file://{tmp_path}/log"
    log = keyed.appended(spark, path, spark.createDataFrame([("1", 1, "approve", "r"), ("4", 1, "approve", "s")], LOG))
    # by priority, then nearest to 0.785, then by id
    assert [r.case_id for r in console.next_cases(console.review_state(q, log)).collect()] == ["3", "2", "5"]
    log = keyed.appended(spark, path, console.assigned(console.review_state(q, log), "t", 2, n=2))
    state = console.review_state(q, log)
    assert {r.case_id: (r.status, r.reviewer) for r in state.collect()} == {"1": ("completed", "r"), "2": ("in_review", "t"), "3": ("in_review", "t"), "4": ("completed", "s"), "5": ("pending", None)}
    log = keyed.appended(spark, path, spark.createDataFrame([("3", 3, "reject", "t"), ("2", 3, "defer", "t")], LOG))
    assert {r.case_id: r.label for r in console.training_rows(console.review_state(q, log)).collect()} == {"1": 1, "3": 0, "4": 1}
    # taking back adds rows; case 2 isn't decided for or against, case 5 not at all
    log = keyed.appended(spark, path, console.compensated(console.review_state(q, log), log, q.filter("case_id in ('1', '2', '5')"), 4))
    r = console.review_statistics(console.review_state(q, log), log).first()
    assert (r.total_cases, r.pending, r.in_review, r.completed, r.pending_low, r.pending_critical) == (5, 2, 0, 3, 1, 1)
    assert (r.approval_rate, r.reviewers, r.total_reviewed, r.rollback_count) == (0.5, 2, 4, 1)
    assert log.count() == 7


def test_keys_are_unique_when_they_are_written(spark, tmp_path):
    store = keyed.registry(spark, f"file://{tmp_path}/registry")["records"]
    rows = lambda *r: spark.createDataFrame(list(r), "department string, record_id string, business_name string, status string, more int")
    assert store.current().count() == 0
    assert store.put(rows(("ct", "1", "A", "Active", 1), ("fb", "1", "B", "Active", 1)), merge=False) == 1
    for bad in (rows(("ct", "2", "C", "x", 1), ("ct", "2", "D", "x", 1)), rows(("ct", None, "C", "x", 1))):
        for merge in (True, False):
            with pytest.raises(keyed.DuplicateKey):
                store.put(bad, merge)
    with pytest.raises(keyed.DuplicateKey):
        store.put(rows(("ct", "1", "again", "x", 1)), merge=False)
    assert store.versions() == [1] and store.current().count() == 2
    assert store.put(rows(("ct", "1", "A2", "Closed", 1), ("se", "9", "N", "Active", 1))) == 2
    assert sorted(map(tuple, store.current().collect())) == [("ct", "1", "A2", "Closed"), ("fb", "1", "B", "Active"), ("se", "9", "N", "Active")]
    assert store.current(1).count() == 2


def test_new_links_unite_stored_clusters(spark):
    rnd = random.Random(3)
    edges = [(f"r{rnd.randrange(60):02d}", f"r{rnd.randrange(60):02d}") for _ in range(45)]
    records = spark.createDataFrame([(f"r{i:02d}", i) for i in range(60)], "record_id string, more int")
    link = lambda e: spark.createDataFrame(e, "a string, b string")
    members, lost = linkage.clusters(records, link(edges[:15])), {}
    for part in (edges[15:30], edges[30:]):
        members, merges = linkage.united(members, link(part))
        lost |= {r.ubid: r.merged_into for r in merges.collect()}
    want = {r.record_id: r.ubid for r in linkage.clusters(records, link(edges)).collect()}
    assert {r.record_id: r.ubid for r in members.collect()} == want and members.columns == ["record_id", "more", "root", "ubid"]
    assert lost and not set(lost) & set(want.values())


def test_merge(spark):
    m = spark.createDataFrame([("U1", "a"), ("U2", "b")], "ubid string, record_id string")
    assert {r.ubid for r in console.merged(m, "U1", "U2").collect()} == {"U1"}
    assert {r.ubid for r in console.merged(m, "U9", "U2").collect()} == {"U1", "U2"}


def test_a_timeline_makes_no_rejected_pairs(spark, monkeypatch):
    from corvane.plans import serving as plans

    monkeypatch.setattr(plans, "_ev", lambda *_: 1 / 0)
    assert plans.biq_timeline(spark, "/root/testdata/sf0.001").count() > 0
