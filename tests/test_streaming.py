import json

from corvane.streaming import ingest

SF = "/root/testdata/sf0.001"
FACTORY = ", ".join(f"{c} string" for c in "factory_license_no factory_name pan_of_occupier ownership_type factory_address city district pin_code license_status".split())


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_malformed_messages_are_kept_apart(spark, tmp_path):
    row = {"factory_license_no": "F1", "factory_name": "ABC", "pan_of_occupier": "AABCU1234R", "license_status": "RENEWED"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps(row) + "\nnot json\n")
    good = run(ingest.department_stream(spark, str(tmp_path / "in"), FACTORY, "factories_board"), "good")
    assert [(r.record_id, r.status, r.pan) for r in good] == [("F1", "Active", "AABCU1234R")]
    assert [r.payload for r in run(ingest.json_stream(spark, str(tmp_path / "in"), FACTORY)[1], "bad")] == ["not json"]


def test_windows_and_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    got = run(ingest.windowed_counts(stream), "windows", "complete")
    assert sum(r.n for r in got) == events.count()
    got = run(ingest.latest_status(stream), "latest", "update")
    assert sum(r.n for r in got) == events.count()


SHOP = ", ".join(f"{c} string" for c in "registration_number gstin pan establishment_name shop_name type_of_establishment nature_of_business address city taluk district pincode registration_status".split())


def test_topics_are_dispatched_once_each(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    topics = {"gov.fb": ("factories_board", FACTORY), "gov.se": ("shops_establishments", SHOP)}
    messages = lambda: spark.readStream.schema("topic string, payload string").json(str(source))
    put = lambda name, rows: (source / f"{name}.json").write_text("\n".join(json.dumps({"topic": t, "payload": p if isinstance(p, str) else json.dumps(p)}) for t, p in rows))
    put("a", [("gov.fb", {"factory_license_no": "F1", "factory_name": "ABC", "license_status": "REVOKED"}), ("gov.se", {"registration_number": "S1", "shop_name": "SHOP", "taluk": "T"}), ("gov.se", "not json"), ("gov.xx", "whose"), ("gov.fb", "{}")])
    start = lambda: ingest.dispatched(messages(), topics, out).trigger(availableNow=True).start().awaitTermination()
    start()
    put("b", [("gov.fb", {"factory_license_no": "F2", "factory_name": "DEF", "license_status": "VALID"})])
    start()
    start()  # nothing new
    read = lambda kind, d: spark.read.parquet(f"{out}/{kind}/{d}")
    assert sorted((r.record_id, r.status) for r in read("records", "factories_board").collect()) == [("F1", "Cancelled"), ("F2", "Active")]
    assert [(r.record_id, r.business_name, r.city) for r in read("records", "shops_establishments").collect()] == [("S1", "SHOP", "T")]
    assert {d: sorted(r.payload for r in read("dead", d).collect()) for d in ("factories_board", "shops_establishments", "unknown")} == {"factories_board": ["{}"], "shops_establishments": ["not json"], "unknown": ["whose"]}


def test_a_batch_run_again_leaves_each_message_once(spark, tmp_path):
    out, topics = f"file://{tmp_path}/out", {"gov.fb": ("factories_board", FACTORY)}
    writer = ingest.dispatched(spark.readStream.schema("topic string, payload string").json(str(tmp_path)), topics, out)
    kept = []
    type(writer).foreachBatch, before = (lambda self, f: kept.append(f) or self), type(writer).foreachBatch
    try:
        ingest.dispatched(spark.readStream.schema("topic string, payload string").json(str(tmp_path)), topics, out)
    finally:
        type(writer).foreachBatch = before
    rows = spark.createDataFrame([("gov.fb", json.dumps({"factory_license_no": "F1"}))], "topic string, payload string")
    for _ in range(2):
        kept[0](rows, 7)
    assert spark.read.parquet(f"{out}/records/factories_board").count() == 1
