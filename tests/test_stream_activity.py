"""Statuses over several batches: dormancy by timer, late signals, closures."""

import pytest

from corvane.streaming import activity

COLUMNS = "entity_key long, department string, signal_type string, status string, formal_closure boolean, ts timestamp"


@pytest.fixture
def keyed_state(spark):
    before = {k: spark.conf.get(k, None) for k in activity.STATE}
    for k, v in activity.STATE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dormancy_fires_without_a_new_signal(spark, tmp_path, keyed_state):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()

    def run(rows):
        """One more batch of the stream; its new rows."""
        made = spark.createDataFrame([(k, d, t, s, c, __import__("datetime").datetime.fromisoformat(x)) for k, d, t, s, c, x in rows], COLUMNS)
        made.coalesce(1).write.mode("append").parquet(str(source))
        stream = activity.statuses(spark.readStream.schema(COLUMNS).parquet(str(source)))
        got = []
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
        q.foreachBatch(lambda df, i: got.extend(map(tuple, df.select("entity_key", "status", "rule").collect()))).start().awaitTermination()
        return sorted(got)

    first = [(1, d, "filing", "Active", False, "2022-01-10") for d in ("a", "b", "c")] + [(2, "a", "filing", "Active", False, "2022-01-05"), (3, "a", "closure", None, True, "2022-01-06"), (4, "a", "renewal", "Cancelled", False, "2022-01-07")]
    assert run(first) == [(1, "ACTIVE", "multi_department"), (2, "UNCERTAIN", "none"), (3, "CLOSED", "explicit_closure"), (4, "CLOSED", "all_cancelled")]
    # a late signal of entity 2 lies within the watermark's delay, and doesn't move its latest one back
    assert run([(2, "b", "filing", "Active", False, "2021-12-20"), (4, "b", "filing", "Active", False, "2022-01-20")]) == [(4, "UNCERTAIN", "none")]
    # only entity 5 is heard of, 640 days on: entities 1 and 2 fall dormant, the closed one doesn't
    got = run([(5, "a", "filing", "Active", False, "2023-11-01")]) + run([(5, "a", "filing", "Active", False, "2023-11-02")])
    assert sorted(got) == [(1, "DORMANT", "dormant"), (2, "DORMANT", "dormant"), (4, "DORMANT", "dormant"), (5, "UNCERTAIN", "none")]
    # a new signal wakes one up
    assert (2, "UNCERTAIN", "none") in run([(2, "a", "filing", "Active", False, "2023-11-03")])
