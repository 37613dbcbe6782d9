"""Repeats, null ids, clashing columns and bounds of samples, operator by operator; accuracy on the given labels."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import fingerprints, mixing, ngram_join, packing, quality, sharding, toxicity
from corvane.llm.queries import tokenizer
from corvane.llm.shared import settled, told_apart

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(label)[order]
    _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize("label, work", [("toxic", toxicity), ("quality", quality)])
def test_held_out_accuracy(spark, label, work):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = work.train(docs, labels)
    scored = work.scored(docs, *model) if work is toxicity else work.scored(docs, model)
    got = scored.filter("held_out").join(labels.groupBy("doc_id").agg(F.max(label).alias("y")).filter("y is not null"), "doc_id").toPandas()
    assert len(got) > 500 and auc(got["score"], got["y"]) >= 0.95


def test_samples_are_bounded_by_rows(spark):
    """A third of all rows are one labelled document, and there are more documents than the sample takes."""
    rows = [(i, f"text number {i} " + ("bad word" if i % 3 == 0 else "good word")) for i in range(1, 400)] + [(6, "bad word again and again")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(1, 400)], "doc_id long, quality int, toxic int")
    drawn = toxicity.drawn(docs, labels, 50).toPandas()
    assert (drawn["label"] % 2 == 1).sum() <= 50 and (drawn["label"] == 2).sum() <= 50 and len(drawn) > 50
    found = toxicity.labelled(docs, labels, "quality", 60, quality._featured, "doc_id long, label int, x binary")
    assert 20 < found.count() <= 60
    for model in (toxicity.scored(docs, *toxicity.train(docs, labels, 50)), quality.scored(docs, quality.train(docs, labels, 60))):
        assert model.count() == len(rows)


def test_a_draw_is_wide_enough_for_any_number_of_rows():
    assert [toxicity.bounded(x) for x in (0.0, 0.5, 1.0, 7.0)] == [0, 1 << 62, (1 << 63) - 1, (1 << 63) - 1]
    assert toxicity.bounded(12_000 / 10**14) > 10**8  # a hundred trillion rows still draw


def test_repeated_rows_and_null_ids_are_cut_like_others(spark):
    """The bytes law holds where most rows are one row, or one text without doc_ids."""
    for heavy in ([(5, "the same text " * 3)] * 400, [(None, "no id at all")] * 300):
        d = spark.createDataFrame(heavy + [(100 + i, f"text {i}") for i in range(100)], "doc_id long, text string").repartition(5)
        got = sharding.shards(d, 10).collect()
        size = {k: sum(r["size"] for r in got if r.shard == k) for k in range(10)}
        assert max(size.values()) - min(size.values()) <= 130
        for k in size:
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shards(d.repartition(2), 10).collect()), key=str)


def test_rows_told_apart(spark):
    d = spark.createDataFrame([(i % 7 or None, i % 2) for i in range(100)] + [(99, 0)], "a long, b long").repartition(6)
    got = told_apart(settled(d.withColumn("pid", F.spark_partition_id()), "rows"), ["a", "b"], "k").collect()
    by_key = {}
    for r in got:
        by_key.setdefault((r.a, r.b), []).append(r.k)
    assert len(got) == 101 and all(sorted(v) == list(range(len(v))) for v in by_key.values())


def test_repeated_rows_draw_each_on_their_own(spark):
    rows = [(1, "one two three four", "a")] * 600 + [(i, "five six", "a") for i in range(2, 302)] + [(i, "seven", None) for i in range(400, 700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(d).collect()
    taken = sorted(r.taken for r in got if r.doc_id == 1)
    target = {r.source: r.target for r in got}
    assert len(got) == len(rows) and len(set(taken)) > 1  # some of the repeats, not all or none
    assert all(abs(sum(r.taken for r in got if r.source == s) - t) <= 8 for s, t in target.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(2)).collect()))


def test_prompts_of_conversations(spark):
    rows = [(1, 0, "user", "what is it"), (1, 1, "assistant", "it is a word and more"), (2, None, "user", "first"), (2, 3, "user", "last"), (3, 0, None, None), (None, 0, "user", "nobody")]
    made = packing.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.doc_id: (r.text, r.prompt_chars) for r in made.collect()}
    assert got == {1: ("user: what is it\nassistant: it is a word and more", 28), 2: ("user: first\nuser: last", 22), 3: (": ", 2)}
    encode = packing.Encoder(tokenizer())
    text, chars = got[1]
    assert packing.shared_front(encode([text[:chars]])[0][:-1], encode([text])[0]) == len(encode([text])[0]) - len(encode(["it is a word and more"])[0])
    packed = packing.pack(made, tokenizer(), 16, 8, 8, prompt_chars=F.col("prompt_chars")).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(encode([t])[0]) for i, (t, _) in got.items()}
    for s in {r.sequence_id for r in packed}:
        own = [r for r in packed if r.sequence_id == s]
        front = {i: packing.shared_front(encode([t[:c]])[0][:-1], encode([t])[0]) for i, (t, c) in got.items()}
        assert sum(r.start + r.length - max(r.start, min(front[r.doc_id], r.start + r.length)) for r in own) <= 8 or len(own) == 1


def test_columns_that_operators_name_too(spark):
    """Columns of the input may have any name; the results don't change and the columns stay."""
    names = ["prompt_tokens", "prompt", "_kept_hash", "_kept_id", "_row", "_mix_hash", "_MIX_K", "_mix_n", "_mix_id", "_mix_t", "number", "pid", "draw"]
    rnd = random.Random(4)
    base = [(i, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(30)), "s") for i in range(40)]
    base += [(50 + i, base[i][1], "s") for i in range(10)] + [base[0]] * 3 + [(None, None, None)]
    wide = spark.createDataFrame([(*r, *["odd"] * len(names)) for r in base], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    plain = wide.select("doc_id", "text", "source")
    assert sorted(map(str, packing.pack(wide.coalesce(1), tokenizer()).collect())) == sorted(map(str, packing.pack(plain.coalesce(1), tokenizer()).collect()))
    assert sharding.shards(wide, 4).count() == len(base)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        assert sorted(map(str, got.select("doc_id", "text", "source").collect())) == sorted(map(str, stage(spark, plain, SF).collect()))


def test_fingerprints_of_many_rows_of_one_id(spark):
    """Most rows have no doc_id, or one: they are dealt over several ranges, and each is next to the row that follows by its text's hash."""
    rnd = random.Random(12)
    rows = [(None, f"text {rnd.random()}") for _ in range(300)] + [(7, f"seven {rnd.random()}") for _ in range(200)] + [(i, f"one {i}") for i in range(20, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fingerprints.with_edits(d)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 0.7 * len(rows)
    h = {r.text: r.h for r in d.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    chain = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), h[r[1]]))
    want = []
    for (i, t), (_, after) in zip(chain, [*chain[1:], chain[0]]):
        e = len(t) // 2
        want.append((str(i), hashlib.sha256((t[: len(t) - e] + after[:e]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in made.collect()) == sorted(want)


def test_a_bitmap_and_a_join_fetch_the_same_arrays(spark, monkeypatch):
    rnd = random.Random(14)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        t = [rnd.choice(words) for _ in range(40)]
        rows += [(3 * i, " ".join(t)), (3 * i + 1, " ".join(t[:-1] + ["zz"])), (None if i % 9 == 0 else 3 * i + 2, " ".join(["yy"] + t))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = sorted(map(str, ngram_join.ngram_components(d, 5, 70).collect()))
    monkeypatch.setattr(ngram_join, "BITMAP", 1)
    assert sorted(map(str, ngram_join.ngram_components(d, 5, 70).collect())) == told
    assert len({r.component_id for r in ngram_join.ngram_components(d, 5, 70).collect()}) <= 60


def test_a_bitmap_holds_what_it_was_made_of(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bitmap = ngram_join.bitmap_of(rows, 3000)
    h = np.array([r.h for r in rows.collect()]).view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    assert ((bitmap[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)).all()
    assert np.bitwise_count(bitmap).sum() <= 3000 < 64 * len(bitmap) / 16


def test_chunks_seen_often_outlast_the_bound():
    """A worker that remembers few chunks keeps those that come again and again, gives the same ids, and its pieces hold no whole run's ids."""
    rows = [" ".join(f"often{j} rare{i}x{j}" for j in range(50)) for i in range(100)]
    encode = packing.Encoder(tokenizer(), remember=1000)
    got = [encode([t])[0].tolist() for t in rows]
    assert len(encode.code) <= 1000 + 101 and all(f"often{j}" in encode.code for j in range(50))
    assert got == [x.tolist() for x in packing.Encoder(tokenizer())(rows)]
