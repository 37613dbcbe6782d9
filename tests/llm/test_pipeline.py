"""Each stage of the corpus pipeline against plain Python on what the stage before it kept, and run() as a whole."""

import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from corvane.llm import mixing, quality
from corvane.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, t string, bucket string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts = []
    for i in range(120):
        t = [rnd.choice(words) for _ in range(rnd.choice([3, 20, 60, 300]))]
        texts.append(" ".join(x.upper() + "!!" for x in t) if i % 5 == 0 else " ".join(t).capitalize() + ".")
    for i in range(40):  # exact, case and near copies
        t = rnd.choice(texts[:120]).split(" ")
        if i % 3 == 0 and len(t) > 50:
            t[rnd.randrange(len(t))] = "changed"
        texts.append(" ".join(t).swapcase() if i % 3 == 1 else " ".join(t))
    rows = [(i, t, "en", [None, "a", "b", "B", "c"][i % 5 if i % 3 else 1], len(t), "x", "y", "z", "k") for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None, None, None, None, None), (501, "", "en", "a", 0, "x", "y", "z", "k"), (None, texts[1] + " null", "en", "a", 1, "x", "y", "z", "k"), rows[1], rows[1]]
    labels = [(i, int(i % 5 != 0), 0) for i in range(120)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage gets and gives."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        if name != "pack":
            assert made.columns == docs.columns
        path = f"{sf_dir}/{name}"
        made.write.parquet(path)
        out[name] = docs.collect(), (docs := spark.read.parquet(path)).collect()
    return out


def test_quality(spark, sf_dir, kept):
    before, after = kept["quality"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = quality.scored(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).filter("predicted = 1")
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in good.collect())
    assert {r.doc_id for r in after if r.doc_id is not None and r.doc_id < 120} == {i for i in range(120) if i % 5}


def test_exact_dedup(kept):
    before, after = kept["exact_dedup"]
    want = {}
    for r in before:
        t = low(r.text)
        want[t] = max(want.get(t, -1), -1 if r.doc_id is None else r.doc_id)
    assert {(low(r.text), -1 if r.doc_id is None else r.doc_id) for r in after} == set(want.items()) and len(after) == len(want)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_dedup(kept):
    before, after = kept["near_dedup"]
    sets = []
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    label = list(range(len(before)))
    for _ in range(len(before)):
        changed = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and 100 * len(x & y) >= 80 * len(x | y) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            break
    order = lambda i: (before[i].doc_id is None, before[i].doc_id or 0)
    want = {min((i for i in range(len(before)) if label[i] == g), key=order) for g in set(label)}
    assert sorted(map(str, after)) == sorted(str(before[i]) for i in want)
    assert len(after) < len(before)


def test_mix(spark, sf_dir, kept):
    before, after = kept["mix"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    copies = Counter(map(tuple, after))
    assert set(copies) <= {tuple(r) for r in before} and max(copies.values()) <= 2
    sizes, largest = Counter(), Counter()
    for r in before:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, rest = {}, dict(weights)
    budget = 1.5 * sum(sizes.values())
    while rest:
        level = (budget - sum(target.values())) / sum(rest.values())
        over = [s for s in rest if level * rest[s] > 2 * sizes[s]]
        for s in over:
            target[s] = 2.0 * sizes[s]
            del rest[s]
        if not over:
            target |= {s: level * w for s, w in rest.items()}
            break
    taken = Counter()
    for r in after:
        taken[r.source] += size(r)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_pack(kept):
    from tokenizers import Tokenizer

    before, after = kept["pack"]
    t = Tokenizer.from_file(tokenizer())
    want = Counter()
    for r in before:
        want[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == want
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in before}
    assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])) == r.ids_crc32 for r in after)


def test_run_is_the_stages(spark, sf_dir, kept):
    got = corpus_pipeline.run(spark, sf_dir)
    total = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows for _ in range(r.length))
    assert total(got.collect()) == total(kept["pack"][1])


def test_empty_table(spark, sf_dir, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_mixing_weights_are_positive(spark):
    texts = [("",), (None,), ("|||||",), ("A" * 50,), ("12345 678",), ("plain words of prose that go on.",)]
    got = [r[0] for r in spark.createDataFrame(texts, "text string").select(mixing.quality_weight()).collect()]
    assert all(0.05 <= x <= 1 for x in got) and max(got) == got[-1]
