"""Operators of corvane.llm against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corvane.llm import exact_dedup, fingerprints, katz, licenses, mixing, ngram_join, packing, quality, queries, sharding, toxicity
from corvane.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, label string, bucket string, key string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    out = []
    for i in range(60):
        t = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 8, 40, 200])))
        out.append((i, t))
    for i in range(60, 80):  # near and exact copies
        t = out[rnd.randrange(60)][1].split(" ")
        if i % 2:
            t[rnd.randrange(len(t))] = "zz"
        out.append((i, " ".join(t)))
    out += [(80, None), (81, ""), (82, " \n\t"), (83, "MIT License. Under the Apache License, Version 2.0"), (84, "word " * 30_000), (85, "\U0001f600é" * 50), (86, "GNU general-public LICENSE"), (79, out[79][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", [None, "a", "b", "B"][i % 4], 1, "x", "y", "z", "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    for r in got:
        own = groups[next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
    assert exact_dedup.exact_groups(empty).count() == 0


def test_ngram_components(docs, rows, empty):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in range(20):
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id]) for r in got)
    assert ngram_join.ngram_components(empty).count() == 0


def test_large_tiles_lose_no_link(spark):
    """Groups beyond SMALL_TILE: a star of near copies and chains off it."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(60):
        t = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(t))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(117)} for t in texts]
    label = list(range(60))
    for _ in range(10):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == label


def test_arrays_of_large_tiles_are_fetched_only_where_bitmaps_allow_a_link(spark, monkeypatch):
    """300 texts share a line and so large tiles; a chain of near copies among them is all that may link."""
    rnd = random.Random(6)
    line = [f"c{i}" for i in range(10)]
    texts = [" ".join(line + [f"w{rnd.randrange(10**6)}" for _ in range(12)]) for _ in range(300)]
    chain = texts[0].split() + [f"y{i}" for i in range(20)]
    for i in range(5):
        texts.append(" ".join(chain))
        chain[20 + 4 * i] = f"z{i}"
    seen, rest = [], ngram_join._rest
    monkeypatch.setattr(ngram_join, "_rest", lambda edges, *more: seen.extend(edges.collect()) or rest(edges, *more))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    assert [got[i] for i in range(len(texts))] == [min(k for k, x in enumerate(label) if x == y) for y in label]
    assert len({c for e in seen for c in e}) < 60


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    got = packing.pack(docs.filter("doc_id <> 79"), tokenizer()).collect()
    assert packing.pack(docs, tokenizer()).groupBy().sum("length").first()[0] == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    want = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in rows}
    pieces, sequences = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want) - {79}
    for i, p in pieces.items():
        assert sum(n for _, n in p) == len(want[i]) and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
    bears = {}
    for r in got:
        prompt = r.doc_tokens // packing.PROMPT
        bears[r.sequence_id] = bears.get(r.sequence_id, 0) + max(0, r.start + r.length - max(r.start, prompt))
    assert max(bears.values()) <= packing.LOSS
    for p in sequences.values():
        n = sum(x for _, x in p)
        assert n <= 2048 and n & (n - 1) == 0 and all(a + x == b for (a, x), (b, _) in zip(sorted(p), sorted(p)[1:]))
    assert packing.pack(empty, tokenizer()).count() == 0


def largest_fit(pieces, tokens, segments, loss):
    """How many bins the longest piece that fits, taken each time, needs for whole pieces (tokens, loss)."""
    left, bins = sorted(pieces, reverse=True), 0
    while left:
        room, bins = [tokens, segments, loss], bins + 1
        while fit := next((x for x in left if x[0] <= room[0] and x[1] <= room[2] and room[1]), None):
            left.remove(fit)
            room = [room[0] - fit[0], room[1] - 1, room[2] - fit[1]]
    return bins


def check_bins(bins, start, end, prompt, tokens, segments, loss):
    """Limits hold and each token lies in exactly one piece."""
    spans = {}
    for one in bins:
        assert sum(e - s for _, s, e in one) <= tokens and len(one) <= segments
        assert sum(max(0, e - max(s, prompt[i])) for i, s, e in one) <= loss
        for i, s, e in one:
            spans.setdefault(i, []).append((s, e))
    for i in range(len(start)):
        own = sorted(spans[i])
        assert own[0][0] == start[i] and own[-1][1] == end[i] and all(a[1] == b[0] for a, b in zip(own, own[1:]))


@pytest.mark.parametrize("tokens, segments, loss", [(2048, 256, 1792), (2048, 5, 2048), (100, 4, 60), (64, 64, 1)])
def test_vector_limits(tokens, segments, loss):
    rnd = np.random.default_rng(3)
    n = rnd.integers(1, tokens, 300)
    start = rnd.integers(0, 50, 300)
    prompt = start + rnd.integers(0, n + 1)
    bins, rest = packing.fill(start, start + n, prompt, tokens, segments, loss, True)
    assert rest == []
    check_bins(bins, start, start + n, prompt, tokens, segments, loss)
    bins, rest = packing.fill(start, start + n, prompt, tokens, segments, loss, False)
    assert all(sum(e - s for _, s, e in b) == tokens for b in bins)
    check_bins([*bins, *[[x] for x in rest]], start, start + n, prompt, tokens, len(start), loss) if loss >= tokens else None


def test_dot_product_needs_fewer_bins_than_largest_fit():
    """Examples of which half are all answer and half all prompt: the limit on loss binds, and the dot product mixes them."""
    better = worse = 0
    for seed in range(20):
        rnd = np.random.default_rng(seed)
        n = rnd.integers(20, 55, 200)
        prompt = np.where(rnd.random(200) < 0.5, 0, n)
        bins, _ = packing.fill(np.zeros(200, np.int64), n, prompt, 100, 10, 55, True)
        plain = largest_fit([(int(x), int(x - p)) for x, p in zip(n, prompt)], 100, 10, 55)
        better, worse = better + (len(bins) < plain), worse + (len(bins) > plain)
    assert better >= 18 and worse == 0


def test_cut_of_long_examples():
    for n, prompt in [(2048, 512), (10_000, 2500), (10_000, 0), (10_000, 10_000), (5000, 10), (4097, 4000), (2049, 2048)]:
        sequences, rests = packing.cut(n, prompt, 2048, 1792)
        spans = sorted([x for one in sequences for x in one] + rests)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and all(e - s <= 2048 for s, e in rests)
        assert all(sum(e - s for s, e in one) == 2048 and sum(max(0, e - max(s, prompt)) for s, e in one) <= 1792 for one in sequences)


def test_conversations_are_examples(spark):
    rows = [(1, 0, "user", "ask me"), (1, 1, "assistant", "tell"), (2, 1, "user", "more"), (2, 0, "assistant", None)]
    got = {r.doc_id: (r.text, r.prompt_chars) for r in packing.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: ("user: ask me\nassistant: tell", 24), 2: ("assistant: \nuser: more", 22)}


def test_shards(docs, rows, empty):
    got = sharding.shards(docs, 5).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    text = dict(rows)
    assert all((r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 16, zlib.crc32((text[r.doc_id] or "").encode())) for r in got)
    assert sharding.shards(empty, 5).count() == 0


def test_shards_cut_a_large_group(spark):
    same = spark.range(4000).selectExpr("id as doc_id", "'the same text' as text")
    n = [r["count"] for r in sharding.shards(same, 40).groupBy("shard").count().collect()]
    assert len(n) == 40 and max(n) <= 102 and min(n) >= 98


def test_shards_have_near_equal_bytes(spark):
    """Texts of many lengths, a large group of equal ones, repeats: every shard within a text of the mean, and the order is (text, doc_id)."""
    rnd = random.Random(21)
    texts = [(i, "x" * rnd.randint(0, 400) + str(i)) for i in range(1500)] + [(2000 + i, "the same text again") for i in range(800)] + [(7, "x")] * 5 + [(None, None)] * 3
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    got = sharding.shards(d, 16).collect()
    assert len(got) == len(texts)
    size = {k: sum(r["size"] for r in got if r.shard == k) for k in range(16)}
    mean = sum(size.values()) / 16
    assert max(abs(x - mean) for x in size.values()) <= 450
    assert len({r.shard for r in got if r.doc_id is not None and r.doc_id >= 2000}) >= 2
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shards(d.repartition(2), 16).collect()), key=str)


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    total = sum(r.size for r in got)
    target = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1e-3 and all(t <= 2 * s + 1e-6 for t, s in target.values())
    assert mixing.mix(empty).count() == 0


def test_licenses(docs, rows, empty):
    got = {r.doc_id: r for r in licenses.licenses(docs).collect()}
    assert (got[83].n_base, got[83].first_word, got[83].last_word, got[83].base_labels, got[83].labels) == (2, 0, 4, "apache,mit", "apache,apache-2.0,mit")
    assert got[86].base_labels == "gpl" and got[80].n_words == 0 and got[80].labels == "" and got[80].score == 0 and got[84].n_words == 30_000
    assert licenses.licenses(empty).count() == 0
    assert len(licenses.rules()) > 250 and all(re.compile(r[4]) for r in licenses.rules())


def spelled(pattern):
    """All strings that a rule matches; of a class of characters, its ends."""
    from re import _parser

    def one(op, a):
        if op == "LITERAL":
            return [chr(a)]
        if op == "IN":
            return [chr(c) for kind, v in a for c in ([v] if str(kind) == "LITERAL" else v)]
        if op == "MAX_REPEAT":
            return [x for n in range(a[0], a[1] + 1) for x in ([""] if n == 0 else of(a[2]))]
        return of(a[3]) if op == "SUBPATTERN" else [x for branch in a[1] for x in of(branch)]

    def of(items):
        out = [""]
        for op, a in items:
            out = [x + y for x in out for y in one(str(op), a)]
        return out

    return of(_parser.parse(pattern))


def test_every_license_rule_fires_alone(spark):
    """Each spelling of each rule, with nothing else in the text but what its author asks for."""
    texts, want = [], []
    for label, keys, rank, _, pattern in licenses.rules():
        for x in spelled(pattern[1:-5]):
            texts.append((len(texts), f"noninfringement. {x.upper()}" if keys == "noninfringement" else x.replace(" ", "\n-")))
            want.append((label, rank))
    texts += [(None, "All Rights\tReserved"), (None, "All Rights\tReserved"), (-1, "smithy omits rightsé")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert licenses.licenses(docs).count() == len(texts)
    got = licenses.detections(docs).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add((r.label, r.rank))
    assert [w for i, w in enumerate(want) if w not in found.get(i, ())] == [] and -1 not in found
    assert [r.label for r in got if r.doc_id is None] == ["proprietary"]


def test_licenses_against_brute_force(spark):
    """Texts of license words at random and of phrases, with repeats, nulls and rows that tie; every rule is tried everywhere."""
    rnd = random.Random(11)
    phrases = ["MIT License", "the Apache License, Version 2.0", "GNU General Public License v3 or (at your option) any later version", "All rights reserved", "public\ndomain", "released into the public domain", "Creative Commons Attribution Share-Alike", "SPDX-License-Identifier: MIT", "BSD 3-Clause License", "wtfpl"]
    words = ["mit", "license", "apache", "general", "public", "gnu", "the", "2", "0", "or", "later", "version", "é", "bsd", "commons", "by"]
    texts = [(i, " ".join(rnd.choice(phrases if rnd.random() < 0.3 else words) for _ in range(rnd.randint(0, 25)))) for i in range(60)]
    texts += [(None, "MIT license"), (None, None), (3, "MIT License mit license"), (4, texts[4][1]), (99, "MIT License. " * 3000)]
    rules = [(label, keys.split(), rank, sure, re.compile(pattern), (label, keys, pattern[4:-6]) in licenses.BASE) for label, keys, rank, sure, pattern in licenses.rules()]
    want = []
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        norm, found = f" {' '.join(w)} ", []
        for label, keys, rank, sure, pattern, base in rules:
            if set(keys) & set(w):
                found += [(m.group().count(" "), norm[: m.start()].count(" "), rank, label, sure, base) for m in pattern.finditer(norm)]
        found = sorted(set(found))
        spans = {}
        for n, first, rank, *_ in found:
            spans.setdefault((first, n), []).append(rank)
        longest = {}
        for first, n in spans:
            longest[first] = max(longest.get(first, 0), first + n)
        kept = [x for x in found if x[2] == min(spans[x[1], x[0]]) and not any(e > x[1] + x[0] or (f < x[1] and e == x[1] + x[0]) for f, e in longest.items() if f <= x[1] and e >= x[1] + x[0])]
        base = [x for x in found if x[5]]
        name = lambda some: ",".join(sorted({x[3] for x in some}))
        want.append((i, len(w), len(base), min((x[1] for x in base), default=None), max((x[1] for x in base), default=None), name(base), name(base + kept), max((x[4] for x in kept), default=0.0)))
    got = licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_katz(docs, rows, empty):
    from collections import Counter

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for i, t in rows}
    count = Counter(w for i, _ in rows for w in words[i] if zlib.crc32(str(i).encode()) % 5 != 1)
    n, v = sum(count.values()), len(count)
    for r in katz.scored(docs).collect():
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[r.doc_id])
        assert abs(base - r.base_score) < 1e-6 * abs(base) and r.n_tokens == len(words[r.doc_id]) and r.train_tokens == n
        assert r.n_known == sum(count[w] > 0 for w in words[r.doc_id]) and r.score < 0
    assert katz.scored(empty).count() == 0


def brute_katz(texts, order):
    """(P(w | the words before it), vocabulary) by plain loops; None is the end, "?" an unseen word."""
    from collections import Counter

    grams = {k: Counter() for k in range(1, order + 1)}
    for words in texts:
        padded = [None] * (order - 1) + words
        for i in range(order - 1, len(padded)):
            for k in grams:
                grams[k][tuple(padded[i - k + 1 : i + 1])] += 1
    n = sum(grams[1].values())
    d = {k: katz.discounts(np.bincount(list(c.values()), minlength=10)) for k, c in grams.items()}
    cut = lambda k, c: d[k][min(c, katz.GT_MAX + 1)] * c
    one = {w: cut(1, c) / n for (w,), c in grams[1].items()}
    mass = 1 - sum(one.values())
    unseen = max(mass, 0.5 / (n + 0.5 * (len(one) + 1)))
    one = {w: p * (1 - unseen) / (1 - mass) for w, p in one.items()} | {"?": unseen}
    cache = {}

    def p(w, h):
        if (w, h) not in cache:
            cache[w, h] = _p(w, h)
        return cache[w, h]

    def _p(w, h):
        if not h:
            return one.get(w, one["?"])
        k = len(h) + 1
        after = sum(c for g, c in grams[k].items() if g[:-1] == h)
        seen = {g[-1]: cut(k, c) for g, c in grams[k].items() if g[:-1] == h and c >= (katz.LEAST if k > 2 else 1)}
        if not seen:
            return p(w, h[1:])
        kept, rest = sum(seen.values()), 1 - sum(p(x, h[1:]) for x in seen)
        held = after if rest < 1e-9 else min(kept, after - 0.5)
        return seen[w] * held / kept / after if w in seen else p(w, h[1:]) * (1 - held / after) / rest

    return p, [*one]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_against_brute_force(spark, monkeypatch, order):
    """Several blocks and buckets; repeated, empty and null texts; the brute force sums to 1, and what the engine gives equals it."""
    monkeypatch.setattr(katz, "TOKENS_A_BUCKET", 20)
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = [[words[min(29, int(rnd.expovariate(0.2)))] for _ in range(rnd.randint(0, 9))] for _ in range(120)]
    p, vocabulary = brute_katz([[*t, None] for t in texts], order)
    for h in (["w0", "w3", "w1"], [None, None, None], ["?", "?", "?"], ["w1", "?", "w2"]):
        h = tuple(h[: order - 1])
        assert abs(sum(p(w, h) for w in vocabulary) - 1) < 1e-9
    asked = [*texts[:40], ["w29", "w0", "nowhere", "w1"], ["nowhere"], []]
    rows = [(1000 + i, " ".join(t) or None, False) for i, t in enumerate(texts)] + [(i, " ".join(t), True) for i, t in enumerate(asked)]
    rnd.shuffle(rows)
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(7), order).collect()
    assert len(got) == len(rows)
    for r in got:
        t = [None] * (order - 1) + (asked[r.doc_id] if r.doc_id < 1000 else texts[r.doc_id - 1000]) + [None]
        want = sum(np.log10(p(t[i] if t[i] is None or t[i] in vocabulary else "?", tuple(t[i - order + 1 : i]))) for i in range(order - 1, len(t)))
        assert abs(want - r.score) < 1e-9 * max(1, abs(want)), (r, want)


def test_katz_sums_to_one(spark):
    """The engine's own probabilities of every word that can follow a context, an unseen one included."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(words[min(11, int(rnd.expovariate(0.4)))] for _ in range(rnd.randint(1, 12))) for _ in range(80)]
    contexts = ("w0 w1", "w3 w0", "w11 w11", "unseen w0")
    asked = [x for h in contexts for x in (h, *(f"{h} {w}" for w in [*words, "nowhere"]))]
    rows = [(i, t, True) for i, t in enumerate(asked)] + [(1000 + i, t, False) for i, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    p, vocabulary = brute_katz([[*t.split(), None] for t in texts], 3)
    for k, h in enumerate(contexts):
        # every text ends: P(h w end) = P(h) P(w | h) P(end | h w), and P(h end) = P(h) P(end | h)
        w = [None, None, *h.split()]
        front = sum(np.log10(p(w[i] if w[i] in vocabulary else "?", tuple(w[i - 2 : i]))) for i in range(2, len(w)))
        end = lambda x: np.log10(p(None, (h.split()[-1], x)))
        own = [got[14 * k + i] - front for i in range(14)]
        assert abs(10 ** own[0] + sum(10 ** (own[i] - end(x)) for i, x in enumerate([*words, "?"], 1) if x in vocabulary) - 1) < 1e-9


def test_fingerprints(docs, rows, empty):
    clean = docs.filter("doc_id <> 79")
    got = {r.doc_id: r for r in fingerprints.with_edits(clean).collect()}
    text = {i: t or "" for i, t in rows if i != 79}
    ids = sorted(text, reverse=True)
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        n, m = len(text[i]), len(text[i]) // 2
        edited = text[i][: n - m] + text[ids[(k + 1) % len(ids)]][:m]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == n
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[80].fingerprint == got[81].fingerprint
    assert fingerprints.with_edits(empty).count() == 0


def plain_walk(text):
    """The written string, a character for each step, by a plain loop."""
    out, j = [], 0
    for c in text:
        x = int(fingerprints.mix(np.array([ord(c)], np.uint64))[0]) & 15
        while True:
            out.append("0123456789abcdef"[x])
            move = int(fingerprints.mix(np.array([x * fingerprints.PERIOD + j % fingerprints.PERIOD + 0xABCDEF], np.uint64))[0]) & 1
            j += 1
            if move:
                break
    return "".join(out)


def test_fingerprints_against_a_plain_walk(spark):
    rnd = random.Random(17)
    texts = [(i, "".join(rnd.choice("abc dé\U0001f600") for _ in range(rnd.choice([1, 2, 15, 40, 700])))) for i in range(25)] + [(50, ""), (51, None)]
    got = {r.doc_id: r for r in fingerprints.with_edits(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}

    def sampled(text):
        w = plain_walk(text)
        m = 0 if not w else 16 * (1 if len(w) <= 16 else (len(w) - 1).bit_length() - 3)
        return "".join(w[s] if s < len(w) else "z" for s in fingerprints.STEPS[:m].tolist())

    ids = sorted((i for i, _ in texts), reverse=True)
    text = {i: t or "" for i, t in texts}
    for k, i in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        n = len(text[i])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (sampled(text[i]), sampled(text[i][: n - n // 2] + after[: n // 2]))
        for mine, a, b in ((got[i].near_edited, got[i].fingerprint, got[i].edited_fingerprint), (got[i].near_next, got[i].fingerprint, sampled(after))):
            same = total = 0
            for p in range(max(len(a), len(b))):
                x, y, w = a.ljust(p + 1, "z")[p], b.ljust(p + 1, "z")[p], 2 ** max(p // 16 + 3, 4)
                same, total = same + w * (x == y != "z"), total + w * (x != "z" or y != "z")
            assert abs(mine - (same / total if total else 1)) < 1e-9


def test_a_single_document_is_next_to_itself(spark):
    r = fingerprints.searched(spark.createDataFrame([(0, "some text")], "doc_id long, text string")).first()
    assert r.near_next == 1 and r.near_id is None and r.near_queries == 0


def test_search_shuffles_no_text(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_CHARS", 500)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    want = sorted(tuple(r) for r in fingerprints.with_edits(docs).select("doc_id", "fingerprint").collect())
    seen, settled = [], queries.settled
    monkeypatch.setattr(queries, "settled", lambda df, name: seen.append(df) or settled(df, name))
    queries.near_fingerprints(spark, "")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(seen[0]) == exchanges(docs)
    assert sorted(tuple(r) for r in seen[0].collect()) == want and fingerprints.prints(empty).count() == 0


def test_search_finds_near_fingerprints(spark):
    """Every found pair is near, and of all near pairs of the queries at least 0.9 are found; copies, edits, other lengths, repeats, nulls."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    texts = []
    for g in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 12, 60, 400]))]
        for c in range(12):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at = rnd.randrange(len(t))
                t[at : at + 1] = rnd.choice([[], ["new"], [t[at], "more"]])
            texts.append(" ".join(t))
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, ""), (0, texts[0]), (200, None)]
    prints = fingerprints.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "fingerprint")
    own = [(r.doc_id, r.fingerprint) for r in prints.collect()]
    got = {(r["query"], r.doc_id): r.likeness for r in fingerprints.near_queries(prints).collect()}
    near = {}
    for q, x in own:
        for i, y in own:
            if q is not None and q % 100 == 0 and i is not None and i != q and x and y and (like := fingerprints.likeness(x, y)) >= 0.8:
                near[q, i] = max(like, near.get((q, i), 0))
    assert len(near) > 150 and all(abs(near[p] - like) < 1e-9 for p, like in got.items()) and len(got) >= 0.9 * len(near)


def test_likeness_follows_edits():
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(4000))

    def of(t):
        symbols = (fingerprints.mix(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)) & np.uint64(15)).astype(np.int64)
        steps, _, end = fingerprints.walk(symbols, np.array([0]), np.array([len(t)]), np.array([0]))
        return fingerprints._print(symbols, steps, int(end[0]))

    near = base[:2000] + "X" + base[2000:]
    other = "".join(rnd.choice("abcdefghij ") for _ in range(4000))
    assert fingerprints.likeness(of(base), of(base)) == 1 and fingerprints.likeness(of(base), of(near)) > 0.6 > fingerprints.likeness(of(base), of(other))


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, docs, rows, empty, module, label):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    texts = []
    for i in range(400):
        w = [rnd.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w = [x.upper() + "!!" for x in w] if label == "quality" else w + ["vile", "nasty"]
        texts.append((i, " ".join(w)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    l = spark.createDataFrame([(i, int((i % 4 == 0) == (label == "toxic"))) for i in range(400)], f"doc_id long, {label} int")
    model = module.train(d, l)
    score = (lambda x: module.scored(x, *model)) if label == "toxic" else (lambda x: module.scored(x, model))
    got = [r for r in score(d).collect() if r.held_out]
    assert got and sum(r.predicted == ((r.doc_id % 4 == 0) == (label == "toxic")) for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in score(docs).collect()) and score(docs).count() == len(rows) and score(empty).count() == 0


@pytest.mark.parametrize("others", [0, None])
def test_toxicity_finds_what_is_not_confirmed(spark, others):
    """A quarter of the texts are toxic, a third of these confirmed; all others are labelled 0, or not at all."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    texts = [(i, " ".join([rnd.choice(words) for _ in range(30)] + ["vile", "nasty"] * (i % 4 == 0))) for i in range(1200)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    l = spark.createDataFrame([(i, 1 if i % 12 == 0 else others) for i in range(1200)], "doc_id long, toxic int")
    got = [r for r in toxicity.scored(d, *toxicity.train(d, l)).collect() if r.held_out]
    assert got and sum(r.predicted == (r.doc_id % 4 == 0) for r in got) / len(got) > 0.95


def test_toxicity_corrects_a_negative_risk():
    """Positives that are not among the unlabelled drive the risk below 0; the fit stays finite and the prior comes from elsewhere."""
    x = [np.array([k], np.int32) for k in [1] * 40 + [2] * 60]
    positive, unlabelled = np.arange(100) < 40, np.arange(100) >= 40
    rows = toxicity.gathered(x, positive, unlabelled)
    assert toxicity.class_prior(rows, np.arange(100) % 2 == 1) < 0.05
    loose = toxicity.fit(rows, 0.3, steps=2000)
    assert abs(loose[0][1]) < 20 and loose[0][1] > 0


def test_components_of_random_graphs(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(50)] + [(500, 300 + k) for k in range(30)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_bitmaps_rule_out_no_link():
    """Over sizes whose bitmaps differ in length; most unlike pairs are ruled out."""
    rnd = np.random.default_rng(8)
    ruled_out = 0
    for n in (1, 2, 5, 63, 64, 100, 127, 130, 250, 600):
        for change in (0, 1, n // 12, n // 5, n):
            x = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.append(x[change:], rnd.integers(0, 2**63, change + n // 20, dtype=np.uint64)))
            if not len(y):
                continue
            maps = ngram_join.bitmaps(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), np.array([len(x), len(y)])).to_pylist()
            may, real = ngram_join.may_link(80, len(x), len(y), *maps), ngram_join.linked(80, x, y)
            assert may or not real
            assert real == (100 * len(set(x.tolist()) & set(y.tolist())) >= 80 * len(set(x.tolist()) | set(y.tolist())))
            ruled_out += not may
    assert ruled_out >= 8


def test_quality_keeps_whole_rows(spark, docs):
    """The rows that reach the cut, with clashing extra columns, nulls and repeats; without a model all have 0.5."""
    assert sorted(map(str, quality.kept(docs, None).collect())) == sorted(map(str, docs.collect()))
    wide = quality.features.dense(quality.Block(quality.pa.array(["a b"]), True)).shape[1]
    model = quality.fit(np.random.default_rng(1).random((40, wide)), np.arange(40) % 2)
    want = sorted(r.doc_id for r in quality.scored(docs, model).filter("predicted = 1").collect())
    assert sorted(r.doc_id for r in quality.kept(docs, model).collect()) == want


def test_toxicity_fit_holds_few_bytes_a_feature():
    """Beside the rows (8 bytes a feature) the fits hold less than 15 bytes for each: no array of all features in 64 bits is made."""
    import tracemalloc

    rnd = np.random.default_rng(3)
    x = [np.unique(rnd.integers(0, toxicity.features.BUCKETS, 900)).astype(np.int32) for _ in range(4000)]
    positive = np.arange(4000) < 2000
    rows = toxicity.gathered(x, positive, ~positive)
    tracemalloc.start()
    try:
        toxicity.class_prior(rows, np.arange(4000) % 2 == 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15 * len(rows.row)


def test_encoder_remembers_a_bounded_number_of_chunks():
    """An executor has a worker for each core, and what all remember lies beside its heap: 1,300,000 distinct words don't stay."""
    encode = packing.Encoder(tokenizer())
    for at in range(0, 1_300_000, 50_000):
        encode([" ".join(f"w{i}" for i in range(at, at + 50_000))])
    assert len(encode.code) <= 1_100_000
    assert [x.tolist() for x in encode(["w3 w1299999"])] == [x.tolist() for x in packing.Encoder(tokenizer())(["w3 w1299999"])]
