"""The prefix trie against dictionaries of whole prefixes: grafts, long conversations over many ranges, collisions, nulls, repeats."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corvane.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth long, position string, v0 long, size string"


def brute(rows, every=1, most=1):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        source = c - int(np.fmod(c, every))
        whole[c] = tuple(own.get(source, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children, leaves, saved = (dict.fromkeys(nodes, 0) for _ in range(3))
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    )


def made(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(df, **how)
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    out = []
    for c in [*range(60), *range(100, 140), *range(-130, -95), *range(760, 790)]:
        out += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é\U0001f600"])) for t in range(rnd.choice([1, 1, 2, 3, 4, 7]))]
    out += [(800, t, "user", f"turn {t % 7}") for t in range(900)] + [(801, t, "user", f"turn {t % 7}") for t in range(905)]  # long ones, of one path
    out += [(5, None, None, None), (5, None, "user", "before"), (6, 1, "user", None), (6, 1, "user", None), (None, 1, "user", "nobody's"), (7, 0, "ab", "c"), (8, 0, "a", "bc")]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("graft", [{}, {"every": 100, "most": 6}])
def test_every_node(spark, rows, graft):
    assert made(spark, rows, **graft) == brute(rows, **graft)


def test_collisions_are_found_and_split(spark, monkeypatch):
    """Turns' values of two bits: most groups hold several prefixes until there are words enough."""
    rows = [(c, t, "user", f"{c % 3} {t * (c % 5)}") for c in range(20) for t in range(4)]
    used = []
    check = prefix_trie.verified
    monkeypatch.setattr(prefix_trie, "verified", lambda texts, words: used.append((words, check(texts, words))) or used[-1][1])
    assert made(spark, rows, words=1, bits=2) == brute(rows)
    assert not used[0][1] and used[-1][1] and used[-1][0] > 1


def test_turnless_single_and_none(spark):
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)  # loses its only turn, takes over none
    rows = [(alone, 3, "user", "x")]
    assert made(spark, rows, every=100, most=6) == brute(rows, 100, 6) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert made(spark, []) == []


def test_powers_and_running_sums():
    assert (prefix_trie.power(3, np.array([0, 1, 5, 41])) == np.array([1, 3, 243, pow(3, 41, 1 << 64)], np.uint64)).all()
    conv, values = np.array([1, 1, 2, 2, 2]), np.array([[1, 2, 3, 4, 5]], np.uint64)
    whole = prefix_trie.running(conv, values, 10, ())
    assert whole[0].tolist() == [0, 1, 0, 1, 2] and whole[1].tolist() == [[0, 1, 0, 3, 43]]
    first = prefix_trie.running(conv[:4], values[:, :4], 10, ())
    rest = prefix_trie.running(conv[4:], values[:, 4:], 10, first[2])
    assert rest[0].tolist() == [2] and rest[1].tolist() == [[43]] and rest[2][1:] == whole[2][1:]
