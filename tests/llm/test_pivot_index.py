"""The pivot-permutation index against brute force: clusters, copies, bounds of knots, unusable vectors, other lengths, recall at the threshold."""

import math

import numpy as np
import pytest

from corvane.llm import pivot_index

SCHEMA = "vec_id long, embedding array<float>, label int, n long, knot string"


def brute(rows, least=0.9):
    """vec_id -> (n_links, component_id) of (vec_id, vector) with distinct ids."""
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {i: (0, i) for i, _ in rows}
    label = {i: i for i, _ in ok}
    for d in {len(v) for _, v in ok}:
        own = [(i, v) for i, v in ok if len(v) == d]
        x = np.stack([v for _, v in own])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        at = np.arange(len(own))
        while True:
            new = np.where(hit, at[None, :], len(own)).min(1)
            new = np.minimum(at, np.where(hit.any(1), new, at))
            if (new == at).all():
                break
            at = new
        least_id = {}
        for k, (i, _) in enumerate(own):
            least_id[at[k]] = min(i, least_id.get(at[k], i))
        for k, (i, _) in enumerate(own):
            label[i] = least_id[at[k]]
            out[i] = (int(hit[k].sum()), label[i])
    return out


def frame(spark, rows, kind="float"):
    made = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows]
    return spark.createDataFrame(made, SCHEMA.replace("float", kind)).repartition(3)


def float32(v):
    return [float(np.float32(x)) for x in v]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    v = [r.normal(size=24) for _ in range(300)]
    centre = r.normal(size=24)
    v += [centre + r.normal(size=24) * 0.15 * np.linalg.norm(centre) / math.sqrt(24) for _ in range(150)]  # tight: a knot
    v += [centre + r.normal(size=24) * 0.45 * np.linalg.norm(centre) / math.sqrt(24) for _ in range(150)]  # around it, on both sides of the bounds
    v += [v[3] * 2, v[3] * 1e-3, v[4], v[4], v[310], -v[5]]
    out = [(7 * i - 50, float32(x)) for i, x in enumerate(v)]
    out += [(90_001, None), (90_002, []), (90_003, [0.0] * 24), (90_004, [None] + [1.0] * 23), (90_005, [math.nan] + [1.0] * 23), (90_006, [math.inf] + [1.0] * 23)]
    return out + [(90_007, [1.0, 0.5]), (90_008, [2.0, 1.0]), (90_009, [-1.0, 0.0]), (90_010, [5.0])]


def compare(got, want):
    """(share of links found, whether none was made up) when components are those of the links found."""
    assert len(got) == len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    found, there = sum(r.n_links for r in got), sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    return found / max(there, 1)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_links_of_clusters_and_odd_vectors(spark, rows, kind):
    want = brute(rows)
    got = pivot_index.near_vectors(frame(spark, rows, kind)).collect()
    assert compare(got, want) >= 0.99
    exact = [r for r in got if (r.n_links, r.component_id) == want[r.vec_id]]
    assert len(exact) >= 0.97 * len(got)
    by_id = {r.vec_id: r for r in got}
    assert all((by_id[i].n_links, by_id[i].component_id) == (0, i) for i in range(90_001, 90_007))
    assert by_id[90_007].n_links == by_id[90_008].n_links == 1 and by_id[90_008].component_id == 90_007 and by_id[90_010].n_links == 0


def test_tiles_of_small_blocks_give_the_same(spark, rows, monkeypatch):
    want = {tuple(r) for r in pivot_index.near_vectors(frame(spark, rows)).collect()}
    monkeypatch.setattr(pivot_index, "BLOCK", 40)
    monkeypatch.setattr(pivot_index, "PAIRS", 64)
    assert {tuple(r) for r in pivot_index.near_vectors(frame(spark, rows)).collect()} == want


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above 0.9 among unrelated vectors: the hardest case for the descriptions."""
    r = np.random.default_rng(9)
    x, y = (r.normal(size=(600, 64)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.902 * x + math.sqrt(1 - 0.902**2) * y
    rows = [(i, float32(v)) for i, v in enumerate(np.concatenate([x, z, r.normal(size=(600, 64))]))]
    assert compare(pivot_index.near_vectors(frame(spark, rows)).collect(), brute(rows)) >= 0.95


def test_repeats_nulls_ties_and_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(5, one), (5, one), (None, one), (9, [2.0, 4.0, 6.0]), (None, [0.0, 0.0, 0.0]), (None, [-1.0, 5.0, 1.0]), (11, [9.0, 3.0, 3.0, 1.0]), (12, [1.0, 0.0, 0.0, 0.0])]
    got = sorted(pivot_index.near_vectors(frame(spark, rows)).collect(), key=str)
    told = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got)
    assert told == sorted([("5", 3, "5", True), ("5", 3, "5", True), ("None", 3, "5", False), ("9", 3, "5", False), ("None", 0, "None", True), ("None", 0, "None", True), ("11", 1, "11", True), ("12", 1, "11", False)])
    assert pivot_index.near_vectors(frame(spark, [])).count() == 0


def test_lengths_without_pivots_are_compared_whole(spark, rows, monkeypatch):
    monkeypatch.setattr(pivot_index, "fitted", lambda classes, least: {})
    want = brute(rows)
    got = pivot_index.near_vectors(frame(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_sums_of_large_and_small_numbers():
    x = pivot_index.unit(np.array([[3e300, 4e300], [3e-300, 4e-300], [3.0, 4.0]]))
    assert np.allclose(x, [[0.6, 0.8]] * 3, atol=1e-15)
