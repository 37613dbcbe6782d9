"""Near duplicates among embeddings by a pivot-permutation index.

Reference points, the pivots, are vectors of a bounded sample, no two of them within half the link angle. Every vector
is described by its NEAREST pivots in order of nearness. Inverted lists hold, for each pivot, the vectors that name it;
two vectors are retrieved for each other if their descriptions share SHARED pivots or more, which is counted, and are
then verified by cosine in double precision. With pivots ranked by how seldom the sample names them, only the first
NEAREST - SHARED + 1 by rank of a description need be listed: two that share enough meet there. A pair is taken where
its least shared pivot is, so once. Lists of any length are compared in tiles of blocks; no pair leaves a task: it gives
counts, and the links that join what isn't joined yet.

Equal vectors are one class. Classes within half the link angle of their nearest pivot are linked with each other for
certain, so they stand in the lists as one knot, with the pivot as its vector and their largest angle as its radius:
a hot group of near copies costs as much as its size. What meets a knot is linked with all of it, with none of it, or,
between these bounds, compared with its members in tiles.

Results: n_links counts rows (copies too), component_id is the least vec_id that links reach. Null, empty and zero vectors and those
with null or non-finite components link with nothing, nor do vectors of different lengths; vectors of a length that the
sample doesn't hold are compared with all of their kind. A null vec_id is counted as a neighbour, but is a component's
id only if it is alone; repeated vec_ids count as rows; an empty table gives no rows. Pivots: 4 for each
square root of the classes, at most MOST_PIVOTS and PIVOT_BYTES, out of SAMPLE times as many vectors. Recall is measured in the tests
(0.98 at a cosine of 0.9, next to 1 for copies).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import components
from .shared import settled
from .textblocks import give_back, long

LEAST, NEAREST, SHARED = 0.9, 8, 2
MOST_PIVOTS, PIVOT_BYTES, SAMPLE = 16_384, 64 << 20, 4
#: Vectors of a block; a tile compares two. Pairs looked at together after the products.
BLOCK, PAIRS, SLACK = 2_000, 100_000, 1e-6
OTHER = -1  # the list of vectors of lengths without pivots


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0.0))[1])
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def chosen(sample: np.ndarray, most: int, least: float) -> np.ndarray:
    """Of the sample's unit vectors in order, those that aren't within half the link angle of one already chosen."""
    near, out, n = math.cos(math.acos(least) / 2), np.empty((min(most, len(sample)), sample.shape[1])), 0
    for at in range(0, len(sample), 256):
        rows = sample[at : at + 256]
        for row in rows[(rows @ out[:n].T < near).all(1)]:
            if n < len(out) and (out[:n] @ row < near).all():
                out[n] = row
                n += 1
    return out[:n]


def described(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest pivots of each row in order of nearness, cosine to the first)."""
    cos = x @ pivots.T
    k = min(NEAREST, len(pivots))
    some = np.argpartition(-cos, k - 1, 1)[:, :k]
    order = np.lexsort((some, -np.take_along_axis(cos, some, 1)))
    near = np.take_along_axis(some, order, 1)
    return near, np.take_along_axis(cos, near[:, :1], 1)[:, 0]


def fitted(classes: DataFrame, least: float) -> dict[int, tuple[int, np.ndarray]]:
    """length -> (number of its first pivot, pivots), from the vectors that hash least; within a length, those seldom named come first."""
    n, widest = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return {}
    want = min(MOST_PIVOTS, PIVOT_BYTES // (8 * widest) + 1, max(16, 4 * math.isqrt(n)))
    vectors = _vectors(classes.orderBy("c1", "c2").limit(SAMPLE * want).select("vec").toArrow().column(0).combine_chunks())
    out, first, length = {}, 0, np.array([len(v) for v in vectors])
    for d in np.unique(length).tolist():
        x = unit(np.stack([vectors[i] for i in np.flatnonzero(length == d)]).astype(float))
        pivots = chosen(x, want, least)
        named = np.bincount(np.concatenate([described(x[i : i + 1000], pivots)[0].ravel() for i in range(0, len(x), 1000)]), minlength=len(pivots))
        out[d] = (first, pivots[np.argsort(named, kind="stable")])
        first += len(pivots)
    return out


def _vectors(column) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(ends, ends[1:])]


def listed(near: np.ndarray) -> np.ndarray:
    """Of descriptions (pivots are ranked by number) what is listed: all but the SHARED - 1 highest."""
    near = np.sort(near, 1)
    return near[:, : near.shape[1] - min(SHARED, near.shape[1]) + 1]


def _indexed(index, least: float):
    """Adds to (cls, vec, ...) its description, the lists it is in, its knot if it is near enough to its first pivot, and the angle to that."""
    half = math.acos(least) / 2 - SLACK

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                vectors = _vectors(part.column(1))
                length = np.array([len(v) for v in vectors])
                near, lists, knot, angle = [[]] * len(vectors), [[OTHER]] * len(vectors), np.full(len(vectors), -1), np.zeros(len(vectors))
                for d in np.unique(length):
                    if int(d) in index.value:
                        own, (first, pivots) = np.flatnonzero(length == d), index.value[int(d)]
                        names, cos = described(unit(np.stack([vectors[i] for i in own]).astype(float)), pivots)
                        turn = np.arccos(np.clip(cos, -1, 1))
                        for i, a, b in zip(own, (names + first).tolist(), (listed(names) + first).tolist()):
                            near[i], lists[i] = a, b
                        angle[own] = turn
                        knot[own] = np.where(turn <= half, names[:, 0] + first, -1)
                ids = pa.array(np.where(knot < 0, 0, knot), pa.int32(), mask=knot < 0)
                more = [pa.array(near, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int32())), ids, pa.array(angle)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "near", "lists", "knot", "angle"])
        give_back()

    return run


def _knotted(index):
    """(knot, n, radius) -> the knot as an entry of the lists, with its pivot's vector; its id is below zero."""

    def run(batches):
        at = {first + i: (first, pivots, i) for first, pivots in index.value.values() for i in range(len(pivots))}
        for batch in batches:
            rows = []
            for knot, n, radius in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first, pivots, i = at[knot]
                near = described(pivots[i : i + 1], pivots)[0]
                rows.append((-1 - knot, n, radius, pivots[i].tolist(), (near[0] + first).tolist(), (listed(near)[0] + first).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "n", "radius", "vec", "near", "lists"])

    return run


class Links:
    """What a task finds: rows to add to each entry's count, links that join entries, and pairs that bounds can't decide."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.add = ids, np.zeros(len(ids), np.int64)
        self.group, self.joined, self.open = np.arange(len(ids)), [], []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keeps links that join two groups; groups are relabelled, so that each round of a whole array leaves at least half as many unjoined ones."""
        while len(i):
            a, b = self.group[i], self.group[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(i):
                return
            to, first = np.unique(b, return_index=True)  # each higher group joins one lower group: no cycles
            self.joined += list(zip(i[first], j[first]))
            new = np.arange(len(self.group))
            new[to] = a[first]
            while (new != new[new]).any():
                new = new[new]
            self.group = new[self.group]

    def table(self) -> pa.Table:
        has = np.flatnonzero(self.add)
        pairs = np.array([*self.joined, *self.open], np.int64).reshape(-1, 2)
        kind = np.concatenate([np.zeros(len(has)), np.ones(len(self.joined)), np.full(len(self.open), 2)]).astype(np.int32)
        b = np.concatenate([self.add[has], self.ids[pairs[:, 1]]])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": long(np.concatenate([self.ids[has], self.ids[pairs[:, 0]]])), "b": long(b)})


def blocks_of(x: np.ndarray, y: np.ndarray, same: bool):
    """(rows of x, rows of y, cosines) of all pairs, in slices of x; of one block with itself each pair once."""
    for at in range(0, len(x), 500):
        cos = x[at : at + 500] @ y.T
        if same:
            cos[np.arange(len(cos))[:, None] >= np.arange(len(y))[None, :] - at] = -2
        yield at, cos


def _tiles(least: float):
    """Verifies the pairs of one tile that share enough pivots and whose least shared one is this list's."""
    theta = math.acos(least)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pivot, i, j = (k.as_py() for k in key)
        t = t.combine_chunks()
        ids, n, radius, block = (t[c].to_numpy() for c in ("id", "n", "radius", "block"))
        near, vectors = t["near"].chunk(0), _vectors(t["vec"].chunk(0))
        length, found = np.array([len(v) for v in vectors]), Links(ids)
        for d in np.unique(length):
            left, right = (np.flatnonzero((length == d) & (block == k)) for k in (i, j))
            x, y = (unit(np.stack([vectors[k] for k in side]).astype(float)) if len(side) else np.zeros((0, d)) for side in (left, right))
            if not len(x) or not len(y):
                continue
            if pivot != OTHER:
                names_x, names_y = (np.array(near.take(pa.array(side)).to_pylist()) for side in (left, right))
                need = min(SHARED, names_x.shape[1])
            knots = bool((ids[left] < 0).any() or (ids[right] < 0).any())
            for at, cos in blocks_of(x, y, i == j):
                bound = np.full(cos.shape, least) if not knots else np.cos(np.minimum(theta + radius[left[at : at + len(cos)], None] + radius[right][None, :] + SLACK, math.pi))
                bound = np.where((ids[left[at : at + len(cos)], None] < 0) | (ids[right][None, :] < 0), bound, least) if knots else bound
                a, b = np.nonzero(cos >= bound)
                for s in range(0, len(a), PAIRS):
                    p, q = a[s : s + PAIRS] + at, b[s : s + PAIRS]
                    if pivot != OTHER:
                        both = names_x[p][:, :, None] == names_y[q][:, None, :]
                        shared, lowest = both.sum((1, 2)), np.where(both.any(2), names_x[p], np.iinfo(np.int32).max).min(1)
                        use = (shared >= need) & (lowest == pivot)
                        p, q = p[use], q[use]
                    u, v = left[p], right[q]
                    turn = np.arccos(np.clip(cos[p - at, q], -1, 1)) + radius[u] + radius[v]
                    sure = ((ids[u] >= 0) & (ids[v] >= 0)) | (turn <= theta - SLACK)
                    found.open += list(zip(u[~sure], v[~sure]))
                    u, v = u[sure], v[sure]
                    for x_side, y_side in ((u, v), (v, u)):
                        found.add += np.bincount(x_side, n[y_side], len(ids)).astype(np.int64)
                    found.join(u, v)
        return found.table()

    return run


def _members(least: float):
    """Guests against a knot's members, pair by pair: rows to add to each class, links of guests with the knot."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, node, n, guest = (t[c].to_numpy() for c in ("cls", "node", "n", "guest"))
        vectors = _vectors(t["vec"].chunk(0))
        left, right = np.flatnonzero(guest), np.flatnonzero(~guest)
        add, linked = np.zeros(len(ids), np.int64), []
        if len(left) and len(right):
            x, y = (unit(np.stack([vectors[k] for k in side]).astype(float)) for side in (left, right))
            for at, cos in blocks_of(x, y, False):
                hit = cos >= least
                add[left[at : at + len(cos)]] += hit @ n[right]
                add[right] += n[left[at : at + len(cos)]] @ hit
                linked += node[left[at : at + len(cos)]][hit.any(1)].tolist()
        linked, has = sorted(set(linked)), np.flatnonzero(add)
        kind = np.repeat(np.array([0, 1], np.int32), [len(has), len(linked)])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": long(np.concatenate([ids[has], np.array(linked, np.int64)])), "b": long(np.concatenate([add[has], np.full(len(linked), -1 - key[0].as_py(), np.int64)]))})

    return run


FOUND = "kind int, a long, b long"


def _opened(pairs: DataFrame, singles: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Pairs of an entry and a knot (of two knots, the guests are the members of the one with the lesser number)."""
    both = pairs.select(F.least("a", "b").alias("k"), F.greatest("a", "b").alias("g")).withColumn("knot", (-1 - F.col("k")).cast("int"))
    alone = both.filter("g >= 0").join(singles.select(F.col("cls").alias("g"), "n", "vec"), "g").select("knot", F.col("g").alias("cls"), F.col("g").alias("node"), "n", "vec")
    knots = both.filter("g < 0").select("knot", "g", (-1 - F.col("g")).cast("int").alias("other"))
    knots = knots.join(members.select(F.col("knot").alias("other"), "cls", "n", "vec"), "other").select("knot", "cls", F.col("g").alias("node"), "n", "vec")
    guests = alone.unionByName(knots)
    hosts = members.join(both.select("knot").distinct(), "knot", "left_semi").select("knot", "cls", (-1 - F.col("knot")).cast("long").alias("node"), "n", "vec")
    parts = lambda x, name: x.groupBy("knot").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    # a row for each knot: no more rows than pivots
    sizes = F.broadcast(settled(parts(guests, "chunks").join(parts(hosts, "blocks"), "knot"), "pivot-opened"))
    number = lambda n: F.pmod(F.xxhash64("cls"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    guests = guests.join(sizes, "knot").withColumn("chunk", number("chunks")).withColumn("block", every("blocks")).withColumn("guest", F.lit(True))
    hosts = hosts.join(sizes, "knot").withColumn("block", number("blocks")).withColumn("chunk", every("chunks")).withColumn("guest", F.lit(False))
    columns = ["knot", "chunk", "block", "guest", "cls", "node", "n", "vec"]
    return guests.select(*columns).unionByName(hosts.select(*columns)).groupBy("knot", "chunk", "block").applyInArrow(_members(least), FOUND)


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding); links are pairs with a cosine of ``least`` or more."""
    spark = vectors.sparkSession
    item = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("vec"))
    rows = rows.withColumn("usable", F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False)))
    code = lambda k: F.xxhash64(F.lit(k), "vec")
    usable = rows.filter("usable").select("vec_id", "vec", code(1).alias("c1"), code(2).alias("c2"))
    classes = usable.groupBy("c1", "c2", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = settled(classes.withColumn("cls", F.monotonically_increasing_id()), "pivot-classes")
    index = spark.sparkContext.broadcast(fitted(classes, least))
    shape = f"cls long, vec array<{item}>, first long, n long, c1 long, c2 long, near array<int>, lists array<int>, knot int, angle double"
    whole = settled(classes.select("cls", "vec", "first", "n", "c1", "c2").mapInArrow(_indexed(index, least), shape), "pivot-entries")
    singles, members = whole.filter("knot is null"), whole.filter("knot is not null")
    knots = settled(members.groupBy("knot").agg(F.sum("n").alias("n"), F.max("angle").alias("radius"), F.min("first").alias("first")), "pivot-knots")
    ids = "id long, n long, radius double, vec array<double>, near array<int>, lists array<int>"
    entries = singles.select(F.col("cls").alias("id"), "n", F.lit(0.0).alias("radius"), "vec", "near", "lists")
    stood = knots.select("knot", "n", "radius").mapInArrow(_knotted(index), ids).withColumn("vec", F.col("vec").cast(f"array<{item}>"))
    entries = entries.unionByName(stood).withColumn("pivot", F.explode("lists")).drop("lists")
    # a row for each list: no more rows than pivots
    sizes = F.broadcast(settled(entries.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "pivot-lists"))
    dealt = entries.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    found = settled(dealt.select("pivot", "i", "j", "block", "id", "n", "radius", "near", "vec").groupBy("pivot", "i", "j").applyInArrow(_tiles(least), FOUND), "pivot-found")
    links, adds, own = found.filter("kind = 1").select("a", "b"), found.filter("kind = 0"), None
    opened = found.filter("kind = 2").select("a", "b")
    if not opened.isEmpty():
        more = settled(_opened(opened, singles, members, least), "pivot-members")
        links, own = links.unionByName(more.filter("kind = 1").select("a", "b")), more.filter("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("own"))
    labels = components(links)
    nodes = singles.select(F.col("cls").alias("node"), "first").unionByName(knots.select((-1 - F.col("knot")).cast("long").alias("node"), "first"))
    nodes = settled(nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "pivot-nodes")
    least_id = settled(nodes.groupBy("label").agg(F.min("first").alias("component_id")), "pivot-components")
    nodes = nodes.join(least_id, "label").join(adds.groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("add")), "node", "left")
    nodes = settled(nodes.select("node", "component_id", F.coalesce("add", F.lit(0)).alias("add")), "pivot-nodes")
    told = whole.select("cls", "n", "c1", "c2", "knot", F.coalesce((-1 - F.col("knot")).cast("long"), "cls").alias("node")).join(nodes, "node")
    told = told.join(F.broadcast(knots.select("knot", F.col("n").alias("inside"))), "knot", "left")
    if own is not None:
        told = told.join(own, "cls", "left")
    count = F.col("add") + F.coalesce("inside", "n") - 1 + (F.coalesce("own", F.lit(0)) if own is not None else F.lit(0))
    told = settled(told.select("c1", "c2", count.alias("n_links"), "component_id"), "pivot-told")
    out = usable.select("vec_id", "c1", "c2").join(told, ["c1", "c2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
