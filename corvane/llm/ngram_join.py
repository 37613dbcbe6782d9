"""Exact n-gram Jaccard join: size-banded tiles, bitmaps, sorted-array intersection.

Equal shingle sets are one class. In a band of set sizes, two linked sets differ in at most D shingles;
dealt by hash into more than D parts, they agree in one. Sets with an equal part meet in a tile. Small
tiles compare all their sets; large ones first compare with one set, then only sets of different
components that share a large tile and whose bitmaps allow a link, so a group of near copies costs as much
as its size. Hashed bitmaps bound the overlap from above, the sorted arrays then tell it exactly. No link is lost. Null and wordless texts have no
shingles and link with nothing; a null doc_id is never a component's id unless alone; repeated rows
share a class; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.components import components as connected

from .shared import one_each, settled
from .textblocks import _U, blocks, distinct, give_back, long, mix, shingles

SHINGLES_A_BUCKET, FLUSH, SMALL_TILE, CENTRES, BLOCK_ITEMS, BLOCK_ROWS = 2_000_000, 500_000, 16, 4, 3_000_000, 2_000
#: Bits of the bitmap that tells which rows' arrays are wanted; where it would be too full, a join tells.
BITMAP = 1 << 26
#: Of texts whose parts are keyed together; an executor's workers do so side by side.
KEYED_BYTES = 1 << 20


class Bands:
    """For a threshold of percent: band k holds sizes from low[k]; parts[k] for pairs whose smaller set lies in it."""

    def __init__(self, percent: int, most: int = 1 << 34):
        low = [1]
        while low[-1] < most:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * 100 / percent)))
        self.low = np.array(low)
        smaller = self.low[1:] - 1
        larger = smaller * 100 // percent
        differ = (smaller + larger) * (100 - percent) // (100 + percent)
        load = self.low[:-1] / (differ + 4)
        self.spare = 3 + np.ceil(2 * differ * np.exp(-load)).astype(np.int64)
        self.parts = differ + 1 + self.spare


def class_of(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 63-bit id) of each text's distinct shingles."""
    size = np.bincount(owner, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner, mix(value * _U(0xC2B2AE3D27D4EB4F) + _U(1)))
    return size, (mix(total + size.astype(np.uint64) * _U(0x165667B19E3779F9)) >> _U(1)).astype(np.int64)


def _sets(k):
    def run(batches):
        for batch in batches:
            for part, block in blocks(batch):
                value, owner = shingles(block, k)
                o, v, _ = distinct(owner, value)
                size, cls = class_of(o, v, block.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), long(size), long(cls), bitmaps(o, v, size)], names=["doc_id", "t", "n", "cls", "bits"])
        give_back()

    return run


def bitmaps(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> pa.Array:
    """A bitmap of each text's shingles: a power of two of bits, about one a shingle, 64 at least."""
    bits = np.int64(64) << np.frexp(size // 64)[1].astype(np.int64)
    end = np.cumsum(bits)
    flat = np.zeros(int(bits.sum()), bool)
    flat[(end - bits)[owner] + (value & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, end // 8).astype(np.int32)), pa.py_buffer(np.packbits(flat))])


def _keys(k, percent, buckets):
    def run(batches):
        bands = Bands(percent)
        held, count = [], 0

        def flush():
            keys, ids = (np.concatenate(x) for x in zip(*held))
            bucket = (keys >> _U(32)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            keys, ids, ends = keys[order], ids[order], np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            rows = [(b, keys[s:e].tobytes(), ids[s:e].tobytes()) for b, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "ids"])

        for batch in batches:
            for _, block in blocks(batch, most=KEYED_BYTES):
                value, owner = shingles(block, k)
                o, v, _ = distinct(owner, value)
                size, cls = class_of(o, v, block.n)
                hashed, weight = mix(v + _U(0x51ED270B)) >> _U(32), mix(v * _U(0x2545F4914F6CDD1D) + _U(9))
                own = np.searchsorted(bands.low, np.maximum(size, 1), "right") - 1
                for below in (0, 1):
                    # as the larger set of a pair, in the band below as well
                    ok = (size > 0) & (own - below >= 0)
                    band = np.maximum(own - below, 0)
                    parts = np.where(ok, bands.parts[band], 0)
                    base = np.cumsum(parts) - parts
                    take = ok[o]
                    slot = base[o[take]] + ((hashed[take] * parts[o[take]].astype(np.uint64)) >> _U(32)).astype(np.int64)
                    total = int(parts.sum())
                    signature = np.zeros(total, np.uint64)
                    np.add.at(signature, slot, weight[take])
                    filled = np.bincount(slot, minlength=total)
                    whose = np.repeat(np.arange(block.n), parts)
                    index = np.arange(total) - base[whose]
                    empty = np.bincount(whose[filled == 0], minlength=block.n)
                    use = (filled > 0) | (empty > bands.spare[band])[whose]
                    key = mix(signature + filled.astype(np.uint64) * _U(31) + mix(index.astype(np.uint64) * _U(4096) + band[whose].astype(np.uint64)))
                    held.append((key[use], cls[whose[use]]))
                    count += int(use.sum())
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()
        give_back()

    return run


def _tiles(t: pa.Table) -> pa.Table:
    """Pairs (a, b) to compare; key: of tiles too large to compare all pairs, whose pairs here have the least class."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in t["ids"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    keep = same[:-1] | same[1:]
    keys, ids, _ = distinct(keys[keep], ids[keep])
    size = np.diff(np.flatnonzero(np.append(np.append(True, keys[1:] != keys[:-1]), True))) if len(keys) else np.zeros(0, np.int64)
    small, a, b = np.repeat(size <= SMALL_TILE, size), [], []
    for step in range(1, SMALL_TILE):
        i = np.arange(max(len(keys) - step, 0))
        i = i[(keys[i] == keys[i + step]) & small[i]]
        a.append(ids[i])
        b.append(ids[i + step])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    # of a large tile: its sets against one of them, which one of a few orders of all sets puts first
    keys, ids = keys[~small], ids[~small]
    order = np.lexsort((mix(ids.astype(np.uint64) ^ mix(keys % _U(CENTRES))), keys))
    keys, ids = keys[order], ids[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    centre = ids[np.flatnonzero(first)][np.cumsum(first) - 1] if len(keys) else ids
    keys, ids, centre = keys[~first], ids[~first], centre[~first]
    return pa.table({
        "key": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), long(keys.view(np.int64))]),
        "a": long(np.concatenate([pairs[:, 0], np.minimum(ids, centre)])), "b": long(np.concatenate([pairs[:, 1], np.maximum(ids, centre)])),
    })


def bitmap_of(rows: DataFrame, n: int) -> np.ndarray:
    """Of the hashes ``h`` of n rows: a bitmap of some 32 bits for each, that hashes of other rows seldom meet. It has BITMAP bits at most."""
    bits = 1 << min(max(16, (32 * n).bit_length()), BITMAP.bit_length() - 1)
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = rows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _arrays(k, bitmap=None):
    """Sorted shingles of texts; bitmap: only of rows whose hash ``h`` it has."""

    def run(batches):
        for batch in batches:
            if bitmap is not None:
                h = batch.column(batch.schema.get_field_index("h")).to_numpy().view(np.uint64) & _U(64 * len(bitmap) - 1)
                batch = batch.filter(pa.array((bitmap[h >> _U(6)] >> (h & _U(63)) & _U(1)).astype(bool)))
            for _, block in blocks(batch):
                value, owner = shingles(block, k)
                o, v, _ = distinct(owner, value)
                size, cls = class_of(o, v, block.n)
                ptr = np.searchsorted(o, np.arange(block.n + 1))
                rows = [v[s:e].tobytes() for s, e in zip(ptr, ptr[1:])]
                yield pa.RecordBatch.from_arrays([long(cls), pa.array(rows, pa.binary())], names=["cls", "items"])
        give_back()

    return run


def may_link(percent: int, n_x: int, n_y: int, bits_x: bytes, bits_y: bytes) -> bool:
    """Whether sets of these sizes and bitmaps can reach the threshold. The longer bitmap is folded to the shorter one's length."""
    if 100 * min(n_x, n_y) < percent * max(n_x, n_y):
        return False
    x, y = sorted((np.frombuffer(bits_x, np.uint64), np.frombuffer(bits_y, np.uint64)), key=len)
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)))
    total = n_x + n_y
    most = (total - int(np.bitwise_count(x ^ y).sum())) // 2
    return 100 * most >= percent * (total - most)


def _possible(percent):
    def run(batches):
        for batch in batches:
            ok = [may_link(percent, *row) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def linked(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sorted arrays' overlap reaches the threshold."""
    total = len(x) + len(y)
    both = np.sort(np.concatenate([x, y]), kind="stable")
    overlap = int((both[1:] == both[:-1]).sum())
    return 100 * overlap >= percent * (total - overlap)


def _verified(percent):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = [
                linked(percent, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                for x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3)))
            ]
            yield pa.RecordBatch.from_arrays([long(a[ok]), long(b[ok])], names=["a", "b"])

    return run


def _compared(percent):
    """Links of one block that join its labels: its visitors against its homes of other labels, bitmaps first."""

    def run(t: pa.Table) -> pa.Table:
        node, label, home = (t[c].to_numpy() for c in ("node", "label", "home"))
        items = [np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()]
        size = np.array([len(x) for x in items])
        bits = 64 << max(0, int(size.max()) // 32).bit_length()
        maps = np.zeros((len(items), bits // 64), np.uint64)
        for i, x in enumerate(items):
            at = x % _U(bits)
            np.bitwise_or.at(maps[i], (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        homes, a, b = np.flatnonzero(home), [], []
        _, at = np.unique(label, return_inverse=True)
        group = np.arange(len(label))  # of each label: those that links found here have joined are one
        for v in np.flatnonzero(~home):
            c = homes[100 * np.minimum(size[homes], size[v]) >= percent * np.maximum(size[homes], size[v])]
            c = c[group[at[c]] != group[at[v]]]
            most = (size[c] + size[v] - np.bitwise_count(maps[c] ^ maps[v]).sum(1).astype(np.int64)) // 2
            for i in c[100 * most >= percent * (size[c] + size[v] - most)]:
                if group[at[i]] != group[at[v]] and linked(percent, items[i], items[v]):
                    group[group == group[at[i]]] = group[at[v]]
                    a.append(min(node[i], node[v]))
                    b.append(max(node[i], node[v]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _plausible(percent):
    """Of one block of a tile, its visitors against its homes of other labels: pairs that may link by size and bitmap, as many as join all that these join."""

    def run(t: pa.Table) -> pa.Table:
        node, label, home, n = (t[c].to_numpy() for c in ("node", "label", "home", "n"))
        maps = [np.frombuffer(x, np.uint64) for x in t["bits"].to_pylist()]
        length = np.array([len(x) for x in maps])
        homes, guests, group, a, b = np.flatnonzero(home), np.flatnonzero(~home), {}, [], []

        def top(x: int) -> int:
            while (y := group.get(x, x)) != x:
                group[x] = group.get(y, y)
                x = y
            return x

        for least in np.unique(length):  # two maps compare at the shorter one's length, to which the longer one is folded
            at = np.flatnonzero(length >= least)
            folded = np.zeros((len(node), least), np.uint64)
            folded[at] = [np.bitwise_or.reduce(maps[i].reshape(-1, least)) for i in at]
            for v in guests[length[guests] >= least]:
                c = homes[(length[homes] == least) if length[v] > least else (length[homes] >= least)]
                c = c[(label[c] != label[v]) & (100 * np.minimum(n[c], n[v]) >= percent * np.maximum(n[c], n[v]))]
                total = n[c] + n[v]
                most = (total - np.bitwise_count(folded[c] ^ folded[v]).sum(1).astype(np.int64)) // 2
                for i in c[100 * most >= percent * (total - most)]:
                    x, y = top(int(node[i])), top(int(node[v]))
                    if x != y:
                        group[x] = y
                        a.append(min(node[i], node[v]))
                        b.append(max(node[i], node[v]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _left(star: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) that join the sets of all pairs of different labels that share a large tile and may link by their bitmaps.

    A tile's sets outside its largest label visit the blocks of its sets, with bitmaps alone, so what is moved is a small part of the arrays.
    """
    sides = star.select("key", F.col("a").alias("node")).union(star.select("key", F.col("b").alias("node")))
    sides = sides.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = sides.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    sides = sides.join(mixed, "key", "left_semi").distinct()
    rows = settled(sides.join(classes.select(F.col("cls").alias("node"), "n", "bits"), "node").select("key", "node", "label", "n", "bits"), "ngram-mixed")
    counts = settled(rows.groupBy("key", "label").agg(F.count("*").alias("count"), F.sum("n").alias("n")), "ngram-counts")
    parts = lambda n, count: F.ceil(F.greatest(n / BLOCK_ITEMS, count / BLOCK_ROWS))
    tiles = counts.groupBy("key").agg(F.max_by(F.struct("label", "n", "count"), F.struct("count", "label")).alias("most"), F.sum("n").alias("n"), F.sum("count").alias("count"))
    own = (F.col("n") - F.col("most.n"), F.col("count") - F.col("most.count"))
    tiles = settled(tiles.select("key", F.col("most.label").alias("largest"), parts(F.col("n"), F.col("count")).alias("blocks"), parts(*own).alias("chunks")), "ngram-guests")
    rows = rows.join(tiles, "key")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    home = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("chunk", every("chunks"))
    guest = rows.filter("label <> largest").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("block", every("blocks"))
    columns = ["key", "block", "chunk", "node", "label", "n", "bits"]
    both = home.select(*columns, F.lit(True).alias("home")).unionByName(guest.select(*columns, F.lit(False).alias("home")))
    return both.groupBy("key", "block", "chunk").applyInArrow(_plausible(percent), "a long, b long").distinct()


def _rest(edges: DataFrame, labels: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links between sets of different labels in a group that edges join: enough to join all that links join.

    The sets outside a group's largest label visit the blocks of its sets in the bands of sizes around theirs.
    """
    log = math.log(100 / percent)
    groups = components(edges).withColumnRenamed("label", "grp")
    sets = sets_of(groups.select(F.col("node").alias("cls")))
    nodes = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = nodes.join(sets.select(F.col("cls").alias("node"), "items"), "node").withColumn("n", F.octet_length("items") / 8)
    nodes = settled(nodes.withColumn("band", F.floor(F.log("n") / log)), "ngram-rest")
    # what is known of each group is written first, so that the joins read plain shuffles and a large group can be split
    largest = settled(nodes.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("largest")), "ngram-largest")
    visitors = nodes.join(largest, "grp").filter("label <> largest").drop("largest")
    parts = lambda: F.ceil(F.greatest(F.sum("n") / BLOCK_ITEMS, F.count("*") / BLOCK_ROWS))
    bands = settled(nodes.groupBy("grp", "band").agg(parts().alias("blocks")), "ngram-bands")
    guests = settled(visitors.groupBy("grp").agg(parts().alias("chunks")), "ngram-guests")
    home = nodes.join(bands, ["grp", "band"]).join(guests, "grp").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    home = home.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    guest = visitors.join(guests, "grp").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    guest = guest.join(bands, ["grp", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["grp", "band", "block", "chunk", "node", "label", "items"]
    both = home.select(*columns, F.lit(True).alias("home")).unionByName(guest.select(*columns, F.lit(False).alias("home")))
    return both.groupBy("grp", "band", "block", "chunk").applyInArrow(_compared(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links reach, in logarithmically many rounds."""
    return connected(links, settled)


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, t (the text's hash), n_shingles, class_id, group_id (of what links reach; null without shingles), component_id of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    signed = settled(texts.mapInArrow(_sets(k), "doc_id long, t long, n long, cls long, bits binary"), "ngram-classes")
    buckets = max(64, -(-(signed.agg(F.sum("n")).first()[0] or 0) // SHINGLES_A_BUCKET))
    keys = texts.mapInArrow(_keys(k, percent, buckets), "bucket int, keys binary, ids binary")
    tiles = settled(keys.groupBy("bucket").applyInArrow(_tiles, "key long, a long, b long"), "ngram-tiles")
    classes = settled(signed.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "t")).alias("row"), F.min("n").alias("n"), F.min("bits").alias("bits")), "ngram-firsts")
    # bitmaps first: of what shares a part, only pairs that can reach the threshold fetch their arrays
    left, right = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    pairs = tiles.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    pairs = settled(pairs.mapInArrow(_possible(percent), "a long, b long"), "ngram-pairs")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(cls, items) of the wanted classes, and maybe of some others."""
        rows = wanted.distinct().join(classes.select("cls", "row"), "cls").select(F.col("row.doc_id").alias("_id"), F.col("row.t").alias("_t"))
        rows = settled(rows.withColumn("h", F.xxhash64("_id", "_t")), "ngram-wanted")
        if (n := rows.count()) * 8 <= BITMAP:  # few enough to be told by a bitmap, so no text moves
            own, bitmap = texts.withColumn("h", F.xxhash64("doc_id", "t")), bitmap_of(rows, n)
        else:
            own, bitmap = texts.join(rows, (texts.t == rows._t) & texts.doc_id.eqNullSafe(rows._id), "left_semi"), None
        arrays = own.mapInArrow(_arrays(k, bitmap), "cls long, items binary")
        return settled(arrays.dropDuplicates(["cls"]), "ngram-sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")))
    left, right = (sets.select(F.col("cls").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
    links = settled(both.mapInArrow(_verified(percent), "a long, b long"), "ngram-links")
    labels = components(links)
    # of large tiles whose sets are not of one component yet, those that may link
    edges = settled(_left(tiles.filter("key is not null"), labels, classes, percent), "ngram-left")
    if not edges.isEmpty():
        labels = components(links.union(_rest(edges, labels, sets_of, percent)))
    least = classes.select("cls", "first").join(labels, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("label", "cls").alias("label"))
    least = settled(least, "ngram-labels")
    component = least.groupBy("label").agg(F.min("first").alias("component_id")).join(least, "label").select("cls", "label", "component_id")
    out = signed.join(component, "cls", "left")
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.col("label").alias("group_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its own columns: the one with the least doc_id, of several the one with the least hash of its text.

    Rows without shingles stay, but for repeats of (doc_id, text); null doc_ids come after others.
    """
    found = ngram_components(docs, k, percent)
    first = found.filter("n_shingles > 0").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("row"))
    return one_each(docs, first.select("row.doc_id", "row.t").unionByName(found.filter("n_shingles = 0").select("doc_id", "t")))
