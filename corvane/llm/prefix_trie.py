"""Prefix trie of conversations from polynomial rolling prefix fingerprints.

A turn's value is a hash of (role, text); a prefix's fingerprint is the sum of its turns' values times powers of a base,
in several words of 64 bits. NumPy scans make it: conversations are sorted by ranges over all tasks, each task sums what
it has, and what a conversation began in earlier tasks is put before its rest by one multiplication, so a conversation
of any length is dealt over tasks. A conversation can be grafted: its first turns replaced by those of another one, whose
fingerprints are then put together from both conversations' sums without a further scan.

Prefixes of one depth and fingerprint are candidates for one node. Each group is verified turn by turn against its
representative: last role, last text and the group of the prefix before must be the same. Should one differ, all
is done again with twice as many words, until every group holds one prefix.

Parent rollup: nodes of several conversations pass what they save up to all prefixes of their representative, by one more
scan along the conversations and not level by level, so depth costs no rounds; leaves likewise.

Turns are ordered by turn, null first, then by role and text; null roles and texts are empty; repeated rows are turns of their own; rows with a null conv_id
belong to no conversation; extra columns are not read; an empty table gives no rows. In one task stay: rows of one conversation, turn,
role and first 32 characters, and the ids (a number each, streamed into the hash) of all conversations that end in one node, as that hash asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .textblocks import _U, long

#: A conversation takes over the first turns, at most MOST - 1, of the one whose id is the last multiple of EVERY.
EVERY, MOST = 100, 6
WORDS = 2
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2^64, by squaring."""
    out, e, square = np.ones(len(exponent), np.uint64), exponent.astype(np.uint64), base
    while (e > 0).any():
        out = np.where(e & _U(1), out * _U(square), out)
        e, square = e >> _U(1), square * square % (1 << 64)
    return out


def running(conv: np.ndarray, values: np.ndarray, base: int, carry: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Over rows sorted by conv: (position in conv, sums of value * base ** position before each row, carry for the next rows). values: a row for each word."""
    n = len(conv)
    first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    start = np.repeat(first, np.diff(np.append(first, n)))
    position = np.arange(n) - start
    known = carry and carry[0] == conv[0]
    if known:
        position[: (first[1] if len(first) > 1 else n)] += carry[1]
    terms = values * (power(base, position) if base != 1 else _U(1))
    sums = np.cumsum(terms, 1, dtype=np.uint64)
    before = sums - terms
    before -= before[:, start]
    if known:
        before[:, : (first[1] if len(first) > 1 else n)] += carry[2][:, None]
    return position, before, (int(conv[-1]), int(position[-1]) + 1, before[:, -1] + terms[:, -1])


def _scanned(words: int, base: int):
    """Columns: conv, the words, others. Puts position and sums before each row beside them; pid tells the task."""

    def run(batches):
        carry = ()
        for batch in batches:
            if batch.num_rows:
                conv = batch.column(0).to_numpy()
                values = np.stack([batch.column(1 + w).to_numpy().view(np.uint64) for w in range(words)])
                position, before, carry = running(conv, values, base, carry)
                yield pa.RecordBatch.from_arrays([*batch.columns, long(position), *(long(x.view(np.int64)) for x in before)], names=[*batch.schema.names, "position", *(f"before{w}" for w in range(words))])

    return run


def _based(bases: dict[int, tuple], words: int, base: int):
    """Puts what earlier tasks have of a conversation before what a task has of it."""

    def run(batches):
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("conv", "pid", "position", *(f"before{w}" for w in range(words)))}
            columns, conv, pid = list(batch.columns), batch.column(at["conv"]).to_numpy(), batch.column(at["pid"]).to_numpy()
            for p in np.unique(pid):
                if int(p) in bases:
                    own, (first, count, sums) = (pid == p), bases[int(p)]
                    own &= conv == first
                    columns[at["position"]] = long(columns[at["position"]].to_numpy() + own * count)
                    factor = pow(base, count, 1 << 64)
                    for w in range(words):
                        x = columns[at[f"before{w}"]].to_numpy().view(np.uint64)
                        columns[at[f"before{w}"]] = long(np.where(own, x * _U(factor) + _U(sums[w]), x).view(np.int64))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def scan(df: DataFrame, deal: list, order: list, words: int, base: int, name: str) -> DataFrame:
    """df (conv, v0.. of so many words, others) with each row's position in its conversation and the words' sums before it.

    Rows are dealt by ranges of ``deal`` and sorted by ``order`` within; a few numbers of each range go to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = "position long, " + ", ".join(f"before{w} long" for w in range(words))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + more
    rows = df.repartitionByRange(parts, *deal).sortWithinPartitions(*order).mapInArrow(_scanned(words, base), schema)
    rows = settled(rows.withColumn("pid", F.spark_partition_id()), name)
    tail = F.max(F.struct("conv", "position", *[f"{x}{w}" for x in ("before", "v") for w in range(words)])).alias("tail")
    bases, now = {}, None
    for r in sorted(rows.groupBy("pid").agg(F.min("conv").alias("first"), tail).collect()):
        t, whole = r.tail, 1 << 64
        count, sums = t.position + 1, [(t[f"before{w}"] + t[f"v{w}"] * pow(base, t.position, whole)) % whole for w in range(words)]
        if now and now[0] == r.first:
            bases[r.pid] = now
            if t.conv == r.first:
                factor = pow(base, now[1], whole)
                count, sums = now[1] + count, [(a + b * factor) % whole for a, b in zip(now[2], sums)]
        now = (t.conv, count, sums)
    return rows.mapInArrow(_based(bases, words, base), rows.schema) if bases else rows


def _rebuilt(words: int):
    """A turn of its own -> its depth and fingerprints in the rebuilt conversation: its sums without the lost turns', moved by powers of the base, after the graft's."""

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64)  # noqa: E731,B023
            position, lost, graft = (get(c).astype(np.int64) for c in ("position", "lost", "graft"))
            moved, turn = power(_INVERSE, lost - graft), power(_BASE, position)
            out = {"conv": batch.column(batch.schema.get_field_index("conv")), "depth": long(graft + position - lost + 1)}
            for w in range(words):
                before = get(f"before{w}")
                out[f"p{w}"] = long((get(f"graft{w}") + (before - get(f"lost{w}")) * moved).view(np.int64))
                out[f"f{w}"] = long((get(f"graft{w}") + (before + get(f"v{w}") * turn - get(f"lost{w}")) * moved).view(np.int64))
            for c in ("size", "ends", "role", "text"):
                if (i := batch.schema.get_field_index(c)) >= 0:
                    out[c] = batch.column(i)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _hashed(words: int):
    """Rows sorted by node and conversation -> each node's SHA-256 of its conversations' numbers; a number is fed at a time."""

    def run(batches):
        node, digest, done = None, None, []

        def out(done):
            columns = list(zip(*[(*k, d) for k, d in done]))
            kinds = [pa.int64()] * (1 + words) + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["depth", *(f"f{w}" for w in range(words)), "ends_sha256"])

        for batch in batches:
            keys, convs = list(zip(*(batch.column(i).to_pylist() for i in range(1 + words)))), batch.column(1 + words).to_pylist()
            for key, conv in zip(keys, convs):
                if key != node:
                    if digest:
                        done.append((node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if len(done) > 10_000:
                yield out(done)
                done = []
        if digest:
            done.append((node, digest.hexdigest()))
        if done:
            yield out(done)

    return run


def _ordered(conversations: DataFrame, words: int, hashed: Callable) -> DataFrame:
    """Turns in order, with the sums of the values before each."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("conv", *[hashed(w).alias(f"v{w}") for w in range(words)], "turn", "role", "text", F.length("text").cast("long").alias("size"))
    return scan(turns, ["conv", "turn", "role", F.substring("text", 1, 32)], ["conv", "turn", "role", "text"], words, _BASE, "trie-turns").drop("turn")


def _grafted(turns: DataFrame, words: int, every: int, most: int) -> DataFrame:
    """conv, turns, lost (h), graft (how many turns it takes over), theirs (these, in order), and the sums at both cuts."""
    state = [f"{x}{w}" for x in ("before", "v") for w in range(words)]
    early = F.array_sort(F.collect_list(F.when(F.col("position") < most, F.struct("position", *state, "size"))))
    convs = turns.groupBy("conv").agg((F.max("position") + 1).alias("turns"), early.alias("early"))
    lost = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = settled(convs.withColumn("lost", lost).withColumn("from", F.col("conv") - F.col("conv") % every), "trie-heads")
    theirs = convs.select(F.col("conv").alias("from"), F.col("turns").alias("their_turns"), F.col("early").alias("theirs"))
    both = convs.join(theirs, "from", "left").withColumn("graft", F.least("lost", F.coalesce("their_turns", F.lit(0))))
    both = both.withColumn("theirs", F.slice(F.coalesce("theirs", F.array().cast(convs.schema["early"].dataType)), 1, F.col("graft").cast("int")))
    # the sums before turn h of the own ones are needed where there is one
    at = lambda a, i, w: F.coalesce(F.get(a, i)[f"before{w}"], F.lit(0))
    both = both.select("conv", "turns", "lost", "graft", "theirs", "from", *[at("early", F.col("lost").cast("int"), w).alias(f"lost{w}") for w in range(words)])
    return settled(both, "trie-grafts")


def _taken(words: int):
    """The turns that conversations take over, as rows with their fingerprints."""

    def run(batches):
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            theirs, graft = batch.column(at["theirs"]), batch.column(at["graft"]).to_numpy()
            flat, whose = theirs.flatten(), np.repeat(np.arange(batch.num_rows), graft)
            position = flat.field("position").to_numpy(zero_copy_only=False)
            turn = power(_BASE, position)
            out = {"conv": batch.column(at["conv"]).take(pa.array(whose)), "depth": long(position + 1)}
            for w in range(words):
                before, value = (flat.field(f"{x}{w}").to_numpy(zero_copy_only=False).view(np.uint64) for x in ("before", "v"))
                out[f"p{w}"], out[f"f{w}"] = long(before.view(np.int64)), long((before + value * turn).view(np.int64))
            out["size"] = flat.field("size")
            end = (position + 1 == graft[whose]) & (batch.column(at["turns"]).to_numpy() <= batch.column(at["lost"]).to_numpy())[whose]
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(end)], names=[*out, "ends"])

    return run


def _at_graft(words: int):
    """Each conversation with the sums at its cut and its fingerprint at the end of what it takes over."""

    def run(batches):
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            graft = batch.column(at["graft"]).to_numpy()
            flat = batch.column(at["theirs"]).flatten()
            last, has = np.cumsum(graft) - 1, graft > 0
            sums = []
            for w in range(words):
                before, value = (flat.field(f"{x}{w}").to_numpy(zero_copy_only=False).view(np.uint64) for x in ("before", "v"))
                whole = before + value * power(_BASE, flat.field("position").to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(1, np.uint64)
                sums.append(long(np.where(has, whole[np.maximum(last, 0)], _U(0)).view(np.int64)))
            keep = ["conv", "turns", "lost", "graft", *(f"lost{w}" for w in range(words))]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in keep), *sums], names=[*keep, *(f"graft{w}" for w in range(words))])

    return run


def verified(rows: DataFrame, words: int) -> bool:
    """Whether each group of (depth, fingerprint) holds one prefix: its turns against its representative's, and the groups before them."""
    key, before = ["depth", *(f"f{w}" for w in range(words))], [f"p{w}" for w in range(words)]
    each = settled(rows.groupBy(*key, *before, "role", "text").agg(F.min("conv").alias("conv")), "trie-prefixes")
    many = each.groupBy(*key).agg(F.count("*").alias("kinds"), F.min("conv").alias("conv")).filter("kinds > 1")
    return many.isEmpty()


def prefix_trie(conversations: DataFrame, every: int = 1, most: int = 1, words: int = WORDS, bits: int = 64) -> DataFrame:
    """A row for each distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c first takes over the first h turns of c - c % every in place of its own first h, h = crc32(c) % most; every=1
    changes nothing. bits: how many of a turn's hash are used, to test what collisions do.
    """
    spark = conversations.sparkSession
    mask = -1 if bits == 64 else (1 << bits) - 1
    hashed = lambda w: F.xxhash64(F.lit(w), "role", "text").bitwiseAND(F.lit(mask).cast("long"))
    while True:
        turns = _ordered(conversations, words, hashed)
        grafts = _grafted(turns, words, every, most)
        names = ", ".join(f"{x}{w} long" for w in range(words) for x in "pf")
        taken = grafts.mapInArrow(_taken(words), f"conv long, depth long, {names}, size long, ends boolean")
        cut = "conv long, turns long, lost long, graft long, " + ", ".join(f"{x}{w} long" for x in ("lost", "graft") for w in range(words))
        convs = settled(grafts.mapInArrow(_at_graft(words), cut), "trie-convs")
        own = turns.join(convs, "conv").filter("position >= lost").withColumn("ends", F.col("position") + 1 == F.col("turns"))
        need = ["conv", "position", "lost", "graft", "size", "ends", *(f"{x}{w}" for x in ("v", "before", "lost", "graft") for w in range(words))]
        shape = f"conv long, depth long, {names}, size long, ends boolean"
        texts = own.select(*need, "role", "text").mapInArrow(_rebuilt(words), shape + ", role string, text string").drop("size", "ends")
        # what others take over are first turns of these conversations as they were
        if every > 1 and most > 1:
            lenders = turns.filter((F.col("conv") % every == 0) & (F.col("position") < most - 1)).withColumns({"lost": F.lit(0).cast("long"), "graft": F.lit(0).cast("long"), "ends": F.lit(False)})
            lenders = lenders.withColumns({f"{x}{w}": F.lit(0).cast("long") for x in ("lost", "graft") for w in range(words)})
            texts = texts.unionByName(lenders.select(*need, "role", "text").mapInArrow(_rebuilt(words), shape + ", role string, text string").drop("size", "ends"))
        if verified(texts, words):
            break
        words *= 2
    rows = settled(own.select(*need).mapInArrow(_rebuilt(words), shape).unionByName(taken), "trie-rows")
    return _nodes(rows, convs, words)


def _nodes(rows: DataFrame, convs: DataFrame, words: int) -> DataFrame:
    """Counts, leaves and savings of the nodes. rows: (conv, depth, parent's and own fingerprints, size, ends)."""
    f, p = [f"f{w}" for w in range(words)], [f"p{w}" for w in range(words)]
    key = ["depth", *f]
    nodes = rows.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"), *[F.min(x).alias(x) for x in p])
    nodes = settled(nodes, "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(b).alias(a) for a, b in zip(f, p)]]
    children = settled(nodes.filter("depth > 1").groupBy(*up).agg(F.count("*").alias("n_children")), "trie-children")
    nodes = settled(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    # a childless node's members all end in it; its least one stands for it in all its prefixes
    leaves = nodes.filter("n_children = 0").select(F.col("conv_id").alias("conv"), F.lit(1).alias("leaf"))
    saved = (F.col("n_convs") - 1) * F.col("size")
    shared = nodes.filter("n_convs > 1").select(*key, "conv_id", saved.alias("saves"))
    common = rows.select("conv", *key).join(shared, key)
    common = common.select("conv", F.when(F.col("conv") == F.col("conv_id"), F.col("saves")).otherwise(0).alias("v0"), *key)
    path = scan(common, ["conv", "depth"], ["conv", "depth"], 1, 1, "trie-paths").withColumnRenamed("before0", "above").withColumnRenamed("v0", "saves")
    whole = path.groupBy("conv").agg(F.sum("saves").alias("whole")).join(leaves, "conv", "left").select("conv", "whole", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    whole = settled(whole, "trie-paths")
    below = path.join(whole, "conv").groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.col("whole") - F.col("above")).alias("saved_tokens"))
    ends = rows.filter("ends").select(*key, "conv").unionByName(convs.filter("graft = 0 and turns <= lost").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in f], "conv"))
    sha = ends.repartition(*key).sortWithinPartitions(*key, "conv").mapInArrow(_hashed(words), ", ".join(f"{x} long" for x in key) + ", ends_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    parents = nodes.select(F.col("depth").alias("d"), *[F.col(x).alias(f"up_{x}") for x in f], F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(settled(below, "trie-below"), key, "left").join(sha, key, "left")
    out = out.join(parents, (F.col("depth") == F.col("d") + 1) & (F.col("depth") > 1) & _all(F.col(a) == F.col(f"up_{b}") for a, b in zip(p, f)), "left")
    totals = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    # of a node with one conversation: one leaf, nothing saved
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    sums = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum(saved), F.lit(0)).alias("saved_tokens"))
    ended = sha.filter("depth = 0").select("ends_sha256")
    # three tables of one row at most
    root = totals.crossJoin(sums).join(ended, F.lit(True), "left").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    tops = totals.select(F.col("conv_id").alias("top"))
    out = out.crossJoin(F.broadcast(tops)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("parent_conv_id"))).drop("top")
    return out.unionByName(root)


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
