"""Document fingerprints by randomised edit embedding.

One random walk, shared by all texts, reads a text's characters: at step j a character of class x is
written and the walk moves on if bit (x, j) says so. Edits become few differences between the written
strings. A fingerprint holds the string at fixed steps, as many in each octave [2^k, 2^(k+1)), so texts
of any length compare; likeness is the weighted share of equal samples. Near fingerprints are searched for
by bands: BANDS sets of BITS sampled places, each hashed, over a fingerprint's last two octaves and over the last
two but one, so lengths on both sides of a power of two meet; what shares a band is verified by likeness. Queries
are the rows whose doc_id is divisible by EVERY, against all rows. Null text is empty, its fingerprint too; two
empty ones are alike (1.0), but are not searched for; repeated rows are next to each other; a single row is next
to itself; a null doc_id is no query and comes last. The search is a query of its own, ``near_fingerprints``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .textblocks import _U, mix

CLASSES, PERIOD, EACH, BLOCK_CHARS = 16, 1 << 16, 16, 12_000_000
#: Bands of a fingerprint, sampled places in each, least likeness of near ones, and which doc_ids are queries.
BANDS, BITS, LEAST, EVERY = 12, 4, 0.8, 100
_move = (mix(np.arange(CLASSES * PERIOD, dtype=np.uint64) + _U(0xABCDEF)) & _U(1)).astype(bool).reshape(CLASSES, PERIOD)
#: STAY[x, j]: steps from j until the walk has left a character of class x.
STAY = np.ones((CLASSES, PERIOD), np.int32)
_run = np.ones(CLASSES, np.int32)
for _j in range(2 * PERIOD - 1, -1, -1):
    _run = np.where(_move[:, _j % PERIOD], 1, np.minimum(_run + 1, 60))
    STAY[:, _j % PERIOD] = _run
_r = np.random.default_rng(5)
#: The sampled steps: all below 16, then EACH in every octave.
STEPS = np.concatenate([np.arange(16), *(np.sort(_r.choice(1 << k, EACH, replace=False)) + (1 << k) for k in range(4, 36))]).astype(np.int64)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: The sampled places of each band among the 2 * EACH of two octaves, later ones (which stand for more steps) rather than earlier.
PLACES = np.stack([np.sort(_r.choice(2 * EACH, BITS, replace=False, p=np.repeat([0.25, 0.75], EACH) / EACH)) for _ in range(BANDS)])


def _octaves(end: int) -> int:
    """How many samples a walk of so many steps has."""
    return 0 if not end else EACH * (1 if end <= 16 else int(end - 1).bit_length() - 3)


def walk(symbols: np.ndarray, at: np.ndarray, count: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks over symbols[at : at + count] that begin at step. (steps at each character, where each walk's lie, its end)."""
    order = np.argsort(-count, kind="stable")
    place, alive = at[order], count[order]
    base = np.zeros(len(count), np.int64)
    base[order] = np.cumsum(alive) - alive
    steps, j, own = np.zeros(int(alive.sum()), np.int64), step[order].astype(np.int64), base[order]
    flat, live = STAY.ravel(), len(alive)
    drops = np.searchsorted(-alive, -np.arange(1, int(alive[0]) + 1 if len(alive) else 1), "right")
    for i, live in enumerate(drops):
        x = symbols[place[:live] + i]
        now = j[:live]
        steps[own[:live] + i] = now
        j[:live] = now + flat[x * PERIOD + (now & (PERIOD - 1))]
    end = np.zeros(len(count), np.int64)
    end[order] = j
    return steps, base, end


def _print(symbols: np.ndarray, steps: np.ndarray, end: int) -> str:
    m = _octaves(end)
    want = STEPS[:m]
    inside = want < end
    got = _HEX[symbols[np.maximum(np.searchsorted(steps, want, "right") - 1, 0)]].copy() if m else np.zeros(0, np.uint8)
    got[~inside] = ord("z")
    return got.tobytes().decode()


def matrix(prints: list[str], width: int) -> np.ndarray:
    """One row of samples for each fingerprint, z beyond its end."""
    return np.frombuffer("".join(x.ljust(width, "z") for x in prints).encode(), np.uint8).reshape(len(prints), width)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair: equal samples, each weighted by the steps it stands for."""
    width = max([EACH, *map(len, a), *map(len, b)])
    x, y = (matrix(s, width).reshape(len(a), -1, EACH) for s in (a, b))
    weight = 2.0 ** np.maximum(np.arange(x.shape[1]) + 3, 4)
    both = (x != ord("z")) | (y != ord("z"))
    total = both.sum(2) @ weight
    return np.where(total > 0, (((x == y) & both).sum(2) @ weight) / np.maximum(total, 1), 1.0)


def likeness(a: str, b: str) -> float:
    return float(likenesses([a], [b])[0])


def _half(rows: list[tuple]) -> list[tuple]:
    """rows: (pid, ghost, doc_id, text), each followed by its next document. Results of those that aren't ghosts."""
    texts = [r[3] for r in rows]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = (mix(codes.astype(np.uint64)) & _U(CLASSES - 1)).astype(np.int64)
    n = np.array([len(t) for t in texts])
    at = np.cumsum(n) - n
    steps, base, end = walk(symbols, at, n, np.zeros(len(n), np.int64))
    own = np.array([i for i in range(len(rows) - 1) if not rows[i][1]], np.int64)
    keep = n[own] - n[own] // 2
    tail = np.minimum(n[own] // 2, n[own + 1])
    begin = np.where(keep < n[own], steps[np.minimum(base[own] + keep, max(len(steps) - 1, 0))] if len(steps) else 0, end[own])
    more, more_base, more_end = walk(symbols, at[own + 1], tail, begin)
    prints: dict[int, str] = {}

    def of(i: int) -> str:
        if i not in prints:
            prints[i] = _print(symbols[at[i] : at[i] + n[i]], steps[base[i] : base[i] + n[i]], int(end[i]))
        return prints[i]

    out = []
    for k, i in enumerate(own.tolist()):
        a, c, e = at[i], int(keep[k]), int(tail[k])
        edited = texts[i][:c] + texts[i + 1][:e]
        sym = np.concatenate([symbols[a : a + c], symbols[at[i + 1] : at[i + 1] + e]])
        st = np.concatenate([steps[base[i] : base[i] + c], more[more_base[k] : more_base[k] + e]])
        theirs = _print(sym, st, int(more_end[k]))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((rows[i][2], int(n[i]), sha, of(i), theirs, likeness(of(i), theirs), likeness(of(i), of(i + 1))))
        prints.pop(i - 1, None)
    return out


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chained(batches):
    held, chars = [], 0

    def out(rows):
        columns = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def runs(rows):
        """Rows of one pid each, so that the last isn't followed by another pid's."""
        s = 0
        for e in range(1, len(rows) + 1):
            if e == len(rows) or rows[e][0] != rows[s][0]:
                if e - s > 1 and (done := _half(rows[s:e])):
                    yield out(done)
                s = e

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            held.append(row)
            chars += len(row[3])
            if chars > BLOCK_CHARS:
                yield from runs(held)
                held, chars = held[-1:], len(row[3])
    yield from runs(held)


def _own(batches):
    """Fingerprints of texts alone, in slices of about BLOCK_CHARS."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        n = np.array([len(t) for t in texts], np.int64)
        block = np.cumsum(n) // BLOCK_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        for s, e in zip(cuts, cuts[1:]):
            codes = np.frombuffer("".join(texts[s:e]).encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = (mix(codes.astype(np.uint64)) & _U(CLASSES - 1)).astype(np.int64)
            count = n[s:e]
            at = np.cumsum(count) - count
            steps, base, end = walk(symbols, at, count, np.zeros(e - s, np.int64))
            made = [_print(symbols[a : a + c], steps[b : b + c], int(z)) for a, b, c, z in zip(at, base, count, end)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row, where it lies: no text is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_own, "doc_id long, fingerprint string")


def _rank(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below x: first which run of them, then how many of that run."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda c: F.array(*[F.lit(v).cast("long") for v in c])
    below = lambda c: F.size(F.filter(c, lambda v: v < x))
    run = below(literal(cuts[step - 1 :: step]))
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)] + [[]]
    return run * step + below(F.element_at(F.array(*[literal(r) if r else literal([2**63 - 1]) for r in runs]), run + 1))


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of it with its end replaced by the next document's beginning.

    Documents are dealt by ranges of doc_id, and those of one doc_id or without one, if they fill several ranges, by ranges of a hash
    of their text; a range's first row is sent to the range before as well.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("o", F.coalesce("doc_id", F.lit(-(2**63))))
    cuts = sorted(rows.agg(F.percentile_approx("o", [k / parts for k in range(1, parts)], max(20_000, 10 * parts))).first()[0] or [])
    # a doc_id that is a cut several times has as many ranges of its own; they come in the order of the hash, the last one first
    rows = rows.withColumn("h", F.xxhash64("text"))
    of_text = F.shiftrightunsigned("h", 1).cast("double") / 2.0**63
    many = sorted((c, n) for c, n in Counter(cuts).items() if n > 1)
    within = reduce(lambda x, cn: F.when(F.col("o") == cn[0], cn[1] - 1 - F.least(F.floor(of_text * cn[1]), F.lit(cn[1] - 1))).otherwise(x), many, F.lit(0))
    rows = rows.withColumn("pid", (_rank(F.col("o"), cuts) + within).cast("int")).withColumn("back", -F.shiftrightunsigned("h", 1))
    heads = sorted((r.pid, r.head.o, r.head.back) for r in rows.groupBy("pid").agg(F.max(F.struct("o", "back")).alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    # a row for each range: the range before it in the order of documents, which is the next by number
    first = [(o, back, heads[k + 1][0] if k + 1 < len(heads) else heads[0][0]) for k, (_, o, back) in enumerate(heads)]
    also = F.broadcast(spark.createDataFrame(first, "o long, back long, also int"))
    own = F.struct(F.col("pid").alias("pid"), F.lit(False).alias("ghost"))
    places = F.when(F.col("also").isNotNull(), F.array(own, F.struct(F.col("also").alias("pid"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    dealt = rows.join(also, ["o", "back"], "left").withColumn("place", F.explode(places)).select("place.pid", "place.ghost", "doc_id", "text", "o", "back")
    dealt = dealt.repartition(parts, "pid").sortWithinPartitions("pid", "ghost", F.desc("o"), F.desc("back"))
    return dealt.select("pid", "ghost", "doc_id", "text").mapInArrow(_chained, SCHEMA)


def bands(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, fingerprint) of the bands of each: over its last two octaves and over the two before the last."""
    keys, whose = [], []
    size = np.array([len(x) // EACH for x in prints])
    for back in (0, 1):
        use = np.flatnonzero(size > back)
        if not len(use):
            continue
        top = size[use] - back  # octaves read: the last is this one
        text = matrix([("y" * EACH + prints[i])[(t - 1) * EACH : (t + 1) * EACH] for i, t in zip(use, top)], 2 * EACH).astype(np.uint64)
        for b, places in enumerate(PLACES):
            key = mix(np.uint64(b + 1) + top.astype(np.uint64) * _U(1 << 20))
            for p in places:
                key = mix(key * _U(0x9FB21C651E98DF25) + text[:, p])
            keys.append(key)
            whose.append(use)
    return (np.concatenate(keys), np.concatenate(whose)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _banded(batches):
    for batch in batches:
        key, whose = bands(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), pa.array(key.view(np.int64))], names=["doc_id", "band"])


def _alike(least):
    def run(batches):
        for batch in batches:
            near = likenesses(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["query", "doc_id", "likeness"]).filter(pa.array(near >= least))

    return run


def near_queries(prints: DataFrame, every: int = EVERY, least: float = LEAST) -> DataFrame:
    """(query, doc_id, likeness) of all rows that share a band with a query and are as near; prints: doc_id, fingerprint, kept in a table.

    Fingerprints of repeated doc_ids are each searched. Only ids and hashes meet by bands, then the found pairs fetch their fingerprints.
    """
    rows = prints.filter("doc_id is not null and fingerprint <> ''").select("doc_id", "fingerprint").distinct()
    of = lambda x: x.mapInArrow(_banded, "doc_id long, band long").distinct()
    queries = rows.filter(F.col("doc_id") % every == 0)
    pairs = of(queries).withColumnRenamed("doc_id", "query").join(of(rows), "band").filter("query <> doc_id").select("query", "doc_id").distinct()
    left = queries.select(F.col("doc_id").alias("query"), F.col("fingerprint").alias("x"))
    both = pairs.join(left, "query").join(rows.withColumnRenamed("fingerprint", "y"), "doc_id").select("query", "doc_id", "x", "y")
    return both.mapInArrow(_alike(least), "query long, doc_id long, likeness double").groupBy("query", "doc_id").agg(F.max("likeness").alias("likeness"))


def searched(docs: DataFrame) -> DataFrame:
    """with_edits and of each row the nearest query (near_id, the least of equal ones; null without one), its likeness, and how many queries are near."""
    prints = settled(with_edits(docs), "edit-prints")
    near = near_queries(prints).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.struct("likeness", (-F.col("query")).alias("q"))).alias("best"), F.count("*").alias("near_queries"))
    out = prints.join(near, prints.doc_id == near._id, "left")
    return out.select(*prints.columns, (-F.col("best.q")).alias("near_id"), F.col("best.likeness").alias("near_likeness"), F.coalesce("near_queries", F.lit(0)).cast("long").alias("near_queries"))
