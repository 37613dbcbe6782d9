"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the doc_id and of the row's number among its repeats). Exact bytes below candidate keys are counted over
all partitions; each round splits the intervals that hold a wanted boundary until a probe lies within TOLERANCE
of a shard's bytes from it. A boundary that falls deeper into one group of equal texts is refined likewise by
that second key, so a group, were it one row repeated or all without doc_ids, of any size is cut where its bytes ask for it. Then rows are exchanged once.
Null text has size 16; rows that repeat stay; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled, told_apart

BITS, STEP = 60, 12
#: Of the second key, the bits of the row's number among rows of one text and doc_id.
ROW_BITS = 20
TOLERANCE = 0.001
ROWS_A_BUCKET = 4000


def _key(column: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - BITS)


def _second(doc_id: Column, number: Column) -> Column:
    """By the doc_id first, so that only rows of one text and one doc_id, which are alike, are in the order of their numbers."""
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(doc_id), 64 - BITS + ROW_BITS), ROW_BITS)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(number), 64 - ROW_BITS))


def splitters(keyed: DataFrame, wanted: list[tuple[int, float]], tolerance: float) -> list[tuple[int, float, int]]:
    """For each wanted (group, sum of bytes): (key, bytes still wanted of the rows with that key, all their bytes); 0 are wanted where the splitter meets the tolerance.

    keyed: grp, key (0 to 2^BITS-1), bytes. Each round counts the exact bytes of at most 2^STEP intervals
    for each boundary that is still open; all of these share a round.
    """
    at = [(0, 0, 0)] * len(wanted)
    found: list[tuple[int, float, int] | None] = [None] * len(wanted)
    shift = BITS
    while shift and None in found:
        wide, shift = shift, max(0, shift - STEP)
        here = keyed.withColumn("i", F.shiftright("key", shift))
        if wide < BITS:
            spans = keyed.sparkSession.createDataFrame(sorted({(g, k >> wide) for (g, _), (k, *_), f in zip(wanted, at, found) if f is None}), "grp long, span long")
            here = here.withColumn("span", F.shiftright("key", wide)).join(F.broadcast(spans), ["grp", "span"], "left_semi")
        counted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in here.groupBy("grp", "i").agg(F.sum("bytes").alias("b")).collect():
            counted.setdefault((r.grp, (r.i << shift) >> wide), []).append((r.i, r.b))
        for n, ((grp, goal), (key, below, _)) in enumerate(zip(wanted, at)):
            if found[n]:
                continue
            own = sorted(counted[grp, key >> wide])
            for i, b in own:
                if below + b > goal or (i, b) == own[-1]:
                    at[n] = (i << shift, below, b)
                    if goal - below <= tolerance:
                        found[n] = (i << shift, 0.0, b)
                    elif abs(below + b - goal) <= tolerance:
                        found[n] = ((i + 1) << shift, 0.0, b)
                    break
                below += b
    return [f or (key, goal - below, b) for f, (key, below, b), (_, goal) in zip(found, at, wanted)]


def _rank(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts are at most the key; there are fewer cuts than shards."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= key)) if cuts else F.lit(0)


def shards(docs: DataFrame, n: int = 40, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), _key(text).alias("key"), F.spark_partition_id().alias("pid"),
    )
    rows = told_apart(settled(rows, "shard-keys"), ["key", "doc_id"], "number")
    rows = settled(rows.withColumn("second", _second(F.coalesce("doc_id", F.lit(-1)), F.col("number"))).drop("pid", "number"), "shard-keys")
    groups = settled(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    wanted = [(0, total * k / n) for k in range(1, n)]
    tolerance = tolerance * total / n
    whole, cut = [], {}
    for key, goal, _ in splitters(groups.withColumn("grp", F.lit(0).cast("long")), wanted, tolerance) if total else []:
        if goal:
            cut.setdefault(key, []).append(goal)
        else:
            whole.append(key)
    goals = [(key, goal) for key, own in cut.items() for goal in own]
    inner = rows.filter(F.col("key").isin(list(cut))).select(F.col("key").alias("grp"), F.col("second").alias("key"), F.col("size").alias("bytes"))
    second: dict[int, list[int]] = {}
    for (key, goal), (k, left, b) in zip(goals, splitters(inner, goals, tolerance)):
        # rows of one number's hash aren't told apart: the nearer side of them
        second.setdefault(key, []).append(k + int(left >= b / 2 and left > 0))
    shard = _rank(F.col("key"), sorted([*whole, *[key + 1 for key, cuts in second.items() for _ in cuts]]))
    for key, cuts in second.items():
        shard = shard + F.when(F.col("key") == key, _rank(F.col("second"), cuts)).otherwise(0)
    # slots follow (key range, salt); a key range has some ROWS_A_BUCKET rows and a large group is salted by doc_id
    count = int(groups.agg(F.sum("n")).first()[0] or 0)
    parts = max(1, count // (n * ROWS_A_BUCKET) + 1)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64("key", "second"), F.lit(parts)))
    before = (
        dealt.groupBy("shard", "part").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "part", F.coalesce("before", F.lit(0)).alias("before"))
    )
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "second", "doc_id")) - 1
    return dealt.withColumn("within", slot).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
