"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws u from a hash of its doc_id, its text, its number among its repeats and a seed; its key -ln(u) / quality weight orders
its source. A source's budget takes whole epochs first, then documents in key order up to the rest. Prefix
sums run within buckets of keys, whose totals are summed before, so that no source meets in one task. Sources
are ranked within ranges of their names; their table is broadcast up to FEW_SOURCES, joined by a shuffle beyond.
Null text has size 0; a null source comes last; a null doc_id draws as -1; rows that repeat draw each
on their own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, one_each, settled, told_apart, unused

ROWS_A_BUCKET, FEW_SOURCES = 2000, 50_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """0.05 to 1: how far a text's letters, words and marks are those of prose, the product of four shares.

    Letters and digits beside all characters that aren't blanks; words of a usual length; no runs of one mark;
    not the same long words again and again.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = lambda x: F.length(x).cast("double")
    blanks = n(t) - n(F.translate(t, " \t\n\r", ""))
    marks = n(t) - n(F.translate(t, "|#%&$*!<>{}[]_=+~^\\/@", ""))
    solid = F.greatest(n(t) - blanks, F.lit(1.0))
    prose = F.greatest(F.lit(0.0), 1 - 4 * marks / solid)
    length = solid / (blanks + 1)  # mean length of a word
    usual = F.least(F.lit(1.0), length / 3, 12 / length)
    upper = (n(t) - n(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / solid
    calm = F.least(F.lit(1.0), 1.3 - upper)
    digits = (n(t) - n(F.translate(t, "0123456789", ""))) / solid
    return F.greatest(F.lit(0.05), prose * usual * calm * (1 - F.least(F.lit(0.9), digits)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, source_rows, target. Sources are ranked by ranges of their names, then within each."""
    spark = sizes.sparkSession
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # null comes last, so ranges are of (is null, source)
    s = settled(s.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("range", F.spark_partition_id()), "mix-sources")
    before, ranges = 0, []
    for r in sorted(s.groupBy("range").count().collect()):
        ranges.append((r["range"], before))
        before += r["count"]
    s = s.join(F.broadcast(spark.createDataFrame(ranges, "range int, before long")), "range")  # a row for each partition of one shuffle
    rank = F.row_number().over(Window.partitionBy("range").orderBy("none", "source")) - 1 + F.col("before")
    s = settled(s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))), "mix-weights")
    limit = most * F.col("source_size")
    budget = share * float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # each round fixes the sources above their limit and shares the rest anew
        over = (level * F.col("w")) > limit
        rest, fixed, n = s.agg(F.sum(F.when(~over, F.col("w"))), F.sum(F.when(over, limit)), F.count_if(over)).first()
        if n == capped or not rest:
            break
        level, capped = (budget - (fixed or 0.0)) / rest, n
    targets = s.select("source", "source_size", "source_rows", F.least(level * F.col("w"), limit).cast("double").alias("target"))
    return F.broadcast(targets) if before <= FEW_SOURCES else targets


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, quality: Column | None = None) -> DataFrame:
    """doc_id, t (the text's hash), source, size, source_size, target, taken, copies of each document. quality: its weight, above 0."""
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", t.alias("t"), "source", n_words().alias("size"), (quality_weight() if quality is None else quality).alias("quality"), F.spark_partition_id().alias("pid"))
    rows = told_apart(settled(rows, "mix-rows"), ["doc_id", "t", "source"], "number").drop("pid")
    draw = lambda *of: (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "t", F.lit(seed), *of), F.lit(2**52)) + 0.5) / float(2**52)
    u = F.when(F.col("number") == 0, draw()).otherwise(draw(F.col("number")))
    rows = settled(rows.withColumn("es_key", -F.log(u) / F.col("quality")).drop("number"), "mix-keys")
    targets = source_targets(rows, weights, share, most).withColumnRenamed("source", "s")
    # -ln(u)/w lies in [0, inf); this rising map of it to [0, 1) deals a source's rows out over its buckets
    n = F.ceil(F.col("source_rows") / ROWS_A_BUCKET)
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("bucket", F.floor((1 - F.exp(-F.col("es_key"))) * n).cast("long"))
    key = [F.coalesce("source", F.lit("")), F.col("source").isNull(), "bucket"]
    order = [F.col("es_key"), F.col("doc_id"), F.col("t")]
    before = (
        placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        .withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("within", within)
    ranked = ranked.join(before, ranked.source.eqNullSafe(before.s) & (ranked.bucket == before.b))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    more = (F.col("before") + F.col("within") + F.col("size") / 2 <= rest) & (F.col("size") > 0)
    copies = F.least(epochs + more.cast("long"), F.lit(int(most))).cast("long")
    return ranked.select("doc_id", "t", "source", "size", "source_size", F.round("target", 6).alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Every document as often as the mix takes it, with its own columns; those it takes no time are gone.

    Rows that repeat in doc_id and text share their copies. Null texts have no words, so none is taken.
    """
    i, t, n, often, hashed, k = unused(docs.columns, "_mix_id", "_mix_t", "_mix_n", "_mix_rows", "_mix_hash", "_mix_k")
    copies = mix(docs, **how).groupBy(F.col("doc_id").alias(i), F.col("t").alias(t)).agg(F.sum("copies").alias(n), F.count("*").alias(often)).filter(F.col(n) > 0)
    copies = settled(copies, "mix-copies")
    if not copies.filter(F.col(often) > 1).isEmpty():
        docs = one_each(docs, copies.select(F.col(i).alias("doc_id"), F.col(t).alias("t")))
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit(""))))
    taken = rows.join(copies, (F.col(hashed) == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(i)))
    return taken.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
