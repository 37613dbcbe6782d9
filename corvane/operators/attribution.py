"""What each term of the additive score adds to a pair's score, as the console shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms() -> Column:
    """An array of (place, feature, contribution, direction, strength, bar_pct) of each term that counts, in the order of places. bar_pct: hundreds of the size, cut to a whole number."""
    same = lambda c: F.col(f"{c}_a") == F.col(f"{c}_b")
    name = F.lit(0.30) * F.col("name_sim")
    # What the terms are called and what they add.
    every = [("PAN Token Match", same("pan_token"), 0.55), ("PAN Token Conflict", ~same("pan_token"), -0.40), ("GSTIN Match", same("gstin_token"), 0.15), ("Name Similarity", F.lit(True), name)]
    every += [(f"{c.title()} Match", same(c), 0.05) for c in ("district", "pincode", "phone")] + [("Legal Status Match", same("legal"), 0.05), ("Legal Status Conflict", ~same("legal"), -0.10)]
    parts = []
    for i, (n, ok, v) in enumerate(every):
        size = (v if isinstance(v, Column) else F.lit(v)).cast("double")
        positive = (size > 0) | F.lit(n == "Name Similarity")
        parts.append(F.when(ok, F.struct(
            F.lit(i).alias("place"), F.lit(n).alias("feature"), F.round(size, 3).alias("contribution"), F.when(positive, "positive").otherwise("negative").alias("direction"), strength(F.abs(size)).alias("strength"),
            F.abs(size * 100).cast("int").alias("bar_pct"),
        )))
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def additive(ev: DataFrame) -> DataFrame:
    """(a, b) and a row for each of ``terms``."""
    return ev.select("a", "b", F.explode(terms()).alias("p")).select("a", "b", "p.*")


def strength(size: Column) -> Column:
    return F.when(size > 0.15, "strong").when(size > 0.05, "moderate").otherwise("weak")
