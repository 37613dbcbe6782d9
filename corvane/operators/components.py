"""Connected components in logarithmically many rounds, whatever the order of the nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Write = Callable[[DataFrame, str], DataFrame]


def components(links: DataFrame, write: Write) -> DataFrame:
    """(node, label): the least node that links (a, b) reach, of every node with a link to another one.

    Each round hooks nodes to their least neighbour, doubles these pointers until all show their tree's root, and contracts
    the links to roots. A chain takes as many doublings as its length has binary digits; each round leaves at most half the roots
    that still have links. ``write`` puts a round's table where its lineage ends.
    """
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    edges = write(links.select(*pair("a", "b")).filter("a < b").distinct(), "cc-links")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "cc-up")
        while True:
            higher = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = write(up.join(higher, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "cc-step")
            up = step.select("node", "up")
            if step.filter("moved").isEmpty():
                break
        root = up.select("node", F.col("up").alias("label"))
        now = up.select(F.col("node").alias("label"), F.col("up").alias("new"))
        labels = root if labels is None else write(labels.join(now, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "cc-labels")
        for c in "ab":
            edges = edges.join(root.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c)
        edges = write(edges.select(*pair("a_label", "b_label")).filter("a < b").distinct(), "cc-links")
    return edges.select(F.col("a").alias("node"), F.col("a").alias("label")) if labels is None else labels
