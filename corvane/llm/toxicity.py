"""Toxicity by non-negative positive-unlabelled learning on hashed words, trained with NumPy.

Confirmed toxic rows are the positives; all rows of the training folds, whatever their labels, are drawn
from as unlabelled. The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under logistic loss, by
full-batch Adam. The prior is the least ratio of the unlabelled rows' share above a score to the positives',
each half scored by fits to the other. At most SAMPLE positives and as many other rows are fitted, which hashes of 63 bits choose at any
number of rows and repeats. Null and empty texts get the score of a text without features; with
no positives every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from .shared import fold, settled
from .textblocks import _U, blocks, mix

SAMPLE = 12_000
#: The priors under which the scores are fitted that the prior is read from.
GUESSES = (0.5, 0.25, 0.1, 0.04, 0.015)


WIDE = 1 << 63
#: How many features of rows are worked on at once.
CHUNK = 1 << 20


def bounded(share: float) -> int:
    """The hashes of 63 bits that lie below it are this share of all, at any number of rows."""
    return min(WIDE - 1, int(WIDE * min(1.0, share)))


def _hash(*columns) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def least(rows: DataFrame, sample: int) -> DataFrame:
    """At most so many of a written table's rows, those whose doc_id and features hash least, however often a doc_id repeats."""
    return rows.orderBy(_hash("doc_id", "x"), "x").limit(sample)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, work, schema: str) -> DataFrame:
    """Features (doc_id, label, x) of the training folds' labelled rows, at most ``sample`` of them by hashes. work, schema: from doc_id, label, text."""
    own = labels.filter((fold() != 0) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.filter(_hash("doc_id") < bounded(sample / max(own.count(), 1)))
    # the labels that are broadcast are some ``sample`` doc_ids
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    return least(settled(rows.mapInArrow(work, schema), "labelled"), sample)


def drawn(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Features (doc_id, label, x) of the training folds: at most ``sample`` confirmed positives (label 1) and as many of all rows (2), both (3), by hashes."""
    own = labels.filter((fold() != 0) & (F.col("toxic") == 1)).select("doc_id").distinct()
    own = own.filter(_hash("doc_id") < bounded(sample / max(own.count(), 1))).withColumn("positive", F.lit(True))
    docs = docs.select("doc_id", "text").filter(fold() != 0)
    any_label = _hash("doc_id", F.lit("unlabelled")) < bounded(sample / max(docs.count(), 1))
    rows = docs.withColumn("unlabelled", any_label).join(F.broadcast(own), "doc_id", "left")
    label = F.coalesce("positive", F.lit(False)).cast("int") + 2 * F.col("unlabelled").cast("int")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"), "text").filter("label > 0")
    rows = settled(rows.mapInArrow(_featured, "doc_id long, label int, x binary"), "drawn")
    return least(rows.filter("label % 2 = 1"), sample).unionByName(least(rows.filter("label = 2"), sample))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in blocks(batch):
            ptr, bucket = features.sparse(block)
            rows = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(ptr, ptr[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])


class Rows(NamedTuple):
    """The buckets of rows one after another: row and bucket of each, and what each row is."""

    row: np.ndarray
    bucket: np.ndarray
    positive: np.ndarray
    unlabelled: np.ndarray

    def part(self, use: np.ndarray) -> Rows:
        new, own = (np.cumsum(use) - 1).astype(np.int32), use[self.row]
        return Rows(new[self.row[own]], self.bucket[own], self.positive[use], self.unlabelled[use])

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """row and bucket in runs of CHUNK, so that what is worked out of them never lies in memory as a whole."""
        for at in range(0, len(self.row), CHUNK):
            yield self.row[at : at + CHUNK], self.bucket[at : at + CHUNK]

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How many of the chosen rows have each bucket; a row has a bucket once."""
        out = np.zeros(features.BUCKETS, np.int64)
        for row, bucket in self.chunks():
            out += np.bincount(bucket[of[row]], minlength=features.BUCKETS)
        return out

    def of_columns(self, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of those whose bucket has a column (not -1)."""
        found = [(row[own], at[own]) for row, bucket in self.chunks() for at in (column[bucket],) for own in (at >= 0,)]
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0)]).astype(np.intp) for i in (0, 1))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.positive))
        for row, bucket in self.chunks():
            out += np.bincount(row, weights[bucket], len(out))
        return out


def gathered(x: list, positive: np.ndarray, unlabelled: np.ndarray) -> Rows:
    length = np.array([len(v) for v in x], np.int64)
    flat = np.empty(int(length.sum()), np.int32)
    for v, end in zip(x, np.cumsum(length)):
        flat[end - len(v) : end] = v
    return Rows(np.repeat(np.arange(len(x), dtype=np.int32), length), flat, np.asarray(positive, bool), np.asarray(unlabelled, bool))


def fit(rows: Rows, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias. Kept buckets are those clearly more frequent in the positives than in the unlabelled."""
    n, n_p, n_u = len(rows.positive), int(rows.positive.sum()), int(rows.unlabelled.sum())
    weights = np.zeros(features.BUCKETS, np.float32)
    if not n_p or not n_u:
        return weights, 20.0 if n_p else -20.0
    dp, df = rows.counts(rows.positive), rows.counts(rows.unlabelled)
    lift = ((dp + 0.5) / n_p) / ((df + 0.5) / n_u)
    used = np.flatnonzero((dp >= max(4, 0.004 * n_p)) & (lift > 1 + 0.5 * (1 / prior - 1)))
    if not len(used):
        return weights, float(np.log(prior / (1 - prior)))
    at = np.full(features.BUCKETS, -1, np.int32)
    at[used] = np.arange(len(used))
    row, col = rows.of_columns(at)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = np.log(prior / (1 - prior))
    of_p, of_u = prior * rows.positive / n_p, rows.unlabelled / n_u
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + w[-1]
        p = 1 / (1 + np.exp(-z))
        negative_risk = (of_u - of_p) @ np.logaddexp(0, z)
        g_minus = p * (of_u - of_p)
        g = g_minus - (1 - p) * of_p if negative_risk >= 0 else -g_minus
        grad = np.append(np.bincount(col, g[row], len(used)), g.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def class_prior(rows: Rows, half: np.ndarray) -> float:
    """The positives' share of the unlabelled rows: any score bounds it from above, so the least of several scores' bounds."""
    n_p, n_u = int(rows.positive.sum()), int(rows.unlabelled.sum())
    if not n_p or not n_u:
        return 0.5
    # a tail of few rows is no witness: a bound on both shares' errors is added before the least is sought
    slack, found = np.sqrt(np.log(40) / 2) * (n_p**-0.5 + n_u**-0.5), []
    for guess in GUESSES:
        z = np.zeros(len(half))
        for side in (False, True):
            weights, _ = fit(rows.part(half == side), guess, steps=100)
            other = half != side
            z[other] = rows.sums(weights)[other]
        p, u = np.sort(z[rows.positive]), np.sort(z[rows.unlabelled])
        above_p = 1 - np.searchsorted(p, p, "left") / n_p
        above_u = 1 - np.searchsorted(u, p, "left") / n_u
        best = np.argmin((above_u + slack) / above_p)
        found.append(((above_u[best] + slack) / above_p[best], above_u[best] / above_p[best]))
    return float(np.clip(min(found)[1], 1 / n_u, 0.95))


class Late:
    """Bytes that are copied when they are compared, that is for rows which are equal up to there."""

    def __init__(self, buffer: pa.Buffer):
        self.buffer = buffer

    def __lt__(self, other: Late) -> bool:
        return self.buffer.to_pybytes() < other.buffer.to_pybytes()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Late) and self.buffer.equals(other.buffer)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    t = drawn(docs, labels, sample).toArrow()
    ids, label = t["doc_id"].to_numpy(), t["label"].to_numpy()
    x = [v.as_buffer() for chunk in t["x"].chunks for v in chunk]  # views of the table
    order = sorted(range(len(x)), key=lambda i: (ids[i], label[i], Late(x[i])))
    ids, label = ids[order].astype(np.int64), label[order]
    all_rows = gathered([np.frombuffer(x[i], np.int32) for i in order], label % 2 == 1, label >= 2)
    del t, x
    # halves by doc_id, so that a repeated row isn't on both sides
    half = (mix(ids.view(np.uint64)) & _U(1)) == 1
    return fit(all_rows, class_prior(all_rows, half))


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            for part, block in blocks(batch):
                ptr, bucket = features.sparse(block)
                total = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
                z = np.clip(total[ptr[1:]] - total[ptr[:-1]] + bias, -30, 30)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), "text")
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
