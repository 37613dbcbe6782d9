"""Quality by Bradley-Terry ranking of documents.

Pairs of a good and a bad training document give a logistic loss on the difference of their features;
the score is linear in them. The cut is the quantile of the training scores that tells good from bad
best; it maps to 0.3. At most SAMPLE labelled rows and PAIRS pairs are fitted. Null texts are empty;
empty texts are scored as any; without both labels every score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .shared import fold
from .textblocks import Block, blocks
from .toxicity import labelled

SAMPLE, PAIRS, CUT = 12_000, 60_000, 0.3


def _featured(batches):
    for batch in batches:
        for part, block in blocks(batch, raw=True):
            rows = [r.tobytes() for r in features.dense(block)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, rate: float = 0.05, decay: float = 1e-3):
    """(mean, scale, weights, cut, slope)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    random = np.random.default_rng(7)
    z = (x - mean) / scale
    d = z[random.choice(good, pairs)] - z[random.choice(bad, pairs)]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        part = d[(t * 4096) % pairs : (t * 4096) % pairs + 4096]
        grad = -(part * (1 / (1 + np.exp(np.clip(part @ w, -30, 30))))[:, None]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    cuts = np.quantile(s, np.linspace(0.002, 0.6, 300))
    told = np.array([((s[good] >= c).mean() + (s[bad] < c).mean()) for c in cuts])
    best = np.flatnonzero(told >= told.max() - 1e-9)
    cut = float((cuts[best[0]] + cuts[best[-1]]) / 2)
    return mean, scale, w, cut, 2.0 / max(float(s.std()), 1e-6)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    t = labelled(docs, labels, "quality", sample, _featured, "doc_id long, label int, x binary").toArrow()
    rows = sorted(zip(t["doc_id"].to_pylist(), t["x"].to_pylist(), t["label"].to_pylist()))
    return fit(np.array([np.frombuffer(r[1]) for r in rows]), np.array([r[2] for r in rows]))


def scores(block: Block, model) -> np.ndarray:
    if model is None:
        return np.full(block.n, 0.5)
    mean, scale, w, cut, slope = model
    raw = (features.dense(block) - mean) / scale @ w
    return 1 / (1 + np.exp(-np.clip((raw - cut) * slope + np.log(CUT / (1 - CUT)), -30, 30)))


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            for part, block in blocks(batch, raw=True):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores(block, model))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), "text")
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def kept(docs: DataFrame, model) -> DataFrame:
    """The rows whose score reaches the cut, with their own columns; no row is moved."""

    def run(batches):
        for batch in batches:
            for part, block in blocks(batch, raw=True):
                yield part.filter(pa.array(scores(block, model) >= CUT))

    return docs.mapInArrow(run, docs.schema)
