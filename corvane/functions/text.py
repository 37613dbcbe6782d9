"""String similarity: built-ins where Spark has them, Arrow-batched functions for Jaro-Winkler and Metaphone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP = ("PVT", "LTD", "PRIVATE", "LIMITED", "AND", "&", "THE")


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """The usual measure of each pair, all pairs at once; the common front counts from a Jaro value above 0.7 on. Two empty texts are equal."""
    n = len(a)
    la, lb = np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64)
    x, y = _matrix(a, la, 0), _matrix(b, lb, 1)  # pads are no characters of the other side
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    rows, at = np.arange(n), np.arange(y.shape[1])
    used, mine = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        ok = (y == x[:, i : i + 1]) & ~used & (np.abs(at - i) <= reach) & (i < la)[:, None]
        j = ok.argmax(1)
        hit = ok[rows, j]
        used[rows[hit], j[hit]] = True
        mine[:, i] = hit
    m = mine.sum(1)
    width = max(int(m.max(initial=0)), 1)
    front = lambda z, ok: np.take_along_axis(z, np.argsort(~ok, 1, kind="stable")[:, :width], 1)
    u, v = front(x, mine), front(y, used)
    least = min(u.shape[1], v.shape[1])
    swaps = ((u[:, :least] != v[:, :least]) & (np.arange(least) < m[:, None])).sum(1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / some) / 3, 0.0)
    least = min(4, x.shape[1], y.shape[1])
    prefix = np.cumprod(x[:, :least] == y[:, :least], 1).sum(1)
    out = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    return np.where((la == 0) & (lb == 0), 1.0, out)


def _matrix(texts: list[str], length: np.ndarray, pad: int) -> np.ndarray:
    width = max(int(length.max(initial=0)), 1)
    out = np.full((len(texts), width), 0x110000 + pad, np.uint32)
    out[np.arange(width) < length[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _of_distinct(measure):
    """The measure of two string columns, worked out once for each distinct pair of a batch; null where either is null."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        (x, left), (y, right) = pd.factorize(a), pd.factorize(b)
        ok, out = (x >= 0) & (y >= 0), np.full(len(a), np.nan)
        if ok.any():
            pairs, where = np.unique(x[ok].astype(np.int64) * len(right) + y[ok], return_inverse=True)
            out[ok] = measure(left[pairs // len(right)].tolist(), right[pairs % len(right)].tolist())[where]
        return pd.Series(out)

    return of


def _equal_places(a: list[str], b: list[str]) -> np.ndarray:
    la, lb = np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64)
    x, y = _matrix(a, la, 0), _matrix(b, lb, 1)
    n = min(x.shape[1], y.shape[1])
    return (x[:, :n] == y[:, :n]).sum(1).astype(float)


def equal_places(a: Column, b: Column) -> Column:
    """How many characters are equal at equal places."""
    return F.pandas_udf(_of_distinct(_equal_places), "double")(a, b)


def code_points(x: Column) -> Column:
    """A text's code points in order; 0 for an empty text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.ascii(F.substring(x, i, F.lit(1))))


def jw(a: Column, b: Column) -> Column:
    return F.pandas_udf(_of_distinct(jaro_winkler), "double")(a, b)


def levenshtein_sim(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n).otherwise(0.0)


def content_words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.upper(F.trim(x)), r"\s+"), lambda w: ~w.isin(*STOP) & (w != "")))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def plain(x: Column) -> Column:
    """Upper-cased, without white space around; empty where missing."""
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))


def phone_digits(x: Column) -> Column:
    """The last ten characters without blanks, dashes and plus signs; empty where there are fewer."""
    last = F.right(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\-+]", ""), F.lit(10))
    return F.when(F.length(last) == 10, last).otherwise("")


def exact(a: Column, b: Column) -> Column:
    """1 where values that ``plain`` or another norm gives are equal and not empty."""
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), dot(a, b) / norm)).otherwise(0.0)


def address(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])


def email(x: Column) -> Column:
    return F.lower(F.trim(x))


def trimmed(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def similar(a: Column, b: Column) -> Column:
    """Jaro-Winkler of texts that are upper-cased and trimmed; 0 where one is empty."""
    return F.when((a != "") & (b != ""), jw(a, b)).otherwise(0.0)


def with_similar(df: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """df with ``similar`` of two of its columns for each name in ``of``, without these columns.

    Whole rows pass in Arrow batches: those that wait for a Python function's values are queued, on disk where memory is short.
    """
    keep = [f for f in df.schema if f.name not in {c for pair in of.values() for c in pair}]

    def one(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, left), (y, right) = ((d.indices.to_numpy(), d.dictionary.to_pylist()) for d in (c.dictionary_encode() for c in (a, b)))
        pairs, where = np.unique(x.astype(np.int64) * len(right) + y, return_inverse=True)
        left, right = [left[i] for i in pairs // len(right)], [right[i] for i in pairs % len(right)]
        both = np.array([*map(bool, left)]) & np.array([*map(bool, right)])
        return pa.array(np.where(both, jaro_winkler(left, right), 0.0)[where])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = {f.name: batch[f.name] for f in keep} | {n: one(batch[a].fill_null(""), batch[b].fill_null("")) for n, (a, b) in of.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, T.StructType([*keep, *[T.StructField(n, T.DoubleType()) for n in of]]))


class Encoder(NamedTuple):
    """encode: distinct texts to arrays, one for each, in a batch; kind: their SQL type; likeness: of two such arrays; light: what makes the same
    of a column by built-ins, where that is quicker than to move vectors."""

    encode: Callable[[list[str]], list]
    kind: str
    likeness: Callable[[Column, Column], Column]
    light: Callable[[Column], Column] | None = None


def _trigrams(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        c = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out.append(np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if t else c[:0])
    return out


def _light_trigrams(x: Column) -> Column:
    code = lambda i: F.ascii(F.substring(F.concat(F.lit(" "), x, F.lit(" ")), i, F.lit(1))).cast("bigint")
    one = lambda i: F.shiftleft(code(i), 42).bitwiseOR(F.shiftleft(code(i + 1), 21)).bitwiseOR(code(i + 2))
    return F.when(x != "", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), one))).otherwise(F.array().cast("array<bigint>"))


def _set_cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.sqrt(F.size(a) * F.size(b).cast("double")), F.lit(0.0)), F.lit(0.0))


#: Distinct character trigrams, a blank before and after each text: what stands for a sentence encoder where none is given.
TRIGRAMS = Encoder(_trigrams, "array<bigint>", _set_cosine, _light_trigrams)


def dense(model: Callable[[list[str]], np.ndarray]) -> Encoder:
    """An encoder of any model that turns texts into rows of a matrix."""
    return Encoder(lambda texts: list(np.asarray(model(texts), float)), "array<double>", cosine)


def encoded(texts: DataFrame, encoder: Encoder = TRIGRAMS) -> DataFrame:
    """(text, vector): each distinct text of the column ``text`` is encoded once, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=[list(v) for v in encoder.encode(batch["text"].tolist())])

    return texts.select("text").filter("text is not null").distinct().mapInPandas(run, f"text string, vector {encoder.kind}")
