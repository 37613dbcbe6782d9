"""Katz backoff language model over words, and the log10 probability of every text.

P(w | h) is the Good-Turing discounted estimate where the n-gram (h, w) was seen in the training texts,
else alpha(h) P(w | h without its first word), down to the discounted unigrams, whose left mass goes to
unseen words as one event; alpha(h) is exactly the mass that h's seen words leave. N-grams of three words
or more count as seen from LEAST occurrences on, at every input size; what rarer ones had goes to alpha.
A text begins after end tokens and its end is a token. Null text is empty: one end token. Repeated rows
count and are scored each; a null doc_id belongs to the fold of the empty text; no rows give no rows.

Texts become blocks of hashed words, written once. For each order every block asks the buckets of n-grams,
then the buckets of contexts, about its distinct ones; a bucket adds up what all blocks sent and answers in
the order it was asked. A bucket takes TOKENS_A_BUCKET tokens' n-grams at most, so buckets grow with the input.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, fold, settled
from .textblocks import _U, blocks, give_back, mix, owners

ORDER, LEAST, GT_MAX, TOKENS_A_BUCKET = 3, 2, 5, 3_000_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
END = np.uint64(0x1F2E3D4C5B6A7988)
#: What a part of a block holds: its own arrays, then 10 k + COUNT, RATE or ALPHA of order k as the buckets answered.
WORDS, OFTEN, CODES, IDS, NULL, HELD, LENGTHS = range(7)
KINDS = {WORDS: "u8", OFTEN: "i8", CODES: "u4", IDS: "i8", NULL: "u1", HELD: "u1", LENGTHS: "i8"}
COUNT, RATE, ALPHA = range(3)
ANSWERS = {COUNT: "i8", RATE: "f8", ALPHA: "f8"}
#: Discounts and masses are whole multiples of these, so their sums are exact in any order.
PART_OF_DISCOUNT, PART_OF_MASS = 2.0**-12, 2.0**-45
PART = "block long, kind int, bucket int, data binary"
ASKED = "bucket int, block long, keys binary, counts binary, kept binary, mass binary, need binary, single long"


def packed(x: np.ndarray) -> bytes:
    """Compressed, byte by byte of all numbers, so that their empty upper bytes vanish."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b[4:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them."""
    return packed(np.diff(keys, prepend=_U(0)))


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, "u8"), dtype=np.uint64)


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, where each value lies among them)."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(x)]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


def _tokens(block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, ptr) of each text's words and its end."""
    words, _, _, ptr = block.words()
    to = ptr + np.arange(len(ptr))
    out = np.full(len(words) + block.n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[to[1:] - 1] = False
    out[inside] = words
    return out, to


def _stored(batches):
    """Parts of blocks of texts: distinct words, each token's word, and the documents' ids, flags and lengths."""
    from pyspark import TaskContext

    block_id = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, block in blocks(batch):
            hashed, ptr = _tokens(block)
            words, codes = ranked(hashed)
            often = np.bincount(codes)  # the commonest words have the least codes
            place = np.empty(len(words), "u4")
            place[np.argsort(-often, kind="stable")] = np.arange(len(words))
            ids, flags = part.column(0), part.column(1)
            own = {
                WORDS: _steps(words), OFTEN: packed(often), CODES: packed(place[codes]), IDS: packed(ids.fill_null(0).to_numpy()), LENGTHS: packed(np.diff(ptr)),
                NULL: packed(ids.is_null().to_numpy(zero_copy_only=False).astype("u1")), HELD: packed(flags.fill_null(True).to_numpy(zero_copy_only=False).astype("u1")),
            }
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([block_id] * n), pa.array(list(own), pa.int32()), pa.array([0] * n, pa.int32()), pa.array(list(own.values()), pa.binary())], names=["block", "kind", "bucket", "data"])
            block_id += 1
    give_back()


def _summed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(unpacked(x, "i8").sum()) for x in batch.column(0).to_pylist())])], names=["n"])


def discounts(freq: np.ndarray) -> np.ndarray:
    """d[r] for counts r up to GT_MAX by Good and Turing; 1 beyond (the last entry), and where counts of counts are too few."""
    d = np.ones(GT_MAX + 2)
    n = freq.astype(float)
    if n[1] <= 0:
        return d
    common = (GT_MAX + 1) * n[GT_MAX + 1] / n[1]
    for r in range(1, GT_MAX + 1):
        if n[r] > 0 and common < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if 0 < x < 1:
                d[r] = max(round(x / PART_OF_DISCOUNT), 1) * PART_OF_DISCOUNT
    if not (d < 1).any():
        d[1] = 0.5
    return d


class Model:
    """What is known of all training texts at once: a few numbers for each order."""

    def __init__(self, buckets: int):
        self.buckets, self.d = buckets, {}

    def counted(self, k: int, freq: np.ndarray, total: int, types: int) -> None:
        d = self.d[k] = discounts(freq)
        if k == 1:
            self.total, self.types = total, types
            mass = sum((1 - d[r]) * r * freq[r] for r in range(1, GT_MAX + 1)) / max(total, 1)
            # the unseen event never has less than one added half count would give it
            self.unseen = max(mass, 0.5 / (total + 0.5 * (types + 1))) if total else 1.0
            self.scale = (1 - self.unseen) / (1 - mass) / max(total, 1) if mass < 1 else 0.0

    def cut(self, k: int, counts: np.ndarray) -> np.ndarray:
        return self.d[k][np.minimum(counts, GT_MAX + 1)]


class Texts:
    """A block's tokens and what the buckets have answered about them. Order k's n-gram ends at each token."""

    def __init__(self, model: Model, own: pa.Table, answers: pa.Table | None):
        self.model, parts = model, {}
        rows = own if answers is None else pa.concat_tables([own, answers])
        kind, bucket, data = (rows.column(c).to_pylist() for c in ("kind", "bucket", "data"))
        for i in sorted(range(len(kind)), key=lambda i: (kind[i], bucket[i])):
            parts.setdefault(kind[i], []).append(data[i])
        self.own = {k: _keys(parts[k][0]) if k == WORDS else unpacked(parts[k][0], t) for k, t in KINDS.items()}
        self.answers = {k: np.concatenate([unpacked(x, ANSWERS[k % 10]) for x in own]) for k, own in parts.items() if k >= 10}
        self.words = self.own[WORDS][np.argsort(-self.own[OFTEN], kind="stable")[self.own[CODES]]]
        self.lengths = self.own[LENGTHS]
        ptr = np.append(0, np.cumsum(self.lengths))
        self.first = np.zeros(ptr[-1], bool)
        self.first[ptr[:-1]] = True
        self.owner = owners(ptr)
        self.learn = self.own[HELD][self.owner] == 0
        self.gram, self.at, self.of = {}, {}, {}

    def key(self, k: int) -> np.ndarray:
        if k not in self.gram:
            self.gram[k] = self.words if k == 1 else mix(self.context(k) * _U(0x9FB21C651E98DF25) + self.words)
        return self.gram[k]

    def context(self, k: int) -> np.ndarray:
        """The key of the k - 1 tokens before each token; ends stand before a text."""
        begin = np.array([END])
        for _ in range(k - 2):
            begin = mix(begin * _U(0x9FB21C651E98DF25) + END)
        below = self.key(k - 1)
        out = np.empty_like(below)
        out[1:] = below[:-1]
        out[self.first] = begin
        return out

    def open(self, k: int, whole: bool) -> np.ndarray:
        """Where order k's context (whole: its n-gram) can have been seen LEAST times, as far as the order below tells."""
        if k < 3:
            return np.ones(len(self.first), bool)
        often = self.count(k - 1) >= LEAST
        before = np.append(True, often[:-1])[: len(often)] | self.first
        return before & often if whole else before

    def asked(self, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(open tokens, distinct keys, which of them each open token has)."""
        if (k, whole) not in self.at:
            open_ = np.flatnonzero(self.open(k, whole))
            self.at[k, whole] = (open_, *ranked((self.key(k) if whole else self.context(k))[open_]))
        return self.at[k, whole]

    def answer(self, k: int, what: int, missing: float) -> np.ndarray:
        """A bucket's answer at each token."""
        if (k, what) not in self.of:
            open_, _, at = self.asked(k, what == COUNT)
            out = np.full(len(self.first), missing, ANSWERS[what])
            if 10 * k + what in self.answers:
                out[open_] = self.answers[10 * k + what][at]
            self.of[k, what] = out
        return self.of[k, what]

    def count(self, k: int) -> np.ndarray:
        return self.answer(k, COUNT, 0)

    def seen(self, k: int) -> np.ndarray:
        return self.count(k) >= (LEAST if k > 2 else 1)

    def after(self, k: int) -> np.ndarray:
        """How often each token's context is followed: as often as it occurs, and the one before a text as often as a text ends."""
        below = self.count(k - 1)
        out = np.empty_like(below)
        out[1:] = below[:-1]
        out[self.first] = self.count(1)[-1]
        return out

    def p(self, k: int) -> np.ndarray:
        """Each token's probability after the k - 1 tokens before it."""
        c = self.count(k)
        kept = self.model.cut(k, c) * c
        if k == 1:
            return np.where(c > 0, kept * self.model.scale, self.model.unseen)
        return np.where(self.seen(k), kept * self.answer(k, RATE, 1.0) / np.maximum(self.after(k), 1), self.answer(k, ALPHA, 1.0) * self.p(k - 1))


def _asks(model: Model, block: int, keys: np.ndarray, single: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has some of the sorted keys."""
    bucket = ((keys >> _U(32)) * _U(model.buckets)) >> _U(32)
    ends = np.searchsorted(bucket, np.arange(model.buckets + 1).astype(np.uint64))
    some = np.flatnonzero(np.diff(ends))
    slices = [slice(ends[b], ends[b + 1]) for b in some]
    data = [[_steps(keys[s]) for s in slices], *[[packed(x[s]) for s in slices] for x in columns]]
    data += [[None] * len(some)] * (5 - len(data))
    singles = np.where(np.arange(len(some)) == 0, single, 0)
    if single and not len(some):  # nothing is asked, but what is known to occur once still counts
        some, data, singles = np.zeros(1), [[packed(np.zeros(0, "u8"))]] * 2 + [[None]] * 3, np.array([single])
    arrays = [pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.int64()), *[pa.array(x, pa.binary()) for x in data], pa.array(singles.astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "keys", "counts", "kept", "mass", "need", "single"])


def _grams(model: Model, k: int):
    """A block's distinct n-grams and how often each occurs in its training texts."""

    def run(own: pa.Table, answers: pa.Table | None) -> pa.Table:
        t = Texts(model, own, answers)
        open_, keys, at = t.asked(k, True)
        counts = np.bincount(at[t.learn[open_]], minlength=len(keys))
        return pa.Table.from_batches([_asks(model, own["block"][0].as_py(), keys, int(t.learn.sum() - t.learn[open_].sum()), counts)])

    return run


def _contexts(model: Model, k: int):
    """A block's distinct contexts, how often each is followed, the discounted counts it keeps and the lower order's mass of its seen words."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        t = Texts(model, own, answers)
        open_, keys, at = t.asked(k, False)
        learn, c = t.learn[open_], np.maximum(t.count(k)[open_], 1)
        seen = learn & t.seen(k)[open_]
        parts = model.cut(k, c) / PART_OF_DISCOUNT, np.rint(t.p(k - 1)[open_] / c / PART_OF_MASS)
        sums = [np.bincount(at[seen], x[seen], len(keys)).astype(np.int64) for x in parts]
        need = np.zeros(len(keys), "u1")
        need[at[~t.seen(k)[open_]]] = 1  # where a word is unseen, so that the weight is asked for
        return pa.Table.from_batches([_asks(model, own["block"][0].as_py(), keys, 0, np.bincount(at[learn], minlength=len(keys)), *sums, need)])

    return run


def _gathered(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows in the order of their blocks, where each row's keys end, the distinct keys and which each is."""
    rows = rows.sort_by("block")
    keys = [_keys(x) for x in rows["keys"].to_pylist()]
    ends = np.cumsum([len(x) for x in keys])
    return rows, ends, *ranked(np.concatenate(keys))


def _added(column: pa.ChunkedArray, at: np.ndarray, n: int) -> np.ndarray:
    """What all rows of a bucket give to each of its keys."""
    total = np.zeros(n, np.int64)
    np.add.at(total, at, np.concatenate([unpacked(x, "i8") for x in column.to_pylist()]))
    return total


def _answered(rows: pa.Table, ends: np.ndarray, at: np.ndarray, columns: list[tuple[int, np.ndarray]], stat: list[int] | None) -> pa.Table:
    out, bucket = [], rows["bucket"][0].as_py()
    for i, block in enumerate(rows["block"].to_pylist()):
        own = at[ends[i - 1] if i else 0 : ends[i]]
        if len(own):
            needed = rows["need"][i].as_py()
            for kind, x in columns:
                given = x[own] * unpacked(needed, "u1") if kind % 10 == ALPHA else x[own]
                out.append((block, kind, bucket, packed(given), None))
    if stat:
        out.append((None, None, bucket, None, stat))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["block", "kind", "bucket", "data", "stat"])


def _counts(k: int):
    def run(rows: pa.Table) -> pa.Table:
        rows, ends, keys, at = _gathered(rows)
        total = _added(rows["counts"], at, len(keys))
        freq = np.bincount(np.minimum(total, GT_MAX + 2), minlength=GT_MAX + 3)
        freq[1] += sum(rows["single"].to_pylist())
        return _answered(rows, ends, at, [(10 * k + COUNT, total)], [*freq.tolist(), int(total.sum()), int((total > 0).sum())])

    return run


def _backoff(k: int):
    def run(rows: pa.Table) -> pa.Table:
        rows, ends, keys, at = _gathered(rows)
        c, kept, mass = (_added(rows[name], at, len(keys)) for name in ("counts", "kept", "mass"))
        kept, mass = kept * PART_OF_DISCOUNT, mass * PART_OF_MASS
        # the left mass is 0 where every word follows; else a context keeps at least for what it wasn't seen with
        full = mass > 1 - 1e-9
        held = np.where(full, c, np.minimum(kept, c - 0.5))
        some = kept > 0
        rate = np.where(some, held / np.where(some, kept, 1.0), 1.0)
        alpha = np.where(some, np.where(full, 0.0, (1 - held / np.maximum(c, 1e-300)) / np.where(full, 1.0, 1 - mass)), 1.0)
        alpha = (alpha.view("u8") & ~_U(0xFFF)).view("f8")  # 41 bits are kept, so that it packs better
        return _answered(rows, ends, at, [(10 * k + RATE, rate), (10 * k + ALPHA, alpha)], None)

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(model: Model, order: int):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        t = Texts(model, own, answers)
        n, c = len(t.lengths), t.count(1)
        base = np.log10((c + 0.5) / (model.total + 0.5 * (model.types + 1)))
        columns = [t.lengths, np.bincount(t.owner, c > 0, n).astype(np.int64), np.bincount(t.owner, base, n), np.bincount(t.owner, np.log10(t.p(order)), n)]
        ids = pa.array(t.own[IDS], mask=t.own[NULL] == 1)
        return pa.table([ids, pa.array(t.own[HELD] == 1), *map(pa.array, columns)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. docs: doc_id, text, held_out; rows that aren't held out are learnt from."""
    spark = docs.sparkSession
    rows = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "1000")  # Arrow batches of whole texts, read here only
    try:
        own = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(_stored, PART), "katz-blocks", "block")
    finally:
        spark.conf.set(BATCH, rows)
    lengths = own.filter(F.col("kind") == LENGTHS).select("data").mapInArrow(_summed, "n long")
    tokens = int(lengths.agg(F.sum("n")).first()[0] or 0)
    model = Model(max(16, -(-tokens // TOKENS_A_BUCKET)))
    known: dict[int, DataFrame] = {}

    def told(work, schema: str, *kinds: int) -> DataFrame:
        """What each block makes of its own parts and the answers of these kinds; the blocks stay where they are."""
        if not kinds:
            return own.groupBy("block").applyInArrow(lambda parts: work(parts, None), schema)
        tables = {id(known[kind]): known[kind] for kind in kinds}
        parts = [t.filter(F.col("kind").isin([k for k in kinds if known[k] is t])).select("block", "kind", "bucket", "data") for t in tables.values()]
        answers = reduce(DataFrame.unionByName, parts)
        return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)

    def answered(asks: DataFrame, answer, name: str) -> DataFrame:
        return settled(asks.groupBy("bucket").applyInArrow(answer, f"{PART}, stat array<long>"), name)

    for k in range(1, order + 1):
        below = [10 * j + COUNT for j in range(2, k)]
        known[10 * k + COUNT] = table = answered(told(_grams(model, k), ASKED, *below), _counts(k), f"katz-counts-{k}")
        stats = table.filter("stat is not null").select(*[F.sum(F.col("stat")[i]) for i in range(GT_MAX + 5)]).first()
        stats = [int(x or 0) for x in stats]
        model.counted(k, np.array(stats[: GT_MAX + 3]), stats[-2], stats[-1])
        if k > 1:
            # what order k has seen the order below has seen, so its probability needs no backoff weight
            needed = [*(10 * j + COUNT for j in range(1, k + 1)), *(10 * j + RATE for j in range(2, k))]
            both = answered(told(_contexts(model, k), ASKED, *needed), _backoff(k), f"katz-contexts-{k}")
            known |= {10 * k + x: both for x in (RATE, ALPHA)}
    out = told(_scores(model, order), OUT, *known)
    return out.withColumn("train_tokens", F.lit(model.total).cast("long"))


def scored(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text", (fold() == 1).alias("held_out")))
