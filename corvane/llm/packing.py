"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens.

As in instruction data, an example's front is its prompt and bears no loss: as many characters as an argument tells, or its
first PROMPT-th part of the tokens. Of a prompt of characters are the ids with which both it and the whole text begin. A long example gives full sequences of prompt and answer in proportion;
the rests of a window are packed: the next piece of a bin is the one whose demand (tokens, segments, loss) has
the largest dot product with the room left, and where no whole piece fits, the longest front that does is cut
off one. Bins that no piece can fill wait for the next window; what is left at a partition's end goes to
sequences of powers of two, so nothing is padded. Null text is empty and has the end id alone; repeated rows
are packed each; an empty partition gives nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import give_back

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Chunks that a worker remembers, some 300 bytes each; an executor has a worker for each core.
CACHE = 1_000_000
#: Characters of texts that are cut into chunks at once, or one longer text.
RUN = 1 << 20
#: The share of an example that is its prompt, and the limits of a sequence.
PROMPT, TOKENS, SEGMENTS, LOSS, WINDOW = 4, 2048, 256, 1792, 2048


class Codes(dict):
    """A number for each chunk, in the order of their first sight; fresh: those not encoded yet."""

    fresh: list

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class Encoder:
    """Ids of whole texts; chunks between ASCII white space are encoded once and remembered, so many and those of one run at most."""

    def __init__(self, path: str, remember: int = CACHE, end: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks themselves are parallel
        from tokenizers import Tokenizer

        self.tokenizer, self.remember, self.end = Tokenizer.from_file(path), remember, end
        self.mark = self.encoded_each([MARK])[0]
        self.code, self.pool, self.length, self.seen = Codes({None: 0}), np.array([self.end], "<u4"), np.array([1]), np.array([0])
        self.code.fresh = []

    def forget(self) -> None:
        """Most chunks are seen once only; of the others those seen most often stay, half of what is remembered at most, with half of their counts."""
        often = 1 + np.flatnonzero(self.seen[1:] > 1)
        often = np.sort(often[np.argsort(-self.seen[often], kind="stable")[: self.remember // 2]])
        stay = np.concatenate([[0], often])
        chunks = list(self.code)
        self.code = Codes(zip(map(chunks.__getitem__, stay.tolist()), range(len(stay))))
        self.code.fresh = []
        self.pool = self.gathered(stay)
        self.length, self.seen = self.length[stay], self.seen[stay] // 2

    def encoded_each(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk). Chunks are encoded in lines with MARK between them, as white space sets them apart."""
        if len(self.mark) == 1 and not any(MARK in c for c in chunks):
            line = f" {MARK} "
            found = self.encoded_each([line.join(chunks[i : i + 64]) for i in range(0, len(chunks), 64)])
            ids = np.fromiter(chain.from_iterable(chain(x, self.mark) for x in found), "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) == len(chunks):
                return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        found = self.encoded_each(chunks)
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def gathered(self, codes: np.ndarray) -> np.ndarray:
        """The ids of chunks, one after the other."""
        start, n = np.cumsum(self.length) - self.length, self.length[codes]
        to = np.cumsum(n)
        return self.pool[np.repeat(start[codes] - (to - n), n) + np.arange(to[-1])]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            to, room = at + 1, RUN - len(texts[at])
            while to < len(texts) and len(texts[to]) <= room:
                room -= len(texts[to])
                to += 1
            out += self.run(texts[at:to])
            at = to
        return out

    def run(self, texts: list[str]) -> list[np.ndarray]:
        split = [x.split() if not OTHER_SPACE.search(x) else CHUNK.findall(x) for x in texts]
        for words in split:
            words.append(None)  # the end
        if len(self.code) > self.remember:
            self.forget()
            give_back()
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.code.fresh:
            ids, length = self.encoded(self.code.fresh)
            self.length, self.pool, self.code.fresh = np.append(self.length, length), np.append(self.pool, ids), []
        self.seen = np.bincount(codes, minlength=len(self.length)) + np.append(self.seen, np.zeros(len(self.length) - len(self.seen), np.int64))
        to = np.cumsum(self.length[codes])
        return np.split(self.gathered(codes), to[np.cumsum([len(w) for w in split])[:-1] - 1])


#: A sign that is a word of its own.
MARK = "\u2665"


@lru_cache(maxsize=1)
def encoder(path: str, remember: int = CACHE) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path, remember)


#: What str.split() takes as white space beyond ``[ \t-\r]``.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CHUNK = re.compile(r"[^ \t-\r]+")


def fill(start: np.ndarray, end: np.ndarray, prompt: np.ndarray, tokens: int, segments: int, loss: int, last: bool) -> tuple[list, list]:
    """(bins, rest) of (item, start, end) for pieces of examples whose tokens bear loss from ``prompt`` on.

    Unless last, the first bin that can't be filled and all that is left are the rest.
    """
    item = np.arange(len(start))
    start, end, prompt = start.copy(), end.copy(), prompt.copy()
    alive, n_alive, bins = np.ones(len(item), bool), len(item), []
    while n_alive:
        if 2 * n_alive < len(item):
            item, start, end, prompt = item[alive], start[alive], end[alive], prompt[alive]
            alive = np.ones(n_alive, bool)
        n = np.where(alive, end - start, tokens + 1)
        bears = end - np.minimum(np.maximum(prompt, start), end)
        room, pieces = [tokens, segments, loss], []
        while room[0] and room[1] and n_alive:
            # demand . room, each as a share of its limit
            score = n * (room[0] / tokens**2) + bears * (room[2] / loss**2) + room[1] / segments**2
            score[(n > room[0]) | (bears > room[2])] = -1.0
            i = int(score.argmax())
            if score[i] > 0:
                k = int(n[i])
            else:
                # the longest front: all of the prompt that is left and as much loss as there is room for
                front = np.where(alive, np.minimum(room[0], np.maximum(prompt - start, 0) + room[2]), 0)
                i = int(front.argmax())
                k = int(front[i])
                if not k:
                    break
            pieces.append((int(item[i]), int(start[i]), int(start[i]) + k))
            room = [room[0] - k, room[1] - 1, room[2] - max(0, int(start[i]) + k - max(int(prompt[i]), int(start[i])))]
            start[i] += k
            if start[i] == end[i]:
                alive[i], n_alive, n[i] = False, n_alive - 1, tokens + 1
            else:
                n[i], bears[i] = n[i] - k, end[i] - min(max(prompt[i], start[i]), end[i])
        if room[0] and not last:
            return bins, pieces + [(int(item[i]), int(start[i]), int(end[i])) for i in np.flatnonzero(alive)]
        bins.append(pieces)
    return bins, []


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a bin cut into bins whose sizes are powers of two."""
    pieces = list(pieces)
    left = sum(e - s for _, s, e in pieces)
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        used = []
        while need:
            i, s, e = pieces.pop()
            k = min(e - s, need)
            used.append((i, s, s + k))
            if s + k < e:
                pieces.append((i, s + k, e))
            need -= k
        yield used


def cut(n: int, prompt: int, tokens: int, loss: int) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """(full sequences, rests) of an example, as (start, end): each sequence takes as much of the answer as the limit on loss and the example's own share allow."""
    answer = n - prompt
    each = min(loss, -(-answer * tokens // max(n, 1)))
    full = min(n // tokens, answer // each if each else n // tokens, prompt // (tokens - each) if tokens > each else n // tokens)
    p, a = full * (tokens - each), prompt + full * each
    sequences = [[x for x in ((i * (tokens - each), (i + 1) * (tokens - each)), (prompt + i * each, prompt + (i + 1) * each)) if x[1] > x[0]] for i in range(full)]
    if a == prompt:  # nothing between what is left of prompt and answer
        return sequences, _short([(p, n)], tokens)
    return sequences, _short([(p, prompt), (a, n)], tokens)


def _short(spans: list[tuple[int, int]], tokens: int) -> list[tuple[int, int]]:
    return [(s, min(s + tokens, e)) for b, e in spans for s in range(b, e, tokens)]


def packer(path: str, tokens: int, segments: int, loss: int, window: int = WINDOW, remember: int = CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()  # what other stages' tasks have left in this worker
        base, sequence, encode = TaskContext.get().partitionId() << 40, 0, encoder(path, remember)

        def placed(bins, rests):
            """Rows of the bins; rests: (doc, first, ids, total, prompt) with ids from the example's token ``first`` on."""
            nonlocal sequence
            rows = []
            for one in bins:
                at = 0
                for i, s, e in one:
                    doc, first, ids, total, _ = rests[i]
                    rows.append((doc, s, e - s, zlib.crc32(ids[s - first : e - first].tobytes()), total, base + sequence, at))
                    at += e - s
                sequence += 1
            return rows

        def out(rows):
            columns = list(zip(*rows)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def filled(rests, last):
            column = lambda f: np.array([f(r) for r in rests], np.int64)
            bins, left = fill(column(lambda r: r[1]), column(lambda r: r[1] + len(r[2])), column(lambda r: r[4]), tokens, segments, loss, last)
            whole = [b for one in bins for b in ([one] if sum(e - s for _, s, e in one) == tokens else powers(one))]
            rows = placed(whole, rests)
            return rows, [(rests[i][0], s, rests[i][2][s - rests[i][1] : e - rests[i][1]], *rests[i][3:]) for i, s, e in left]

        rests: list = []
        for batch in batches:
            give_back()
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = lambda name, part=part: part.column(part.schema.get_field_index(name)).to_pylist()
                rows = []
                texts, chars = [x or "" for x in column("text")], column("prompt")
                fronts = encode([t[: max(c, 0)] for t, c in zip(texts, chars) if c is not None]) if any(c is not None for c in chars) else []
                fronts = iter(fronts)
                for doc, c, ids in zip(column("doc_id"), chars, encode(texts)):
                    n = len(ids)
                    prompt = n // PROMPT if c is None else shared_front(next(fronts)[:-1], ids)
                    sequences, short = cut(n, prompt, tokens, loss) if n >= tokens else ([], [(0, n)])
                    rows += placed([[(0, s, e) for s, e in one] for one in sequences], [(doc, 0, ids, n, prompt)])
                    rests += [(doc, s, ids[s:e].copy(), n, prompt) for s, e in short]  # a view would keep its whole run's ids
                if rows:
                    yield out(rows)
                if len(rests) >= window:
                    rows, rests = filled(rests, False)
                    yield out(rows)
                    if len(rests) > window // 2:  # what can't be filled doesn't pile up
                        rows, rests = filled(rests, True)
                        yield out(rows)
        if rests:
            yield out(filled(rests, True)[0])

    return run


def shared_front(a: np.ndarray, b: np.ndarray) -> int:
    """How many ids both begin with."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def pack(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, prompt_chars: Column | None = None, remember: int = CACHE) -> DataFrame:
    """One row per piece. prompt_chars: of each example, how many characters of its text are the prompt; where it is null or not given, the share PROMPT. remember: how many chunks a worker does; fewer take less memory and more time. Every partition packs its own documents; no row is moved."""
    prompt = F.lit(None).cast("long") if prompt_chars is None else prompt_chars.cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), prompt.alias("prompt"), "text").mapInArrow(packer(tokenizer, tokens, segments, loss, remember=remember), SCHEMA)


def examples(conversations: DataFrame) -> DataFrame:
    """doc_id, text and prompt_chars of each conversation: its turns in order (null first), of which the last turn's text alone is the answer if the assistant's.

    Null roles and texts are empty; rows without a conversation are left out. A conversation becomes one text, so it is gathered in one row.
    """
    rows = conversations.filter("conv_id is not null")
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("told"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    one = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    last = F.element_at("t", -1)
    answer = F.when(last["role"] == "assistant", F.length(last["text"])).otherwise(0)
    return one.select("doc_id", text.alias("text"), (F.length(text) - answer).alias("prompt_chars"))
