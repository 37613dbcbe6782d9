"""Fill-in-the-middle transformation by a two-pass streaming matcher.

Units are the matches of a pattern, by default single code points. A first pass over a text counts them; the ranks
drawn for the text then tell where its prefix and its middle end, and a second pass advances one lazy iterator of
matches to the smaller and on to the larger rank. No pass keeps units: what a text needs is its own characters and
two offsets. A span that no match covers belongs to the part that the next match lies in.

Null texts are empty. Empty texts, texts that hold a sentinel and the share of texts drawn to stay plain are left as
they are. A null doc_id draws as the empty text does; repeated rows draw alike; extra columns are not read; an empty
table gives no rows. Sentinels must be of the form <X> with different single letters, so that an output splits at its
sentinels in one way only.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import give_back

UNIT, SEED, SENTINELS = r"(?s:.)", "1", ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many are transformed, and how many of these put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters of texts whose outputs are handed on together.
BLOCK_CHARS = 1 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def counted(matches: Iterator) -> int:
    """How many there are; none is kept."""
    told = count()
    deque(zip(matches, told), maxlen=0)
    return next(told)


def cuts(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """The offsets at which the first-th and the second-th match end (0: the text's beginning), first <= second, by one iterator of matches."""
    matches = unit.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, second - first - 1, None)).end() if second > first else a
    return a, b


def arranged(text: str, draw: str, unit: re.Pattern, sentinels: tuple[str, str, str] = SENTINELS) -> tuple:
    """(units, form, characters of prefix and middle, output). draw: hex digits, eight for each of the two ranks, the rate and the order."""
    n = counted(unit.finditer(text))
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in sentinels) or h3 % 100 >= RATE:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts(unit, text, first, second)
    p, s, m = sentinels
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def _arranged(pattern: str, sentinels: tuple[str, str, str]):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        unit, rows, size = re.compile(pattern), [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for i in range(batch.num_rows):  # a text at a time: no list of a batch's texts is made
                text = batch.column(1)[i].as_py()
                rows.append((batch.column(0)[i].as_py(), *arranged(text, batch.column(2)[i].as_py(), unit, sentinels)))
                size += len(text)
                if size > BLOCK_CHARS:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)
        give_back()

    return run


def transformed(docs: DataFrame, unit: str = UNIT, seed: str = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of every row. unit: a pattern that never matches the empty text."""
    if re.compile(unit).match(""):
        raise ValueError("a unit must not be empty")
    if len(set(sentinels)) < 3 or not all(re.fullmatch("<[A-Za-z]>", s) for s in sentinels):
        raise ValueError("sentinels must be three different ones of the form <X>")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), draw.alias("draw"))
    return rows.mapInArrow(_arranged(unit, sentinels), SCHEMA)


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, told from the output and its form alone."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    whole = lambda *order: F.concat(*[parts[i] for i in order])
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)
