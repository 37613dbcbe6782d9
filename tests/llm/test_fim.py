"""The streaming matcher against slicing, on nulls, sentinels, astral characters, repeats and extra columns."""

import hashlib
import random
import re

import pytest

from corvane.llm import fim

SCHEMA = "doc_id long, text string, form string, output string, draw string, n string"


def expected(doc_id, text, unit=None):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    ends = [0, *range(1, len(text) + 1)] if unit is None else [0, *(m.end() for m in re.finditer(unit, text))]
    n = len(ends) - 1
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = (ends[x] for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [(i, "".join(rnd.choice("ab \n<>PSMé\U0001f600") for _ in range(rnd.choice([1, 2, 3, 30, 500])))) for i in range(300)]
    return out + [(None, "no id"), (None, None), (300, None), (301, ""), (302, "a<S>b"), (303, "word " * 300_000), (5, out[5][1]), (5, out[5][1]), (-7, "negative"), (304, "<" * 9 + "P>" * 9)]


@pytest.mark.parametrize("unit", [None, r"\S+"])
def test_every_row_as_by_slicing(spark, rows, unit):
    docs = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA).repartition(3)
    made = fim.transformed(docs) if unit is None else fim.transformed(docs, unit)
    got = made.withColumn("back", fim.restored("output", "form")).collect()
    key = lambda r: (str(r[0]), r[-1])
    want = sorted(((i, *expected(i, t, unit), t or "") for i, t in rows), key=key)
    assert [tuple(r) for r in sorted(got, key=key)] == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_unit_is_kept():
    class Lazy:
        """Counts the matches that are alive."""

        def __init__(self):
            self.alive = self.most = 0

        def __iter__(self):
            for _ in range(10_000):
                yield Match(self)

    class Match:
        def __init__(self, owner):
            self.owner = owner
            owner.alive += 1
            owner.most = max(owner.most, owner.alive)

        def __del__(self):
            self.owner.alive -= 1

    lazy = Lazy()
    assert fim.counted(iter(lazy)) == 10_000 and lazy.most <= 3


def test_bad_parameters_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.transformed(empty).count() == 0
    for bad in ({"unit": "a*"}, {"sentinels": ("<P>", "<P>", "<M>")}, {"sentinels": ("<P>", "<S>", "M")}):
        with pytest.raises(ValueError):
            fim.transformed(empty, **bad)
