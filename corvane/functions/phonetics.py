"""Metaphone codes by the published rules, for words in Latin letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS, SOFT = "AEIOU", "IEY"
# Fronts that lose a letter, and letters that always have the same code.
SILENT_FRONTS = ("AE", "GN", "KN", "PN", "WR")
PLAIN = {"F": "F", "J": "J", "L": "L", "M": "M", "N": "N", "R": "R", "Q": "K", "V": "F", "Z": "S", "X": "KS"}


def metaphone(word: str) -> str:
    """Letters other than A-Z are left out; a word without any has the empty code."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if w[:2] in SILENT_FRONTS:
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    w = "".join(c for i, c in enumerate(w) if c == "C" or i == 0 or w[i - 1] != c)
    code = []
    for i, c in enumerate(w):
        before, after = w[i - 1 : i] if i else "", w[i + 1 : i + 2]
        vowel_after = after != "" and after in VOWELS
        soft = after != "" and after in SOFT
        if c in VOWELS:
            code.append(c if i == 0 else "")
        elif c in PLAIN:
            code.append(PLAIN[c])
        elif c == "B":
            code.append("" if before == "M" and not after else "B")
        elif c == "C":
            if soft:
                code.append("" if before == "S" else "X" if w[i + 1 : i + 3] == "IA" else "S")
            else:
                code.append("X" if after == "H" and before != "S" else "K")
        elif c == "D":
            code.append("J" if after == "G" and w[i + 2 : i + 3] in tuple(SOFT) else "T")
        elif c == "G":
            beyond = w[i + 2 : i + 3]
            quiet = (after == "H" and beyond not in tuple(VOWELS)) or (after == "N" and w[i + 2 :] in ("", "ED")) or (before == "D" and soft)
            code.append("" if quiet else "J" if soft else "K")
        elif c == "H":
            code.append("" if before in tuple("CSPTG") or (before in tuple(VOWELS) and not vowel_after) else "H")
        elif c == "K":
            code.append("" if before == "C" else "K")
        elif c == "P":
            code.append("F" if after == "H" else "P")
        elif c == "S":
            code.append("X" if after == "H" or w[i + 1 : i + 3] in ("IO", "IA") else "S")
        elif c == "T":
            code.append("X" if w[i + 1 : i + 3] in ("IO", "IA") else "0" if after == "H" else "" if w[i + 1 : i + 3] == "CH" else "T")
        else:  # W and Y sound before vowels only
            code.append(c if vowel_after else "")
    return "".join(code)


def _codes(words: pd.Series) -> pd.Series:
    seen = {w: metaphone(w) for w in words.dropna().unique()}
    return pd.Series([seen.get(w) for w in words.astype(object)], dtype=object)


def metaphone_code(word: Column) -> Column:
    """Arrow-batched; best given distinct words. Null has no code."""
    return F.pandas_udf(_codes, "string")(word)
