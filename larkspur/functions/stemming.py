"""Porter's suffix stripping (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shipping import ship

#: Suffixes and what replaces them, by step; the longest that ends the word counts. Fixed values.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_SHAPE = re.compile("v+c+")


def _shape(stem: str) -> str:
    """The word as vowels and consonants; y after a consonant is a vowel."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_SHAPE.findall(_shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, and the last is none of w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (s := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _short_end(w):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, STEP_4)) and _measure(rest := w[: -len(s)]) > 1 and (s != "ion" or rest.endswith(("s", "t"))):
        w = rest
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or m == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed(tokens: Column) -> Column:
    """An array of tokens, each stemmed: an Arrow-batched function, since no built-in one stems."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: [stem(t) for t in ts])

    ship(SparkSession.active())
    return run(tokens)
