"""Typed literals, LIKE patterns, SQL literals and text tokens as columns."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import unicodedata
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import LarkspurError

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def literal(value: Any, kind: T.DataType) -> Column:
    """A literal in the column's own type: comparisons then need no cast of the column, which
    would hide it from the scan, and none that fails at run time."""
    if value is None:
        return F.lit(None).cast(kind)
    try:
        if isinstance(kind, T.StringType):
            return F.lit(value if isinstance(value, str) else str(value))
        if isinstance(kind, T.BooleanType):
            if isinstance(value, str):
                value = {"true": True, "1": True, "false": False, "0": False}[value.lower()]
            return F.lit(bool(value))
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            if isinstance(value, float) and not value.is_integer() or isinstance(value, str) and "." in value:
                return F.lit(float(value))
            # A number beyond the column's range compares as a wider one.
            n = int(value)
            return F.lit(n).cast(kind) if abs(n) < 2 ** {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(kind)] else F.lit(float(n))
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.lit(float(value))
        if isinstance(kind, T.DecimalType):
            return F.lit(decimal.Decimal(str(value)))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat() if isinstance(value, dt.date) else str(value)
            return F.lit(text).cast(kind)
    except (KeyError, TypeError, ValueError, decimal.InvalidOperation) as e:
        raise LarkspurError(f"{value!r} is no {kind.simpleString()}") from e
    return F.lit(value)


def like_pattern(pattern: str) -> str:
    """The pattern with each backslash that escapes nothing (Spark refuses those) doubled."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 < len(pattern) and pattern[i + 1] in "%_\\":
                out.append(pattern[i : i + 2])
                i += 2
                continue
            c = "\\\\"
        out.append(c)
        i += 1
    return "".join(out)


def sql_literal(value: Any) -> str:
    """A value as Spark SQL text. Strings go as bytes, so nothing in them can end the literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if -(2**63) <= value < 2**63 else f"{value}BD"
    if isinstance(value, float):
        return f"cast('{value!r}' as double)"
    if isinstance(value, decimal.Decimal):
        return f"{value}BD"
    if isinstance(value, dt.datetime):
        return f"timestamp_ntz'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"date'{value.isoformat()}'"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, str):
        return f"decode(X'{value.encode().hex()}', 'UTF-8')"
    raise LarkspurError(f"{type(value).__name__} can't be a parameter")


#: Of Spark SQL's text: comments, quoted names, and strings, raw or with escapes; and what may be a parameter.
_PIECES = re.compile(
    r"""(?P<skip>--[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`|(?<![A-Za-z0-9_])[rR](?:'[^']*'|"[^"]*")|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<mark>\?)""",
    re.DOTALL,
)


def bound_sql(sql: str, params: tuple) -> str:
    """sql with its ? replaced by parameters, but for those in quotes and comments."""
    left = list(params)

    def put(m: re.Match) -> str:
        if m["skip"] is not None:
            return m["skip"]
        if not left:
            raise LarkspurError("raw: more ? than parameters")
        return sql_literal(left.pop(0))

    out = _PIECES.sub(put, sql)
    if left:
        raise LarkspurError("raw: more parameters than ?")
    return out


def _marked_letters() -> dict[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters that decompose into a letter and marks, by that letter."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and all(unicodedata.combining(m) for m in marks) and unicodedata.name(base, "").startswith(("LATIN", "GREEK", "CYRILLIC")):
            out[c] = base
    return out


_LETTERS = _marked_letters()
#: Letters with marks and their plain letters, for tokenizing.
MARKED, PLAIN_ = "".join(_LETTERS), "".join(_LETTERS.values())
#: Marks that stand on their own after a letter.
MARKS = "\u0300-\u036f"


def folded(text: Column) -> Column:
    """Lower case without marks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Most of the work is only for texts that have other than ASCII characters.
    return F.when(F.rlike(low, F.lit(r"[^\x00-\x7F]")), F.regexp_replace(F.translate(low, MARKED, PLAIN_), f"[{MARKS}]+", "")).otherwise(low)


def folded_text(text: str) -> str:
    """The same on the driver."""
    out = text.lower().translate(str.maketrans(MARKED, PLAIN_))
    return re.sub(f"[{MARKS}]+", "", out)


def tokens(text: Column, kind: str = "words") -> Column:
    """The array of tokens: case-folded runs of letters and digits without marks, or trigrams."""
    plain = folded(text)
    if kind == "trigram":
        starts = lambda t: F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1)))
        cut = lambda t: F.transform(starts(t), lambda i: F.substring(t, i, F.lit(3)))
        return let(plain, lambda t: F.when(F.length(t) >= 3, cut(t)).otherwise(F.array().cast("array<string>")))
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once. Bound as a lambda variable: the optimizer copies plain
    columns into the lambdas that use them, and computes them again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def instant(text: Column) -> Column:
    """An ISO-8601 text as a timestamp; what is none is null."""
    return F.try_to_timestamp(text)


def plus_seconds(at: Column, seconds: float) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)"))
