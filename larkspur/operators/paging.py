"""Offset pages with exact totals, and keyset pages with cursors."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import LarkspurError
from larkspur.functions.columns import literal
from larkspur.plans.compiler import ordering, quoted, with_tiebreak

DEFAULT_LIMIT, MOST_LIMIT = 20, 1000


def clamp(n: Any, default: int, most: int = MOST_LIMIT) -> int:
    """n as a number from 1 to most."""
    return min(max(int(n if n is not None else default), 1), most)


@dataclass
class Page:
    docs: DataFrame
    page: int
    limit: int
    total: int
    pages: int
    has_next: bool
    has_prev: bool
    method: str = "offset"

    def rows(self) -> list[dict]:
        return [r.asDict(True) for r in self.docs.collect()]


@dataclass
class KeysetPage:
    docs: DataFrame
    limit: int
    has_more: bool
    next: str | None
    method: str = "keyset"

    def rows(self) -> list[dict]:
        return [r.asDict(True) for r in self.docs.collect()]


def offset_frame(df: DataFrame, keys: list[tuple[str, bool]], pk: str, page: int, limit: int) -> DataFrame:
    """One page, lazily: a single top-k with an offset, ties broken by the key."""
    return df.orderBy(*ordering(with_tiebreak(keys, pk), df.schema)).offset((page - 1) * limit).limit(limit)


def offset_page(df: DataFrame, keys: list[tuple[str, bool]], pk: str, page: Any = 1, limit: Any = None, count: str = "exact", least_pages: int = 0) -> Page:
    """count "exact": total by a count; "none": no total, one row more is read to see if a page follows."""
    page, limit = max(int(page or 1), 1), clamp(limit, DEFAULT_LIMIT)
    if count == "none":
        rows = df.orderBy(*ordering(with_tiebreak(keys, pk), df.schema)).offset((page - 1) * limit).limit(limit + 1).collect()
        docs = df.sparkSession.createDataFrame(rows[:limit], df.schema)
        return Page(docs, page, limit, 0, 0, len(rows) > limit, page > 1)
    total = df.count()
    pages = max(least_pages, math.ceil(total / limit))
    return Page(offset_frame(df, keys, pk, page, limit), page, limit, total, pages, page < pages, page > 1)


# ---------------------------------------------------------------- cursors

_KINDS = {"ts": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "dec": decimal.Decimal, "hex": bytes.fromhex}


def _plain(v: Any) -> Any:
    if isinstance(v, dt.datetime):
        return {"$ts": v.isoformat()}
    if isinstance(v, dt.date):
        return {"$date": v.isoformat()}
    if isinstance(v, decimal.Decimal):
        return {"$dec": str(v)}
    if isinstance(v, (bytes, bytearray)):
        return {"$hex": bytes(v).hex()}
    return v


def encode_cursor(values: list, version: int = 1) -> str:
    text = json.dumps({"v": version, "values": [_plain(v) for v in values]}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, length: int) -> list:
    try:
        told = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        version, values = told["v"], told["values"]
        out = [_KINDS[next(iter(v))[1:]](next(iter(v.values()))) if isinstance(v, dict) else v for v in values]
    except (ValueError, KeyError, TypeError, StopIteration) as e:
        raise LarkspurError("malformed cursor") from e
    if not isinstance(version, int) or version < 1:
        raise LarkspurError(f"cursor version {version!r} isn't supported")
    if len(out) != length:
        raise LarkspurError("the cursor belongs to another sort")
    return out


def after(keys: list[tuple[str, bool]], values: list, df: DataFrame) -> Column:
    """Rows behind the given ones, nulls first ascending and last descending."""
    steps, equal = [], []
    for (k, up), v in zip(keys, values, strict=True):
        c, x = quoted(k), literal(v, df.schema[k].dataType)
        if v is None:
            beyond, same = (c.isNotNull() if up else F.lit(False)), c.isNull()
        else:
            beyond, same = (c > x if up else (c < x) | c.isNull()), c == x
        steps.append(reduce(and_, [*equal, beyond]))
        equal.append(same)
    return reduce(or_, steps)


def keyset_frame(df: DataFrame, keys: list[tuple[str, bool]], pk: str, cursor: str | None, limit: int) -> DataFrame:
    keys = with_tiebreak(keys, pk)
    order = ordering(keys, df.schema)
    rest = df.where(after(keys, decode_cursor(cursor, len(keys)), df)) if cursor else df
    return rest.orderBy(*order).limit(limit)


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], pk: str, cursor: str | None = None, limit: Any = None) -> KeysetPage:
    """The page after the cursor; a cursor to the next one only if there is more."""
    limit, keys = clamp(limit, DEFAULT_LIMIT), with_tiebreak(keys, pk)
    rows = keyset_frame(df, keys, pk, cursor, limit + 1).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    following = encode_cursor([rows[-1][k] for k, _ in keys]) if more else None
    return KeysetPage(df.sparkSession.createDataFrame(rows, df.schema), limit, more, following)
