"""Filters, sorts and updates as Spark columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import LarkspurError, UnknownColumn
from larkspur.functions.columns import NUMBERS, bound_sql, like_pattern, literal
from larkspur.plans import filters as f

_COMPARE = {"eq": Column.__eq__, "ne": Column.__ne__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def resolve(schema: T.StructType, field: str, stage: str) -> T.DataType:
    if field not in schema.fieldNames():
        raise UnknownColumn(field, stage, schema.fieldNames())
    return schema[field].dataType


def quoted(field: str) -> Column:
    return F.col("`" + field.replace("`", "``") + "`")


def compile_filter(node: f.Filter, schema: T.StructType, stage: str = "filter") -> Column:
    """The predicate as a column. Unknown columns and refused nodes raise before any plan is built."""
    go = lambda n: compile_filter(n, schema, stage)
    match node:
        case f.Truth(value):
            return F.lit(value)
        case f.Compare(op, field, None) if op in ("eq", "ne"):
            resolve(schema, field, stage)
            return quoted(field).isNull() if op == "eq" else quoted(field).isNotNull()
        case f.Compare(op, field, value):
            return _COMPARE[op](quoted(field), literal(value, resolve(schema, field, stage)))
        case f.Member(field, values, negated):
            kind = resolve(schema, field, stage)
            if not values:
                return F.lit(negated)
            hit = quoted(field).isin(*[literal(v, kind) for v in values])
            return ~hit if negated else hit
        case f.Exists(field, present):
            resolve(schema, field, stage)
            return quoted(field).isNotNull() if present else quoted(field).isNull()
        case f.Like(field, pattern, sensitive):
            kind = resolve(schema, field, stage)
            c = quoted(field) if isinstance(kind, T.StringType) else quoted(field).cast("string")
            return c.like(like_pattern(pattern)) if sensitive else F.lower(c).like(like_pattern(pattern.lower()))
        case f.Regex(field, pattern, allowed):
            resolve(schema, field, stage)
            if not allowed:
                raise LarkspurError("regex isn't portable: use like or contains, or pass allowed=True for Spark's rlike")
            return quoted(field).rlike(pattern)
        case f.And(children):
            return reduce(and_, map(go, children))
        case f.Or(children):
            return reduce(or_, map(go, children))
        case f.Not(child):
            return ~go(child)
        case f.Raw(sql, params):
            return F.expr(bound_sql(sql, params))
    raise LarkspurError(f"no filter: {node!r}")


def where(df: DataFrame, flt: f.Filter | Mapping | None) -> DataFrame:
    node = f.as_filter(flt)
    return df if f.is_true(node) else df.where(compile_filter(node, df.schema))


# ---------------------------------------------------------------- sorts


def sort_keys(sort: str | Mapping[str, Any] | list | None, default: str) -> list[tuple[str, bool]]:
    """(column, ascending) of "-a,+b,c", {"a": 1, "b": -1} or pairs; default ascending if empty."""
    if isinstance(sort, str):
        names = [s.strip() for s in sort.split(",") if s.strip()]
        keys = [(s.lstrip("+-"), not s.startswith("-")) for s in names]
    elif isinstance(sort, Mapping):
        keys = [(k, v not in (-1, "desc", "-1", False)) for k, v in sort.items()]
    else:
        keys = [(k, bool(up)) for k, up in sort or []]
    return keys or [(default, True)]


def with_tiebreak(keys: list[tuple[str, bool]], pk: str) -> list[tuple[str, bool]]:
    return keys if any(k == pk for k, _ in keys) else [*keys, (pk, True)]


def ordering(keys: list[tuple[str, bool]], schema: T.StructType, stage: str = "sort") -> list[Column]:
    """Nulls come first ascending, last descending."""
    for k, _ in keys:
        resolve(schema, k, stage)
    return [quoted(k).asc_nulls_first() if up else quoted(k).desc_nulls_last() for k, up in keys]


# ---------------------------------------------------------------- updates


class Update:
    """An update as literal sets, nulls, increments and values for inserts only."""

    def __init__(self, set: Mapping | None = None, unset=(), inc: Mapping | None = None, set_on_insert: Mapping | None = None):
        self.set, self.unset, self.inc, self.set_on_insert = dict(set or {}), tuple(unset), dict(inc or {}), dict(set_on_insert or {})

    @classmethod
    def of(cls, x: Update | Mapping) -> Update:
        if isinstance(x, Update):
            return x
        if isinstance(x, (list, tuple)):
            raise LarkspurError("pipeline updates aren't supported: pass a record or an Update")
        return cls(set=x)

    def plus(self, **values) -> Update:
        return Update({**self.set, **values}, self.unset, self.inc, self.set_on_insert)

    def columns(self, schema: T.StructType, pk: str) -> dict[str, Column]:
        """New values by column; the key is never updated."""
        out: dict[str, Column] = {}
        for k, v in self.set.items():
            out[k] = v if isinstance(v, Column) else literal(v, resolve(schema, k, "update"))
        for k in self.unset:
            out[k] = F.lit(None).cast(resolve(schema, k, "update"))
        for k, delta in self.inc.items():
            kind = resolve(schema, k, "update")
            if not isinstance(kind, NUMBERS):
                raise LarkspurError(f"inc: {k} is no number")
            out[k] = (F.coalesce(quoted(k), F.lit(0).cast(kind)) + literal(delta, kind)).cast(kind)
        out.pop(pk, None)
        return out

    def inserted(self, flat: Mapping[str, Any]) -> dict[str, Any]:
        """The row that an upsert inserts: the filter's equalities, then the update, then insert-only values."""
        return {**flat, **self.set, **dict.fromkeys(self.unset), **self.inc, **self.set_on_insert}
