"""Grouped and scalar aggregation with filters before and after."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import LarkspurError
from larkspur.operators.paging import DEFAULT_LIMIT, Page, clamp
from larkspur.plans import filters as f
from larkspur.plans.compiler import compile_filter, ordering, quoted, resolve, sort_keys, where

#: By operation: how the column is summed up.
OPS = {"count": F.count, "countDistinct": F.count_distinct, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class AggRequest:
    """measures: alias to an operation, as {"op": "sum", "field": "x"} or ("sum", "x")."""

    measures: Mapping[str, Any]
    group_by: str | tuple[str, ...] | list[str] = ()
    filter: Any = None
    having: Any = None
    sort: Any = None
    limit: int | None = None
    offset: int = 0
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def groups(self) -> list[str]:
        return [self.group_by] if isinstance(self.group_by, str) else list(self.group_by or ())


def _measure(alias: str, spec: Any, df: DataFrame) -> Column:
    op, name = (spec["op"], spec.get("field")) if isinstance(spec, Mapping) else (spec, None) if isinstance(spec, str) else (spec[0], spec[1] if len(spec) > 1 else None)
    if op not in OPS:
        raise LarkspurError(f"measure {alias}: no operation {op!r}; one of {', '.join(OPS)}")
    if op == "count" and name in (None, "*"):
        return F.count(F.lit(1)).alias(alias)
    if not name:
        raise LarkspurError(f"measure {alias}: {op} needs a field")
    resolve(df.schema, name, "aggregate")
    return OPS[op](quoted(name)).alias(alias)


def _refuse_patterns(node: f.Filter, aliases: set[str]) -> None:
    match node:
        case f.Like(name, _, _) | f.Regex(name, _, _) if name in aliases:
            raise LarkspurError(f"having: patterns don't apply to the measure {name}")
        case f.And(children) | f.Or(children):
            for c in children:
                _refuse_patterns(c, aliases)
        case f.Not(child):
            _refuse_patterns(child, aliases)


def grouped(df: DataFrame, req: AggRequest) -> DataFrame:
    """Groups and measures, filtered before and after, in no order."""
    if not req.measures:
        raise LarkspurError("aggregate: at least one measure is needed")
    if clash := {*req.groups} & {*req.measures}:
        raise LarkspurError(f"aggregate: {', '.join(clash)} names both a group and a measure")
    for g in req.groups:
        resolve(df.schema, g, "aggregate")
    measures = [_measure(a, s, df) for a, s in req.measures.items()]
    rows = where(df, req.filter)
    out = rows.groupBy(*[quoted(g) for g in req.groups]).agg(*measures) if req.groups else rows.agg(*measures)
    having = f.as_filter(req.having)
    if f.is_true(having):
        return out
    _refuse_patterns(having, {*req.measures})
    return out.where(compile_filter(having, out.schema, "having"))


def _sorted(out: DataFrame, req: AggRequest) -> DataFrame:
    if not req.sort:
        return out
    keys = sort_keys(req.sort, "")
    # Groups break ties, so that a limit always takes the same rows.
    keys += [(g, True) for g in req.groups if g not in {k for k, _ in keys}]
    return out.orderBy(*ordering(keys, out.schema, "aggregate sort"))


def aggregate(df: DataFrame, req: AggRequest) -> DataFrame:
    out = _sorted(grouped(df, req), req)
    if req.offset and req.offset > 0:
        out = out.offset(req.offset)
    return out.limit(req.limit) if req.limit is not None else out


def count_groups(df: DataFrame, req: AggRequest) -> int:
    """How many rows the request has without limit and offset; 0 for a scalar one over no rows."""
    if not f.is_true(f.as_filter(req.having)):
        return grouped(df, req).count()
    if not req.groups:
        return int(not where(df, req.filter).limit(1).isEmpty())
    return where(df, req.filter).select(*[quoted(g) for g in req.groups]).distinct().count()


def aggregate_page(df: DataFrame, req: AggRequest, page: Any = 1, limit: Any = None, count: str = "exact") -> Page:
    page, limit = max(int(page or 1), 1), clamp(limit, DEFAULT_LIMIT)
    req = req if req.sort or not req.groups else AggRequest(req.measures, req.group_by, req.filter, req.having, [(g, True) for g in req.groups])
    out = _sorted(grouped(df, req), req).offset((page - 1) * limit)
    if count == "none":
        rows = out.limit(limit + 1).collect()
        return Page(df.sparkSession.createDataFrame(rows[:limit], out.schema), page, limit, 0, 0, len(rows) > limit, page > 1)
    total = count_groups(df, req)
    pages = max(1, math.ceil(total / limit))
    return Page(out.limit(limit), page, limit, total, pages, page < pages, page > 1)
