"""Lookups: related rows as a struct (to one) or an array of structs (to many).

The base is filtered, sorted and paged before anything is joined, since lookups neither add
nor drop base rows. A page's rows, MOST_LIMIT at most, are fetched first, so that its keys
reach the related tables' scans as a pushed filter. To-many sides are aggregated on their
own, so several lookups never multiply each other; a to-one side is reduced to its first
match, unless its key is declared unique: first by the related table's primary key, and where
it has none by its columns in order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import LarkspurError
from larkspur.operators.paging import Page, offset_frame, offset_page
from larkspur.plans.compiler import quoted, resolve, sort_keys, where

MOST_LOOKUPS = 10


@dataclass(frozen=True)
class Lookup:
    """strict: a to-one lookup takes the first match, by the related table's key; else all."""

    from_: str
    local_field: str
    foreign_field: str
    as_: str | None = None
    single: bool = False
    where: Any = None
    select: Any = None
    strict: bool = True

    @property
    def key(self) -> str:
        return self.as_ or self.from_

    @classmethod
    def of(cls, x: Lookup | Mapping) -> Lookup:
        if isinstance(x, Lookup):
            return x
        names = {"from": "from_", "as": "as_", "localField": "local_field", "foreignField": "foreign_field"}
        return cls(**{names.get(k, k): v for k, v in x.items()})


@dataclass(frozen=True)
class Related:
    """How lookups reach other tables: their rows by name, whether a field of theirs has one row per
    value at most, and their primary key, if there is one."""

    frame: Callable[[str], DataFrame]
    unique: Callable[[str, str], bool]
    key: Callable[[str], str | None]


def selected(select: Any, columns: Sequence[str], pk: str | None = None, stage: str = "lookup") -> list[str]:
    """Column names of a list or inclusion map; nothing selects all; pk is always among them."""
    if isinstance(select, Mapping):
        if select and not any(select.values()):
            raise LarkspurError(f"{stage}: a select that only excludes isn't supported")
        select = [k for k, v in select.items() if v]
    names = list(select or columns)
    for n in names:
        if n not in columns:
            resolve(T.StructType([T.StructField(c, T.StringType()) for c in columns]), n, stage)
    return names if pk is None or pk in names else [pk, *names]


def validate(lookups: Sequence[Lookup | Mapping], base: DataFrame) -> list[Lookup]:
    out = []
    for x in lookups:
        if isinstance(x, Mapping) and not {"from", "from_"} & {*x}:
            raise LarkspurError("lookup: from is required")
        try:
            out.append(Lookup.of(x))
        except TypeError as e:
            raise LarkspurError(f"lookup: local_field and foreign_field are required ({e})") from e
    if not 1 <= len(out) <= MOST_LOOKUPS:
        raise LarkspurError(f"lookup: from 1 to {MOST_LOOKUPS} lookups, not {len(out)}")
    keys = [x.key for x in out]
    if len({*keys}) < len(keys):
        raise LarkspurError("lookup: two lookups write to the same key; name them by as_")
    for x in out:
        if not (x.from_ and x.local_field and x.foreign_field):
            raise LarkspurError("lookup: from, local_field and foreign_field are required")
        resolve(base.schema, x.local_field, "lookup")
    return out


def populate(base: DataFrame, lookups: Sequence[Lookup], related: Related, keys: Sequence[list] | None = None) -> DataFrame:
    """base with a column per lookup. keys: for each lookup the only values that base has."""
    names = base.columns
    local = {f"_l{i}": x.local_field for i, x in enumerate(lookups)}
    out = base.select(*[quoted(c) for c in names], *[quoted(c).alias(k) for k, c in local.items()])
    for i, x in enumerate(lookups):
        foreign = where(related.frame(x.from_), x.where)
        resolve(foreign.schema, x.foreign_field, "lookup")
        fields = selected(x.select, foreign.columns)
        payload = F.struct(*[quoted(c).alias(c) for c in fields])
        side = foreign.where(quoted(x.foreign_field).isNotNull())
        if keys is not None:
            side = side.where(quoted(x.foreign_field).isin(keys[i]) if keys[i] else F.lit(False))
        key, made = f"_f{i}", f"_p{i}"
        if x.single and (not x.strict or related.unique(x.from_, x.foreign_field)):
            side = side.select(quoted(x.foreign_field).alias(key), payload.alias(made))
        elif x.single:
            # The first match: min over structs is one partial aggregation. Ties of the key go by the
            # selected columns, so that no others are read.
            pk = related.key(x.from_)
            plain = [c for c in ([pk, *fields] if pk in foreign.columns else foreign.columns) if not isinstance(foreign.schema[c].dataType, T.MapType)]
            rank = F.struct(*[quoted(c).alias(f"o{n}") for n, c in enumerate(plain)])
            side = side.groupBy(quoted(x.foreign_field).alias(key)).agg(F.min(F.struct(rank.alias("r"), payload.alias("p"))).alias("m")).select(key, F.col("m.p").alias(made))
        else:
            side = side.groupBy(quoted(x.foreign_field).alias(key)).agg(F.array_sort(F.collect_list(payload)).alias(made))
        out = out.join(side, F.col(f"_l{i}") == F.col(key), "left").drop(key)
        if x.single:
            # A match whose selected fields are all null counts as none.
            empty = F.lit(True)
            for c in fields:
                empty = empty & F.col(made)[c].isNull()
            out = out.withColumn(made, F.when(~F.coalesce(empty, F.lit(True)), F.col(made)))
        else:
            out = out.withColumn(made, F.coalesce(made, F.array().cast(out.schema[made].dataType)))
    return out.select(*[quoted(c) for c in names], *[F.col(f"_p{i}").alias(x.key) for i, x in enumerate(lookups)])


def lookup_page(
    base: DataFrame,
    lookups: Sequence[Lookup | Mapping],
    related: Related,
    pk: str,
    flt: Any = None,
    sort: Any = None,
    select: Any = None,
    page: Any = 1,
    limit: Any = None,
    count: str = "exact",
) -> Page:
    specs = validate(lookups, base)
    keys = sort_keys(sort, pk)
    paged = offset_page(where(base, flt), keys, pk, page, limit, count, least_pages=1)
    names = selected(select, base.columns, pk)
    need = [*names, *[x.local_field for x in specs if x.local_field not in names], *[k for k, _ in keys if k not in names]]
    rows = paged.docs.select(*[quoted(c) for c in dict.fromkeys(need)])
    fetched = rows.collect()
    cut = base.sparkSession.createDataFrame(fetched, rows.schema)
    values = [sorted({r[x.local_field] for r in fetched if r[x.local_field] is not None}) for x in specs]
    out = populate(cut, specs, related, values)
    paged.docs = offset_frame(out, keys, pk, 1, paged.limit).select(*[quoted(c) for c in names], *[quoted(x.key) for x in specs])
    return paged


def lookup_frame(base: DataFrame, lookups: Sequence[Lookup | Mapping], related: Related, pk: str, flt: Any = None, select: Any = None) -> DataFrame:
    """All base rows with their lookups, lazily."""
    specs = validate(lookups, base)
    names = selected(select, base.columns, pk)
    rows = where(base, flt).select(*[quoted(c) for c in dict.fromkeys([*names, *[x.local_field for x in specs]])])
    return populate(rows, specs, related).select(*[quoted(c) for c in names], *[quoted(x.key) for x in specs])

