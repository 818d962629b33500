"""Exact nearest neighbours by cosine, l2, l1 or hamming distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import LarkspurError

METRICS = ("cosine", "l2", "l1", "hamming")
MOST_DIMS = 4096
#: Up to so many dimensions the sums are written out, element by element.
WRITTEN_OUT = 256


def distance(embedding: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """The distance of an array column to a literal vector, in doubles, summed in order. Up to
    WRITTEN_OUT dimensions it is straight-line arithmetic that stays in generated code."""
    if metric not in METRICS:
        raise LarkspurError(f"no metric {metric!r}; one of {', '.join(METRICS)}")
    values = [float(x) for x in query]
    if len(values) <= WRITTEN_OUT:
        pairs = [(F.get(embedding, F.lit(i)).cast("double"), F.lit(x)) for i, x in enumerate(values)]
        total = lambda one: reduce(add, (one(a, b) for a, b in pairs), F.lit(0.0))
    else:
        e, q = embedding.cast("array<double>"), F.array(*map(F.lit, values))
        total = lambda one: F.aggregate(F.zip_with(e, q, one), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        norm = sum(x * x for x in values) ** 0.5
        return 1 - total(lambda a, b: a * b) / (F.sqrt(total(lambda a, b: a * a)) * F.lit(norm))
    if metric == "l2":
        return F.sqrt(total(lambda a, b: (a - b) * (a - b)))
    if metric == "l1":
        return total(lambda a, b: F.abs(a - b))
    return total(lambda a, b: F.when(a != b, 1.0).otherwise(0.0))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_: str = "rowid", embedding: str = "embedding") -> DataFrame:
    """The k rows of least distance as (id, distance); ties by id. Each task keeps k rows."""
    rows = vectors.where(F.col(embedding).isNotNull()).select(id_, distance(F.col(embedding), query, metric).alias("distance"))
    return rows.orderBy(F.col("distance").asc_nulls_last(), id_).limit(k)
