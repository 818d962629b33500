"""Filters over streams. The data API has no stateful stream operators; what is compiled to columns
applies to a streaming DataFrame unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.operators.lookup import selected
from larkspur.plans.compiler import where


def live(stream: DataFrame, flt=None, select=None) -> DataFrame:
    """A streaming DataFrame filtered and cut to columns, as find_all() does for a table."""
    return where(stream, flt).select(*selected(select, stream.columns, stage="live"))
