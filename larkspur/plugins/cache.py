"""Results of reads, kept for a while and dropped by any change."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame

from larkspur.hooks import CACHE, WRITES
from larkspur.operators.paging import KeysetPage, Page


class MemoryCache:
    def __init__(self, clock=time.monotonic, most: int = 10_000):
        self._held: dict[str, tuple[float, Any]] = {}
        self._clock, self._most = clock, most

    def get(self, key: str) -> Any:
        until, value = self._held.get(key, (0.0, None))
        return value if until > self._clock() else None

    def set(self, key: str, value: Any, seconds: float) -> None:
        if len(self._held) >= self._most:
            self._held.pop(next(iter(self._held)))
        self._held[key] = (self._clock() + seconds, value)

    def delete_prefix(self, prefix: str) -> None:
        for k in [k for k in self._held if k.startswith(prefix)]:
            del self._held[k]


class Cache:
    OPS = ("get_all", "get_by_id", "get_one", "count", "exists", "distinct")

    def __init__(self, adapter: MemoryCache | None = None, seconds: float = 60):
        self.adapter, self.seconds, self.hits = adapter or MemoryCache(), seconds, 0

    def apply(self, repo) -> None:
        prefix = f"{repo.name}:"

        def key(ctx) -> str:
            told = {"op": ctx.op, "id": ctx.id, "filter": repr(ctx.filter), "options": {k: repr(v) for k, v in ctx.options.items() if k != "skip_cache"}}
            return prefix + json.dumps(told, sort_keys=True, default=repr)

        def before(ctx) -> None:
            if ctx.options.get("skip_cache"):
                return
            ctx.extra["cache_key"] = key(ctx)
            if (held := self.adapter.get(ctx.extra["cache_key"])) is not None:
                self.hits += 1
                ctx.result, ctx.done, ctx.extra["hit"] = held[0], True, True

        def after(ctx) -> None:
            if "cache_key" in ctx.extra and not ctx.extra.get("hit"):
                if isinstance(ctx.result, (Page, KeysetPage)):
                    # Pages are at most MOST_LIMIT rows: kept as rows, so a hit runs no job.
                    docs: DataFrame = ctx.result.docs
                    ctx.result.docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
                self.adapter.set(ctx.extra["cache_key"], (ctx.result,), self.seconds)

        for op in self.OPS:
            repo.hooks.on(f"before:{op}", before, CACHE)
            repo.hooks.on(f"after:{op}", after, CACHE)
        for op in WRITES:
            repo.hooks.on(f"after:{op}", lambda ctx: self.adapter.delete_prefix(prefix), CACHE)
        repo.invalidate_cache = lambda: self.adapter.delete_prefix(prefix)
