"""Every read narrowed to a tenant, every new row stamped with it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from larkspur.errors import LarkspurError
from larkspur.hooks import POLICY, READS
from larkspur.plans import filters as f


class Tenancy:
    """resolve: the tenant of a context, or None; skip_when: contexts left alone.

    Without a tenant reads are refused, and writes too, unless every row carries its own and
    allow_data_injection is set."""

    SCOPED = (*READS, "update", "update_many", "find_one_and_update", "increment", "delete", "delete_many", "restore", "sweep")

    def __init__(self, field: str, resolve: Callable[[Any], Any], allow_data_injection: bool = False, skip_when: Callable[[Any], bool] | None = None):
        self.field, self.resolve, self.inject, self.skip = field, resolve, allow_data_injection, skip_when or (lambda ctx: False)

    def apply(self, repo) -> None:
        def scope(ctx) -> None:
            if self.skip(ctx):
                return
            if (tenant := self.resolve(ctx)) is None:
                raise LarkspurError(f"{ctx.op}: no tenant")
            ctx.narrow(f.eq(self.field, tenant))
            if ctx.op == "find_one_and_update":
                ctx.extra.setdefault("stamp", {})[self.field] = tenant

        def stamp(ctx) -> None:
            if self.skip(ctx):
                return
            rows, tenant = ctx.data if isinstance(ctx.data, list) else [ctx.data], self.resolve(ctx)
            if tenant is None:
                if not (self.inject and all(r.get(self.field) is not None for r in rows)):
                    raise LarkspurError(f"{ctx.op}: no tenant")
                return
            for r in rows:
                r[self.field] = tenant

        for op in self.SCOPED:
            repo.hooks.on(f"before:{op}", scope, POLICY)
        for op in ("create", "create_many", "upsert"):
            repo.hooks.on(f"before:{op}", stamp, POLICY)
