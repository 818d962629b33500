"""Created and updated stamps."""

from __future__ import annotations

from larkspur.hooks import POLICY


class Timestamps:
    def __init__(self, created: str = "createdAt", updated: str = "updatedAt", clock=None):
        self.created, self.updated, self.clock = created, updated, clock

    def apply(self, repo) -> None:
        clock = self.clock or repo.ws.clock
        has = repo.table.columns

        def stamp(row: dict, now: str) -> None:
            if self.created in has and row.get(self.created) is None:
                row[self.created] = now
            if self.updated in has and row.get(self.updated) is None:
                row[self.updated] = row.get(self.created, now)

        def on_create(ctx) -> None:
            now = clock()
            for row in ctx.data if isinstance(ctx.data, list) else [ctx.data]:
                stamp(row, now)

        def on_update(ctx) -> None:
            if self.updated in has:
                ctx.update = ctx.update.plus(**{self.updated: clock()})
            if ctx.op == "find_one_and_update" and self.created in has:
                ctx.update.set_on_insert.setdefault(self.created, clock())

        for op in ("create", "create_many", "upsert"):
            repo.hooks.on(f"before:{op}", on_create, POLICY)
        for op in ("update", "update_many", "find_one_and_update", "increment"):
            repo.hooks.on(f"before:{op}", on_update, POLICY)
