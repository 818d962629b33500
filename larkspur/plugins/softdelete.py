"""Deletes as tombstones, hidden from reads."""

from __future__ import annotations

from larkspur.hooks import POLICY, READS
from larkspur.plans import filters as f
from larkspur.plans.compiler import Update, where


class SoftDelete:
    def __init__(self, field: str = "deletedAt", clock=None):
        self.field, self.clock = field, clock

    def apply(self, repo) -> None:
        clock = self.clock or repo.ws.clock

        def hide(ctx) -> None:
            if not ctx.options.get("include_deleted"):
                ctx.narrow(f.is_null(self.field))

        def bury(ctx) -> None:
            if ctx.options.get("mode") == "hard":
                return
            if ctx.op == "delete":
                repo.update(ctx.id, {self.field: clock()}, scope=ctx.filter)
                ctx.result = {"success": True, "message": "Soft deleted", "id": ctx.id, "soft": True}
            else:
                done = repo.update_many(f.and_(ctx.filter, f.is_null(self.field)) if not f.is_true(ctx.filter) else ctx.filter, {self.field: clock()})
                ctx.result = {"acknowledged": True, "deleted_count": done["matched_count"], "soft": True}
            ctx.done = True

        for op in READS:
            repo.hooks.on(f"before:{op}", hide, POLICY)
        for op in ("delete", "delete_many"):
            repo.hooks.on(f"before:{op}", bury, POLICY + 1)

        def restore(id_):
            """Takes the tombstone away; the row, or None if there is none."""
            ctx = repo._ctx("restore", id=id_)

            def run(c):
                mine = f.and_(f.eq(repo.id_field, id_), c.filter)
                if not repo._row(where(repo.df, mine)):
                    return None
                repo._change(mine, Update(unset=[self.field]))
                return repo._row(where(repo.df, mine))

            return repo.hooks.around(ctx, run)

        def get_deleted(flt=None, **paging):
            """A page of tombstoned rows."""
            return repo.get_all(f.and_(f.as_filter(flt), f.exists(self.field)), include_deleted=True, **paging)

        repo.restore, repo.get_deleted = restore, get_deleted
        repo.deleted_frame = lambda flt=None: repo.scoped("find_all", f.and_(f.as_filter(flt), f.exists(self.field)), include_deleted=True)
