"""Rows that expire: hidden from reads, and swept now, on a schedule or when rows are added."""

from __future__ import annotations

import threading

from larkspur.errors import LarkspurError
from larkspur.functions.columns import sql_literal
from larkspur.hooks import DEFAULT, POLICY, READS
from larkspur.plans import filters as f


class Expiry:
    """field: an ISO-8601 text or timestamp. Without seconds it is when a row ends; with them, what
    they are counted from. A row without it never expires. mode: scheduled, trigger or lazy."""

    def __init__(self, field: str = "expiresAt", seconds: float = 0, mode: str = "lazy", interval: float = 60, clock=None):
        if mode not in ("scheduled", "trigger", "lazy"):
            raise LarkspurError(f"no mode {mode!r}")
        self.field, self.seconds, self.mode, self.interval, self.clock = field, seconds, mode, interval, clock
        self._stop = threading.Event()

    def expired(self, now: str) -> f.Filter:
        at = f"try_cast(`{self.field}` AS timestamp) + make_dt_interval(0, 0, 0, {float(self.seconds):.6f})"
        return f.raw(f"coalesce({at} <= cast({sql_literal(now)} AS timestamp), false)")

    def apply(self, repo) -> None:
        clock = self.clock or repo.ws.clock

        def hide(ctx) -> None:
            if not ctx.options.get("include_expired"):
                ctx.narrow(f.not_(self.expired(clock())))

        for op in READS:
            repo.hooks.on(f"before:{op}", hide, POLICY)

        def sweep_expired() -> int:
            """Removes what has expired; how many rows that were."""
            ctx = repo._ctx("sweep", self.expired(clock()))
            return repo.hooks.around(ctx, lambda c: repo._remove(c.filter))

        def get_expired(flt=None, **paging):
            return repo.get_all(f.and_(f.as_filter(flt), self.expired(clock())), include_expired=True, **paging)

        repo.sweep_expired, repo.get_expired, repo.stop_ttl = sweep_expired, get_expired, self._stop.set
        repo.expired_frame = lambda flt=None: repo.scoped("find_all", f.and_(f.as_filter(flt), self.expired(clock())), include_expired=True)
        if self.mode == "trigger":
            for op in ("create", "create_many"):
                repo.hooks.on(f"before:{op}", lambda ctx: sweep_expired(), DEFAULT)
        if self.mode == "scheduled":

            def loop() -> None:
                while not self._stop.wait(self.interval):
                    if not repo.ws.in_transaction:
                        sweep_expired()

            threading.Thread(target=loop, daemon=True).start()


