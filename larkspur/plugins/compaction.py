"""Compaction: fewer, larger files per table, and old versions removed."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from larkspur.errors import LarkspurError
from larkspur.hooks import DEFAULT, WRITES


class Compaction:
    """mode: manual; scheduled (every interval seconds); auto (after every `every` writes)."""

    def __init__(self, mode: str = "manual", interval: float = 6 * 3600, every: int = 1000, keep: int = 1, on_event: Callable[[dict], None] | None = None):
        if mode not in ("manual", "scheduled", "auto"):
            raise LarkspurError(f"no mode {mode!r}")
        self.mode, self.interval, self.every, self.keep, self.on_event = mode, interval, every, keep, on_event or (lambda e: None)
        self._stop, self._writes = threading.Event(), 0

    def apply(self, repo) -> None:
        def tell(kind: str, **more) -> None:
            self.on_event({"event": kind, "mode": self.mode, **more})

        def vacuum(files: int | None = None) -> dict:
            """Rewrites the table (into that many files, else as adaptive planning sizes them), then
            removes versions that nobody reads."""
            began = time.time()
            tell("started")
            try:
                df = repo.df
                repo.ws.put({repo._name: df.coalesce(files) if files else df.hint("rebalance")}, same_rows=True)
                out = repo.ws.store.compact(self.keep)
            except Exception as e:
                tell("error", error=str(e))
                raise
            tell("completed", duration_ms=round(1000 * (time.time() - began)), **out)
            return out

        def incremental_vacuum(keep: int | None = None) -> dict:
            """Removes old versions only."""
            return repo.ws.store.compact(keep or self.keep)

        repo.vacuum, repo.incremental_vacuum, repo.stop_vacuum = vacuum, incremental_vacuum, self._stop.set
        if self.mode == "auto":

            def after(ctx) -> None:
                self._writes += 1
                if self._writes % self.every == 0 and not repo.ws.in_transaction:
                    incremental_vacuum()

            for op in WRITES:
                repo.hooks.on(f"after:{op}", after, DEFAULT)
        if self.mode == "scheduled":

            def loop() -> None:
                while not self._stop.wait(self.interval):
                    if not repo.ws.in_transaction:
                        vacuum()

            threading.Thread(target=loop, daemon=True).start()
