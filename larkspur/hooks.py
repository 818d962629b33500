"""Hooks around operations: before, after and error, by priority."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from larkspur.plans import filters as f

#: Lower runs first: scopes and stamps, then caches, then observers, then the rest.
POLICY, CACHE, OBSERVABILITY, DEFAULT = 100, 200, 300, 500

READS = ("get_all", "get_by_id", "get_one", "find_all", "count", "exists", "distinct", "aggregate", "aggregate_paginate", "lookup_populate", "search")
WRITES = ("create", "create_many", "upsert", "update", "update_many", "find_one_and_update", "increment", "delete", "delete_many", "bulk_write", "restore", "sweep")


@dataclass
class Context:
    """What an operation is about; before-hooks may change filter, data and update."""

    op: str
    filter: f.Filter = f.TRUE
    data: Any = None
    update: Any = None
    id: Any = None
    options: dict[str, Any] = field(default_factory=dict)
    result: Any = None
    done: bool = False  # a hook has set the result
    extra: dict[str, Any] = field(default_factory=dict)

    def narrow(self, more: f.Filter) -> None:
        self.filter = f.and_(self.filter, more)


class Hooks:
    def __init__(self) -> None:
        self._on: dict[str, list[tuple[int, int, Callable]]] = defaultdict(list)

    def on(self, event: str, run: Callable, priority: int = DEFAULT) -> None:
        """event: before:op, after:op or error:op."""
        self._on[event].append((priority, len(self._on[event]), run))
        self._on[event].sort(key=lambda x: x[:2])

    def emit(self, event: str, *args: Any) -> None:
        for _, _, run in self._on.get(event, ()):
            run(*args)

    def around(self, ctx: Context, run: Callable[[Context], Any]) -> Any:
        """The operation with its hooks; a result that a before-hook has set is used as it is."""
        try:
            self.emit(f"before:{ctx.op}", ctx)
            if not ctx.done:
                ctx.result = run(ctx)
        except Exception as e:
            self.emit(f"error:{ctx.op}", ctx, e)
            raise
        self.emit(f"after:{ctx.op}", ctx)
        return ctx.result
