"""An entry for every change."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from larkspur.hooks import OBSERVABILITY
from larkspur.sources.store import Delta

SCHEMA = "resource string, action string, timestamp string, document_id string, actor_id string, organization_id string, after string"


class Audit:
    """sink: takes each entry; entries are kept and offered as a DataFrame either way. The driver
    holds up to `most` of them; older ones are moved to the table <resource>_audit."""

    ACTIONS = ("create", "update", "delete", "restore", "find_one_and_update")

    def __init__(
        self,
        sink: Callable[[dict], None] | None = None,
        actor: Callable[[], Any] | None = None,
        organization: Callable[[], Any] | None = None,
        include_after: bool = True,
        metadata: Callable[[Any], dict] | None = None,
        clock=None,
        most: int = 100_000,
    ):
        self.sink, self.actor, self.organization = sink, actor, organization
        self.include_after, self.metadata, self.clock, self.most = include_after, metadata, clock, most
        self.entries: list[dict] = []

    def apply(self, repo) -> None:
        import json

        clock = self.clock or repo.ws.clock

        def note(ctx) -> None:
            row = ctx.result if isinstance(ctx.result, dict) else None
            if ctx.op in ("update", "find_one_and_update", "restore") and row is None:
                return
            id_ = ctx.id if ctx.id is not None else (row or {}).get(repo.id_field)
            entry = {"resource": repo.name, "action": ctx.op, "timestamp": clock()}
            if id_ is not None:
                entry["document_id"] = str(id_)
            if self.metadata:
                entry["metadata"] = self.metadata(ctx)
            if self.include_after and row is not None and ctx.op != "delete":
                entry["after"] = row
            if self.actor and (a := self.actor()) is not None:
                entry["actor_id"] = a
            if self.organization and (o := self.organization()) is not None:
                entry["organization_id"] = o
            self.entries.append(entry)
            if self.sink:
                self.sink(entry)
            if len(self.entries) > self.most and not repo.ws.in_transaction:
                spill()

        for op in self.ACTIONS:
            repo.hooks.on(f"after:{op}", note, OBSERVABILITY)

        kept = f"{repo.name}_audit"

        def held():
            keys = ("resource", "action", "timestamp", "document_id", "actor_id", "organization_id")
            return repo.ws.spark.createDataFrame([(*(e.get(k) for k in keys), json.dumps(e["after"], default=str, sort_keys=True) if "after" in e else None) for e in self.entries], SCHEMA)

        def spill() -> None:
            if repo.ws.has(kept):
                repo.ws.change(kept, Delta(held()), repo.ws.frame(kept).unionByName(held()), "document_id")
            else:
                repo.ws.put({kept: held()})
            self.entries.clear()

        def frame():
            return repo.ws.frame(kept).unionByName(held()) if repo.ws.has(kept) else held()

        repo.audit_frame = frame
