"""Ordered migrations over a workspace, index definitions, and a directory loader."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import types as T

from larkspur.errors import LarkspurError
from larkspur.sources.tables import ColumnDef, IndexDef, TableDef
from larkspur.sources.workspace import Workspace

# ---------------------------------------------------------------- indexes


def _identifier(name: str) -> str:
    if not name or any(c in name for c in '"`;\0'):
        raise LarkspurError(f"not an identifier: {name!r}")
    return name


def create_index(ws: Workspace, table: str, columns: Sequence[str], unique: bool = False, where: str | None = None, name: str | None = None, if_not_exists: bool = True) -> IndexDef:
    """Records an index. A unique one is enforced from now on, and checked against the rows there
    are; others are layout hints, for layout() below."""
    if not columns:
        raise LarkspurError("an index needs a column")
    index = IndexDef(_identifier(name or f"idx_{table}_{'_'.join(columns)}"), tuple(map(_identifier, columns)), unique, where)
    definition = ws.tables[_identifier(table)]
    for c in columns:
        if c not in definition.columns:
            raise LarkspurError(f"{table} has no column {c!r}")
    if any(i.name == index.name for i in definition.indexes):
        if if_not_exists:
            return index
        raise LarkspurError(f"index {index.name} exists")
    changed = definition.with_index(index)
    if unique:
        ws.check_unique(changed, ws.frame(table), columns={*columns})
    ws.tables[table] = changed
    return index


def drop_index(ws: Workspace, name: str, if_exists: bool = True) -> bool:
    for table, definition in ws.tables.items():
        if any(i.name == name for i in definition.indexes):
            ws.tables[table] = definition.without_index(name)
            return True
    if not if_exists:
        raise LarkspurError(f"no index {name!r}")
    return False


def reindex(ws: Workspace, table: str | None = None, index: str | None = None, collation: str | None = None) -> list[str]:
    """Rewrites tables in the order of their indexes; the tables rewritten."""
    if sum(x is not None for x in (table, index, collation)) > 1:
        raise LarkspurError("reindex takes one of table, index, collation")
    names = [t for t, d in ws.tables.items() if (table in (None, t)) and (index is None or any(i.name == index for i in d.indexes))]
    out = {}
    for t in names:
        hints = [c for i in ws.tables[t].indexes if index in (None, i.name) for c in i.columns]
        if hints:
            # Rows sorted by the indexed columns let scans skip by the files' minima and maxima.
            out[t] = ws.frame(t).repartitionByRange(*dict.fromkeys(hints)).sortWithinPartitions(*dict.fromkeys(hints))
    if out:
        ws.put(out, same_rows=True)
    return list(out)


def list_indexes(ws: Workspace, table: str) -> list[dict]:
    d = ws.tables[table]
    auto = [IndexDef(f"auto_{table}_{'_'.join(c)}", tuple(c), True, None, True) for c in ((d.pk,), *d.unique)]

    def told(i: IndexDef) -> dict:
        columns = [{"name": c, "desc": False} for c in i.columns]
        return {"name": i.name, "table": table, "unique": i.unique, "auto": i.auto, "columns": columns} | ({"partial_where": i.where} if i.where else {})

    return [told(i) for i in (*auto, *d.indexes)]


def soft_delete_index(table: str, columns: Sequence[str], field: str = "deletedAt") -> dict:
    """Arguments of create_index() for an index over rows that aren't deleted."""
    return {"table": table, "columns": tuple(columns), "where": f"`{_identifier(field)}` IS NULL", "name": f"idx_{table}_live_{'_'.join(columns)}"}


def ttl_index(table: str, field: str = "expiresAt") -> dict:
    return {"table": table, "columns": (field,), "where": f"`{_identifier(field)}` IS NOT NULL", "name": f"idx_{table}_{field}_ttl"}


# ---------------------------------------------------------------- migrations


@dataclass(frozen=True)
class Migration:
    name: str
    up: Callable[[Workspace], None]
    down: Callable[[Workspace], None] | None = None


def split_statements(sql: str) -> list[str]:
    """Statements of a script: parted by semicolons outside quotes, comments and BEGIN ... END."""
    out, part, quote, depth, i = [], [], "", 0, 0
    while i < len(sql):
        c = sql[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif sql.startswith("--", i):
            i = sql.find("\n", i)
            if i < 0:
                break
            continue
        elif sql.startswith("/*", i):
            i = sql.find("*/", i) + 2
            if i < 2:
                break
            continue
        elif (m := re.compile(r"\b(BEGIN|CASE|END)\b", re.I).match(sql, i)) and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            depth = max(0, depth + (-1 if m[1].upper() == "END" else 1))
            part.append(m[1])
            i = m.end()
            continue
        if c == ";" and not quote and not depth:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(c)
        i += 1
    return [s for s in [*out, "".join(part).strip()] if s]


def sql_migration(name: str, up: str, down: str | None = None) -> Migration:
    """A migration of Spark SQL statements."""
    runner = lambda sql: lambda ws: [ws.run(s) for s in split_statements(sql)] and None
    return Migration(name, runner(up), runner(down) if down else None)


def load_directory(folder: str, down_folder: str | None = None, dialect: str = "spark") -> list[Migration]:
    """Migrations of meta/_journal.json in the order of its idx, each <tag>.sql."""
    journal = json.loads((Path(folder) / "meta/_journal.json").read_text())
    if journal.get("dialect", dialect) != dialect:
        raise LarkspurError(f"the journal's dialect is {journal['dialect']}, not {dialect}")
    out = []
    for e in sorted(journal["entries"], key=lambda e: e["idx"]):
        up = Path(folder) / f"{e['tag']}.sql"
        if not up.exists():
            raise LarkspurError(f"{up} is missing")
        undo = Path(down_folder) / f"{e['tag']}.sql" if down_folder else None
        out.append(sql_migration(e["tag"], up.read_text(), undo.read_text() if undo and undo.exists() else None))
    return out


class Migrator:
    """Applies migrations in the order given, each in a transaction with its tracking row."""

    def __init__(self, ws: Workspace, migrations: Sequence[Migration], table: str = "_migrations"):
        self.ws, self.migrations, self.table = ws, list(migrations), table
        self._def = TableDef(table, {"position": ColumnDef(T.LongType(), False), "name": ColumnDef(T.StringType(), False), "applied_at": ColumnDef(T.StringType(), False)}, "name")

    def _applied(self) -> list[Mapping]:
        if self.table not in self.ws.tables:
            self.ws.register(self._def)
        return [r.asDict() for r in self.ws.frame(self.table).orderBy("position").collect()]

    def _track(self, rows: list[Mapping]) -> None:
        self.ws.put({self.table: self._def.frame(self.ws.spark, rows)})

    def up(self) -> list[str]:
        applied, done = self._applied(), []
        for m in self.migrations:
            if m.name in {r["name"] for r in applied}:
                continue
            with self.ws.transaction():
                m.up(self.ws)
                applied = [*applied, {"position": len(applied), "name": m.name, "applied_at": self.ws.clock()}]
                self._track(applied)
            done.append(m.name)
        return done

    def down(self, target: str | None) -> list[str]:
        """Undoes from the last on until target is the last applied; None undoes all."""
        applied, done = self._applied(), []
        if target is not None and target not in {r["name"] for r in applied}:
            raise LarkspurError(f"{target} isn't applied")
        while applied and applied[-1]["name"] != target:
            name = applied[-1]["name"]
            m = next((m for m in self.migrations if m.name == name), None)
            if m is None or m.down is None:
                raise LarkspurError(f"{name} can't be undone: " + ("it isn't among the migrations" if m is None else "it has no down"))
            with self.ws.transaction():
                m.down(self.ws)
                applied = applied[:-1]
                self._track(applied)
            done.append(name)
        return done

    def status(self) -> list[dict]:
        at = {r["name"]: r["applied_at"] for r in self._applied()}
        return [{"name": m.name, "applied": m.name in at, **({"applied_at": at[m.name]} if m.name in at else {})} for m in self.migrations]

    def latest(self) -> str | None:
        applied = self._applied()
        return applied[-1]["name"] if applied else None
