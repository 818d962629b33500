"""The workspace: a session, its tables, statements, presets, transactions and backups."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import DuplicateKeyError, LarkspurError, ReadOnlyError, UnknownTable
from larkspur.sources.store import Change, Delta, FileStore, MemoryStore
from larkspur.sources.tables import TableDef

#: Session settings by preset. All keep adaptive planning on; shuffle sizes follow the data.
PRESETS = {
    "production": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC"},
    "read_only": {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"},
    "test": {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC"},
}


def configure(spark: SparkSession, preset: str = "production") -> SparkSession:
    for k, v in PRESETS[preset].items():
        spark.conf.set(k, v)
    return spark


class Workspace:
    """Tables of one store. Inside transaction() writes are staged and seen by its own reads."""

    def __init__(
        self,
        spark: SparkSession,
        store: MemoryStore | FileStore | None = None,
        tables: Mapping[str, TableDef] | None = None,
        read_only: bool = False,
        clock: Callable[[], str] | None = None,
    ):
        self.spark, self.store, self.read_only = spark, store or MemoryStore(spark), read_only
        self.tables: dict[str, TableDef] = dict(tables or {})
        self._staged: dict[str, DataFrame | None] | None = None
        self._pending: dict[str, Change] = {}
        #: By table and name: what gives the changes of tables derived from it, as {name: (delta, all rows)}.
        self.derived: dict[str, dict[str, Callable[[Delta | None, DataFrame], Mapping]]] = {}
        self.clock = clock or (lambda: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))

    # ------------------------------------------------------------ tables

    def register(self, table: TableDef, df: DataFrame | None = None) -> TableDef:
        """Adds a definition, and its rows (in a file store: as a committed version)."""
        self.tables[table.name] = table
        if df is not None:
            self.put({table.name: df.select(*table.columns)})
        elif table.name not in self.store.names():
            self.put({table.name: self.spark.createDataFrame([], table.schema)})
        return table

    def view(self, name: str, df: DataFrame, pk: str) -> TableDef:
        """A read-only relation as a table."""
        table = TableDef.of(name, df, pk)
        self.tables[name] = table
        if isinstance(self.store, MemoryStore):
            self.store._tables[name] = df
        else:
            df.createOrReplaceTempView(name)
        return table

    def frame(self, name: str) -> DataFrame:
        if self._staged is not None and name in self._staged:
            if self._staged[name] is None:
                raise UnknownTable(name)
            return self._staged[name]
        if name in self.store.names():
            return self.store.read(name)
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise UnknownTable(name)

    def has(self, name: str) -> bool:
        """Whether a table is there, as this workspace's own reads see it."""
        if self._staged is not None and name in self._staged:
            return self._staged[name] is not None
        return name in self.store.names()

    def put(self, changed: Mapping[str, DataFrame | None], same_rows: bool = False) -> None:
        """Replaces tables (None: drops them), and, unless the rows are the same, what is derived from them."""
        todo: dict[str, tuple] = {n: (None, df) for n, df in changed.items()}
        for n, df in changed.items():
            for more in self.derived.get(n, {}).values() if df is not None and not same_rows else ():
                todo |= more(None, df)
        self._apply(todo)

    def change(self, name: str, delta: Delta, whole: DataFrame, key: str) -> None:
        """Changes a table: delta where the store keeps layers and the key allows it, else whole, its
        rows after the change; and what is derived from the table, in the same commit."""
        fits = self._fits(name, key if delta.gone is not None else None)
        todo: dict[str, tuple] = {name: (delta if fits else None, whole)}
        for more in self.derived.get(name, {}).values():
            todo |= more(delta, whole)
        self._apply(todo)

    def _fits(self, name: str, key: str | None) -> bool:
        if isinstance(self._pending.get(name), DataFrame):
            return False  # it is written whole anyway
        return self.store.takes_layers(name, key)

    def _apply(self, todo: Mapping[str, tuple[Delta | None, DataFrame | None]]) -> None:
        if self.read_only:
            raise ReadOnlyError("this workspace is read-only")
        if self._staged is None:
            self.store.commit({n: whole if d is None else [d] for n, (d, whole) in todo.items()}, self.store.version)
            return
        for n, (d, whole) in todo.items():
            self._staged[n] = whole
            before = self._pending.get(n, ())
            self._pending[n] = whole if d is None or isinstance(before, DataFrame) else [*(before or ()), d]

    # ------------------------------------------------------------ transactions

    @property
    def in_transaction(self) -> bool:
        return self._staged is not None

    @contextmanager
    def transaction(self) -> Iterator[Workspace]:
        """All or nothing: an exception discards what was staged. Nested transactions are refused."""
        if self._staged is not None:
            raise LarkspurError("nested transactions aren't supported")
        if self.read_only:
            raise ReadOnlyError("this workspace is read-only")
        seen, self._staged, self._pending = self.store.version, {}, {}
        try:
            yield self
            changed, self._staged = self._pending, None
            if changed:
                self.store.commit(changed, seen)
        finally:
            self._staged, self._pending = None, {}

    # ------------------------------------------------------------ statements

    def all(self, sql: str, params: list | Mapping | None = None) -> DataFrame:
        """Rows of a Spark SQL statement over the workspace's tables, as {name} in its text."""
        named = {n: self.frame(n) for n in self.tables if "{" + n + "}" in sql}
        return self.spark.sql(sql, args=params or None, **named)

    def get(self, sql: str, params: list | Mapping | None = None) -> dict | None:
        row = self.all(sql, params).limit(1).collect()
        return row[0].asDict(True) if row else None

    def run(self, sql: str, params: list | Mapping | None = None) -> None:
        if self.read_only:
            raise ReadOnlyError("this workspace is read-only")
        self.all(sql, params).collect()

    def exec(self, sql: str) -> None:
        """Runs a script of several statements, without parameters or rows."""
        from larkspur.migrations import split_statements

        for s in split_statements(sql):
            self.run(s)

    def close(self) -> None:
        """Forgets the workspace's tables and cached rows; the session belongs to its maker."""
        self._staged = None
        self.tables.clear()

    # ------------------------------------------------------------ backup

    def backup(self, destination: str) -> dict:
        """Copies every table's current snapshot below destination, which must not exist."""
        began, out = time.time(), {}
        for name in self.store.names():
            df = self.frame(name)
            df.write.mode("errorifexists").parquet(f"{destination.rstrip('/')}/{name}")
            out[name] = len(self.spark.read.parquet(f"{destination.rstrip('/')}/{name}").inputFiles())
        return {"destination": destination, "duration_ms": round(1000 * (time.time() - began)), "files_copied": sum(out.values()), "tables": out}

    # ------------------------------------------------------------ constraints

    def check_unique(self, table: TableDef, df: DataFrame, rows: list[Mapping[str, Any]] | None = None, columns: set[str] | None = None) -> None:
        """Raises if a unique key of df repeats. rows: the new rows, if only theirs can;
        columns: those that changed, if keys of others can't."""
        for key, predicate in table.unique_keys():
            if columns is not None and not columns & {*key}:
                continue
            part = df.where(F.expr(predicate)) if predicate else df
            for c in key:
                part = part.where(F.col(c).isNotNull())
            if rows is not None:
                values = [r[key[0]] for r in rows if r.get(key[0]) is not None]
                part = part.where(F.col(key[0]).isin(values)) if len(values) <= 1000 else part
            if not part.groupBy(*key).count().where("count > 1").isEmpty():
                raise DuplicateKeyError(table.name, key)
