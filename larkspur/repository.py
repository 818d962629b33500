"""The repository: CRUD, paging, aggregation, lookups and bulk writes on one table, with hooks.

Reads that return many rows return lazy DataFrames; pages and single rows are the only
places that run jobs. A write hands the store the rows that come and the keys that go, and the
table after it as a lazy DataFrame: a projection for updates, a filter for deletes, a union for
inserts. Stores in files write the former, as a layer; constraints are checked before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import ConstraintError, DuplicateKeyError, LarkspurError
from larkspur.functions.columns import literal
from larkspur.hooks import Context, Hooks
from larkspur.operators import aggregate as agg
from larkspur.operators import explain as _explain
from larkspur.operators import lookup as lk
from larkspur.operators import paging
from larkspur.plans import filters as f
from larkspur.plans.compiler import Update, compile_filter, ordering, quoted, resolve, sort_keys, where, with_tiebreak
from larkspur.sources.store import Delta
from larkspur.sources.tables import TableDef
from larkspur.sources.workspace import Workspace


def is_duplicate_key_error(e: BaseException) -> bool:
    return isinstance(e, DuplicateKeyError) or "duplicate key" in str(e).lower()


class Repository:
    def __init__(self, ws: Workspace, table: TableDef | str, plugins: Sequence[Any] = (), id_field: str | None = None, name: str | None = None, registry: Mapping[str, DataFrame] | None = None):
        self.ws = ws
        self._name = table if isinstance(table, str) else table.name
        if isinstance(table, TableDef) and table.name not in ws.tables:
            ws.register(table)
        self.name, self.registry, self.hooks = name or self._name, dict(registry or {}), Hooks()
        self.id_field = id_field or self.table.pk
        if self.id_field not in self.table.columns:
            raise LarkspurError(f"{self._name} has no column {self.id_field!r}")
        self.plugins = list(plugins)
        for p in self.plugins:
            p.apply(self)

    # ------------------------------------------------------------ plumbing

    @property
    def table(self) -> TableDef:
        return self.ws.tables[self._name]

    @property
    def df(self) -> DataFrame:
        return self.ws.frame(self._name)

    def _merge(self, whole: DataFrame, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """whole: the table with rows in place of those whose keys are gone."""
        self.ws.change(self._name, Delta(rows, gone), whole, self.table.pk)

    def _ctx(self, op: str, flt: Any = None, **more: Any) -> Context:
        return Context(op, f.as_filter(flt), **more)

    def _by_id(self, id_: Any) -> f.Filter:
        return f.eq(self.id_field, id_)

    def _row(self, df: DataFrame) -> dict | None:
        rows = df.limit(1).collect()
        return rows[0].asDict(True) if rows else None

    def _ordered(self, df: DataFrame, sort: Any) -> DataFrame:
        return df.orderBy(*ordering(with_tiebreak(sort_keys(sort, self.id_field), self.id_field), df.schema))

    def scoped(self, op: str, flt: Any = None, **options: Any) -> DataFrame:
        """The rows that an operation would see, lazily, after its before-hooks."""
        ctx = self._ctx(op, flt, options=options)
        self.hooks.emit(f"before:{op}", ctx)
        return where(self.df, ctx.filter)

    # ------------------------------------------------------------ reads

    def get_by_id(self, id_: Any, scope: Any = None, **options: Any) -> dict | None:
        return self.hooks.around(self._ctx("get_by_id", scope, id=id_, options=options), lambda c: self._row(where(self.df, f.and_(self._by_id(id_), c.filter))))

    def get_one(self, flt: Any = None, sort: Any = None, **options: Any) -> dict | None:
        return self.hooks.around(self._ctx("get_one", flt, options=options | {"sort": sort}), lambda c: self._row(self._ordered(where(self.df, c.filter), sort)))

    get_by_query = get_one

    def get_by_slug(self, slug: str, field: str = "slug", **options: Any) -> dict | None:
        resolve(self.df.schema, field, "get_by_slug")
        return self.get_one(f.eq(field, slug), **options)

    def find_all(self, flt: Any = None, sort: Any = None, **options: Any) -> DataFrame:
        """All matching rows, lazily."""
        run = lambda c: self._ordered(where(self.df, c.filter), sort) if sort else where(self.df, c.filter)
        return self.hooks.around(self._ctx("find_all", flt, options=options | {"sort": sort}), run)

    def count(self, flt: Any = None, **options: Any) -> int:
        return self.hooks.around(self._ctx("count", flt, options=options), lambda c: where(self.df, c.filter).count())

    def exists(self, flt: Any = None, **options: Any) -> bool:
        return self.hooks.around(self._ctx("exists", flt, options=options), lambda c: not where(self.df, c.filter).limit(1).isEmpty())

    def distinct_frame(self, field: str, flt: Any = None, **options: Any) -> DataFrame:
        resolve(self.df.schema, field, "distinct")
        return self.scoped("distinct", flt, **options).select(quoted(field)).distinct()

    def distinct(self, field: str, flt: Any = None, limit: int | None = None, offset: int = 0, **options: Any) -> list:
        """The distinct values as a list, all or a page of them in order; distinct_frame() for more
        than a driver holds."""
        resolve(self.df.schema, field, "distinct")

        def run(c: Context) -> list:
            values = where(self.df, c.filter).select(quoted(field)).distinct()
            if limit is not None or offset:
                values = values.orderBy(quoted(field).asc_nulls_first()).offset(offset)
                values = values if limit is None else values.limit(limit)
            return [r[0] for r in values.collect()]

        return self.hooks.around(self._ctx("distinct", flt, options=options | {"field": field, "limit": limit, "offset": offset}), run)

    def get_all(
        self,
        filters: Any = None,
        sort: Any = None,
        page: Any = 1,
        limit: Any = None,
        count: str = "exact",
        after: str | None = None,
        select: Any = None,
        filter: Any = None,
        keyset: bool = False,
        search: str | None = None,
        **options: Any,
    ):
        """A page: by offset, or by keyset where a cursor or keyset=True is given."""
        flt = f.merge(filters, filter)

        def run(c: Context):
            rows = where(self.df, c.filter)
            if search is not None:
                rows = self.search_frame(search).join(rows, self.id_field, "left_semi")
            keys = sort_keys(sort, self.id_field)
            if after is not None or keyset:
                out = paging.keyset_page(rows, keys, self.id_field, after, limit)
            else:
                out = paging.offset_page(rows, keys, self.id_field, page, limit, count)
            if select:
                out.docs = out.docs.select(*lk.selected(select, self.df.columns, self.id_field, "select"))
            return out

        asked = {"sort": sort, "page": page, "limit": limit, "after": after, "count": count, "select": select, "search": search, "keyset": keyset}
        return self.hooks.around(self._ctx("get_all", flt, options=options | asked), run)

    def stream(self, flt: Any = None, sort: Any = None, limit: Any = None, **options: Any) -> Iterator[paging.KeysetPage]:
        """Keyset pages one after another."""
        cursor = None
        while True:
            page = self.get_all(flt, sort, limit=limit, after=cursor, keyset=True, **options)
            yield page
            if not page.has_more:
                return
            cursor = page.next

    def aggregate(self, req: agg.AggRequest | Mapping, **options: Any) -> DataFrame:
        req = req if isinstance(req, agg.AggRequest) else agg.AggRequest(**req)
        return self.hooks.around(self._ctx("aggregate", req.filter, options=options | {"request": req}), lambda c: agg.aggregate(self.df, _refiltered(req, c)))

    def aggregate_paginate(self, req: agg.AggRequest | Mapping, page: Any = 1, limit: Any = None, count: str = "exact", **options: Any) -> paging.Page:
        req = req if isinstance(req, agg.AggRequest) else agg.AggRequest(**req)
        run = lambda c: agg.aggregate_page(self.df, _refiltered(req, c), page, limit, count)
        return self.hooks.around(self._ctx("aggregate_paginate", req.filter, options=options | {"request": req, "page": page, "limit": limit}), run)

    @property
    def _related(self) -> lk.Related:
        known = lambda name: None if name in self.registry else self.ws.tables.get(name)
        return lk.Related(
            frame=lambda name: self.registry[name] if name in self.registry else self.ws.frame(name),
            unique=lambda name, field: (t := known(name)) is not None and (field == t.pk or (field,) in t.unique),
            key=lambda name: (t := known(name)) and t.pk,
        )

    def lookup_populate(self, lookups: Sequence[Any], filters: Any = None, sort: Any = None, select: Any = None, page: Any = 1, limit: Any = None, count: str = "exact", **options: Any) -> paging.Page:
        run = lambda c: lk.lookup_page(self.df, lookups, self._related, self.id_field, c.filter, sort, select, page, limit, count)
        return self.hooks.around(self._ctx("lookup_populate", filters, options=options | {"lookups": lookups, "sort": sort, "page": page, "limit": limit, "select": select}), run)

    def lookup_frame(self, lookups: Sequence[Any], filters: Any = None, select: Any = None, **options: Any) -> DataFrame:
        """All rows with their lookups, lazily."""
        run = lambda c: lk.lookup_frame(self.df, lookups, self._related, self.id_field, c.filter, select)
        return self.hooks.around(self._ctx("lookup_populate", filters, options=options | {"lookups": lookups, "select": select}), run)

    def explain(self, flt: Any = None, aggregate: agg.AggRequest | None = None) -> list[dict]:
        """The plan of the matching rows, or of an aggregation over them, as rows."""
        rows = where(self.df, flt)
        return _explain.explain_rows(rows if aggregate is None else agg.aggregate(rows, aggregate))

    def prepared(self, name: str, build: Callable[..., DataFrame] | str) -> Prepared:
        """A named query, ready to run with parameters: Spark SQL over {table}, or a function of them."""
        if not name:
            raise LarkspurError("a prepared query needs a name")
        if not (callable(build) or isinstance(build, str) and build.strip()):
            raise LarkspurError("a prepared query is SQL text or a function that returns a DataFrame")
        return Prepared(self, name, build)

    def search_frame(self, query: str) -> DataFrame:
        raise LarkspurError("search needs the full-text plugin")

    # ------------------------------------------------------------ inserts

    def _insert(self, rows: Sequence[Mapping[str, Any]]) -> list[dict]:
        t, df = self.table, self.df
        whole = [t.complete(r) for r in rows]
        if t.autoincrement and any(r[t.pk] is None for r in whole):
            top = df.agg(F.max(quoted(t.pk))).first()[0] or 0
            top = max([top, *(r[t.pk] for r in whole if r[t.pk] is not None)])
            for r in whole:
                if r[t.pk] is None:
                    top += 1
                    r[t.pk] = top
        fresh = t.frame(self.ws.spark, whole)
        new = df.unionByName(fresh)
        self.ws.check_unique(t, new, whole)
        self._merge(new, fresh)
        return whole

    def create(self, data: Mapping[str, Any], **options: Any) -> dict:
        return self.hooks.around(self._ctx("create", data=dict(data), options=options), lambda c: self._insert([c.data])[0])

    def create_many(self, rows: Sequence[Mapping[str, Any]], **options: Any) -> list[dict]:
        if not rows:
            return []
        return self.hooks.around(self._ctx("create_many", data=[dict(r) for r in rows], options=options), lambda c: self._insert(c.data))

    def upsert(self, data: Mapping[str, Any], **options: Any) -> dict:
        """Inserts, or overwrites the columns given of the row with the same key."""

        def run(c: Context) -> dict:
            key = c.data.get(self.table.pk)
            mine = f.eq(self.table.pk, key)
            old = self._row(where(self.df, mine)) if key is not None else None
            if old is None:
                return self._insert([c.data])[0]
            rest = {k: v for k, v in c.data.items() if k != self.table.pk}
            if not rest:
                raise DuplicateKeyError(self._name, [self.table.pk])
            self._change(mine, Update(rest))
            return old | rest

        return self.hooks.around(self._ctx("upsert", data=dict(data), options=options), run)

    def get_or_create(self, flt: Mapping[str, Any] | f.Filter, data: Mapping[str, Any], **options: Any) -> dict:
        return self.get_one(flt, **options) or self.create({**f.flat_record(flt), **data}, **options)

    # ------------------------------------------------------------ updates

    def _change(self, flt: f.Filter, update: Update) -> None:
        df = self.df
        columns = update.columns(df.schema, self.table.pk)
        if not columns:
            return
        hit = F.coalesce(compile_filter(flt, df.schema), F.lit(False))
        after = {k: v.cast(df.schema[k].dataType) for k, v in columns.items()}
        new = df.withColumns({k: F.when(hit, v).otherwise(quoted(k)) for k, v in after.items()})
        for k, v in columns.items():
            c, v = self.table.columns[k], v.cast(df.schema[k].dataType)
            broken = F.lit(False) if c.nullable else v.isNull()
            if c.enum:
                broken = broken | ~v.isin(list(c.enum))
            if (c.enum or not c.nullable) and not df.where(hit & broken).limit(1).isEmpty():
                raise ConstraintError(f"{self._name}.{k}: the new value isn't allowed")
        self.ws.check_unique(self.table, new, columns={*columns})
        rows = df.where(hit)
        self._merge(new, rows.withColumns(after), rows.select(quoted(self.table.pk)))

    def update(self, id_: Any, data: Update | Mapping[str, Any], scope: Any = None, **options: Any) -> dict | None:
        """The row as it is after the update, or None if there is none."""

        def run(c: Context) -> dict | None:
            mine = f.and_(self._by_id(id_), c.filter)
            if not self._row(where(self.df, mine)):
                return None
            self._change(mine, c.update)
            return self._row(where(self.df, self._by_id(id_)))

        return self.hooks.around(self._ctx("update", scope, id=id_, update=Update.of(data), options=options), run)

    def update_many(self, flt: Any, data: Update | Mapping[str, Any], **options: Any) -> dict:
        def run(c: Context) -> dict:
            if f.is_true(c.filter):
                raise LarkspurError("update_many: an empty filter is refused")
            matched = where(self.df, c.filter).count()
            changes = bool(c.update.columns(self.df.schema, self.table.pk))
            if matched and changes:
                self._change(c.filter, c.update)
            return {"acknowledged": True, "matched_count": matched, "modified_count": matched if changes else 0}

        return self.hooks.around(self._ctx("update_many", flt, update=Update.of(data), options=options), run)

    def find_one_and_update(self, flt: Any, data: Update | Mapping[str, Any], sort: Any = None, return_document: str = "after", upsert: bool = False, **options: Any) -> dict | None:
        """Updates the first match in order; returns it after (or before) the update."""

        def run(c: Context) -> dict | None:
            if f.is_true(c.filter):
                raise LarkspurError("find_one_and_update: an empty filter is refused")
            old = self._row(self._ordered(where(self.df, c.filter), sort))
            if old is None:
                if not upsert:
                    return None
                row = {**c.update.inserted(f.flat_record(flt)), **c.extra.get("stamp", {})}
                new = self._insert([{k: v for k, v in row.items() if k in self.table.columns}])[0]
                return new if return_document == "after" else None
            mine = self._by_id(old[self.id_field])
            self._change(mine, c.update)
            return old if return_document == "before" else self._row(where(self.df, mine))

        return self.hooks.around(self._ctx("find_one_and_update", flt, update=Update.of(data), options=options), run)

    def increment(self, id_: Any, field: str, delta: float = 1, **options: Any) -> dict | None:
        def run(c: Context) -> dict | None:
            mine = f.and_(self._by_id(id_), c.filter)
            if not self._row(where(self.df, mine)):
                return None
            self._change(mine, c.update)
            return self._row(where(self.df, self._by_id(id_)))

        return self.hooks.around(self._ctx("increment", id=id_, update=Update(inc={field: delta}), options=options), run)

    # ------------------------------------------------------------ deletes

    def _remove(self, flt: f.Filter) -> int:
        df = self.df
        hit = F.coalesce(compile_filter(flt, df.schema), F.lit(False))
        n = df.where(hit).count()
        if n:
            self._merge(df.where(~hit), gone=df.where(hit).select(quoted(self.table.pk)))
        return n

    def delete(self, id_: Any, scope: Any = None, mode: str | None = None, **options: Any) -> dict:
        def run(c: Context) -> dict:
            n = self._remove(f.and_(self._by_id(id_), c.filter))
            return {"success": bool(n), "message": "Deleted successfully" if n else "Not found", "id": id_}

        return self.hooks.around(self._ctx("delete", scope, id=id_, options=options | {"mode": mode}), run)

    def delete_many(self, flt: Any, mode: str | None = None, **options: Any) -> dict:
        def run(c: Context) -> dict:
            if f.is_true(c.filter):
                raise LarkspurError("delete_many: an empty filter is refused")
            return {"acknowledged": True, "deleted_count": self._remove(c.filter)}

        return self.hooks.around(self._ctx("delete_many", flt, options=options | {"mode": mode}), run)

    # ------------------------------------------------------------ several writes

    @contextmanager
    def transaction(self) -> Iterator[Repository]:
        """All writes or none; hooks stay active."""
        with self.ws.transaction():
            yield self

    def with_transaction(self, run: Callable[[Repository], Any]) -> Any:
        with self.transaction() as repo:
            return run(repo)

    @contextmanager
    def _atomic(self) -> Iterator[None]:
        if self.ws.in_transaction:
            yield
        else:
            with self.ws.transaction():
                yield

    def bulk_write(self, ops: Sequence[Mapping[str, Mapping]]) -> dict:
        """insert_one, update_one, update_many, delete_one, delete_many, replace_one in order, all or
        none; no hooks run, records are flat. Ids are keyed by the operation's place."""
        out: dict[str, Any] = {"inserted_count": 0, "matched_count": 0, "modified_count": 0, "deleted_count": 0, "upserted_count": 0, "inserted_ids": {}, "upserted_ids": {}}
        if not ops:
            return out
        steps = [self._step(i, op) for i, op in enumerate(ops)]
        with self._atomic():
            at = 0
            while at < len(steps):
                # Operations on rows named by their key are folded: one read and one write for a run of them.
                end = at
                while end < len(steps) and steps[end][3] is not None:
                    end += 1
                if end > at:
                    self._fold(steps[at:end], out)
                    at = end
                else:
                    self._single(*steps[at][:3], out)
                    at += 1
        return out

    def _step(self, i: int, op: Mapping[str, Mapping]) -> tuple[int, str, Mapping, list | None]:
        """(place, kind, spec, keys): keys of the rows it is about, where nothing else tells them."""
        (kind, spec), *more = op.items()
        if more:
            raise LarkspurError(f"operation {i}: one kind at a time")
        if kind not in ("insert_one", "update_one", "replace_one", "update_many", "delete_one", "delete_many"):
            raise LarkspurError(f"operation {i}: no kind {kind!r}")
        if kind in ("update_one", "replace_one") and isinstance(spec["update" if kind == "update_one" else "replacement"], (list, tuple, Update)):
            raise LarkspurError("bulk_write takes flat records")
        if kind in ("update_many", "delete_many") and f.is_true(f.as_filter(spec["filter"])):
            raise LarkspurError(f"{kind}: an empty filter is refused")
        pk, flt = self.table.pk, f.as_filter(spec.get("filter"))
        named = spec["document"].get(pk) if kind == "insert_one" else flt.value if isinstance(flt, f.Compare) and (flt.op, flt.field) == ("eq", pk) else None
        parts = [spec[part] for part in ("update", "replacement", "document") if part in spec]
        plain = named is not None and not any(isinstance(p, Update) or any(isinstance(v, Column) for v in p.values()) for p in parts)
        return i, kind, spec, [named] if plain and not isinstance(named, Column) else None

    def _fold(self, steps: Sequence[tuple[int, str, Mapping, list]], out: dict[str, Any]) -> None:
        """Operations by key, in order: their rows are read once, changed here and written once."""
        t, pk, df = self.table, self.table.pk, self.df
        fit = int if isinstance(df.schema[pk].dataType, T.IntegralType) else str if isinstance(df.schema[pk].dataType, T.StringType) else lambda k: k
        found = df.where(quoted(pk).isin([*{fit(k) for *_, ks in steps for k in ks}])).collect()
        old = {r[pk]: r.asDict(True) for r in found}
        if len(old) < len(found):  # keys that aren't unique
            for step in steps:
                self._single(*step[:3], out)
            return
        now, inserted = dict(old), False

        def insert(row: Mapping[str, Any]) -> dict:
            whole = t.complete(row)
            if fit(whole[pk]) in now:
                raise DuplicateKeyError(self._name, [pk])
            now[fit(whole[pk])] = whole
            return whole

        for i, kind, spec, (key,) in steps:
            key = fit(key)
            values = spec.get("replacement" if kind == "replace_one" else "update", {})
            if kind == "insert_one":
                out["inserted_ids"][i] = insert(spec["document"])[pk]
                out["inserted_count"], inserted = out["inserted_count"] + 1, True
            elif kind.startswith("delete"):
                out["deleted_count"] += now.pop(key, None) is not None
            elif key in now:
                for c in values:
                    resolve(df.schema, c, "update")
                now[key] = self._allowed(now[key] | {c: v for c, v in values.items() if c != pk}, values)
                out["matched_count"] += 1
                out["modified_count"] += 1
            elif spec.get("upsert") and kind.endswith("_one"):
                out["upserted_ids"][i] = insert({pk: key, **values})[pk]
                out["upserted_count"], inserted = out["upserted_count"] + 1, True
        gone = [k for k in old if now.get(k) != old[k]]
        rows = [r for k, r in now.items() if r != old.get(k)]
        if not gone and not rows:
            return
        fresh = _typed(self.ws.spark, rows, t)
        left = df.where(~F.coalesce(quoted(pk).isin(gone), F.lit(False))) if gone else df
        new = left.unionByName(fresh)
        self.ws.check_unique(t, new, rows, None if inserted else {c for r in rows for c in r if r[c] != old[fit(r[pk])][c]})
        self._merge(new, fresh if rows else None, df.where(quoted(pk).isin(gone)).select(quoted(pk)) if gone else None)

    def _allowed(self, row: dict, changed: Mapping) -> dict:
        for k in changed:
            c = self.table.columns[k]
            if row[k] is None and not c.nullable or row[k] is not None and c.enum and row[k] not in c.enum:
                raise ConstraintError(f"{self._name}.{k}: the new value isn't allowed")
        return row

    def _single(self, i: int, kind: str, spec: Mapping, out: dict[str, Any]) -> None:
        """One operation whose rows a filter tells."""
        if kind == "insert_one":
            out["inserted_ids"][i] = self._insert([spec["document"]])[0][self.table.pk]
            out["inserted_count"] += 1
        elif kind in ("update_one", "replace_one"):
            values = spec["update" if kind == "update_one" else "replacement"]
            row = self._row(self._ordered(where(self.df, spec["filter"]), None))
            if row is not None:
                self._change(self._by_id(row[self.id_field]), Update.of(values))
                out["matched_count"] += 1
                out["modified_count"] += 1
            elif spec.get("upsert"):
                out["upserted_ids"][i] = self._insert([{**f.flat_record(spec["filter"]), **values}])[0][self.table.pk]
                out["upserted_count"] += 1
        elif kind == "update_many":
            n = where(self.df, spec["filter"]).count()
            if n:
                self._change(f.as_filter(spec["filter"]), Update.of(spec["update"]))
            out["matched_count"] += n
            out["modified_count"] += n
        elif kind == "delete_one":
            row = self._row(self._ordered(where(self.df, spec["filter"]), None))
            out["deleted_count"] += self._remove(self._by_id(row[self.id_field])) if row else 0
        else:
            out["deleted_count"] += self._remove(f.as_filter(spec["filter"]))

    def batch(self, build: Callable[[Batch], Any]) -> list:
        return with_batch(self.ws, lambda b: build(b))


def _typed(spark, rows: Sequence[Mapping[str, Any]], table: TableDef) -> DataFrame:
    """Complete rows as a DataFrame; values of other types than their column's become that, as literals do."""
    try:
        return table.frame(spark, rows)
    except (TypeError, ValueError):
        one = lambda r: F.struct(*[literal(r[k], c.type).cast(c.type).alias(k) for k, c in table.columns.items()])
        return spark.range(1).select(F.explode(F.array(*map(one, rows))).alias("r")).select("r.*")


def _refiltered(req: agg.AggRequest, ctx: Context) -> agg.AggRequest:
    return agg.AggRequest(req.measures, req.group_by, ctx.filter, req.having, req.sort, req.limit, req.offset, req.options)


class Prepared:
    def __init__(self, repo: Repository, name: str, build: Callable[..., DataFrame] | str):
        self.repo, self.name, self._build = repo, name, build

    def execute(self, **params: Any) -> DataFrame:
        if isinstance(self._build, str):
            return self.repo.ws.spark.sql(self._build, args=params, table=self.repo.df)
        out = self._build(self.repo.df, **params)
        if not isinstance(out, DataFrame):
            raise LarkspurError(f"{self.name}: not a query")
        return out


class Batch:
    """Collects write operations over any tables of a workspace."""

    def __init__(self, ws: Workspace):
        self.ws, self.ops = ws, []

    def insert(self, table: str, row: Mapping[str, Any]) -> None:
        self.ops.append(lambda: Repository(self.ws, table)._insert([row])[0])

    def upsert(self, table: str, row: Mapping[str, Any]) -> None:
        self.ops.append(lambda: Repository(self.ws, table).upsert(row))

    def update(self, table: str, flt: Any, data: Mapping[str, Any]) -> None:
        self.ops.append(lambda: Repository(self.ws, table).update_many(flt, data))

    def delete(self, table: str, flt: Any) -> None:
        self.ops.append(lambda: Repository(self.ws, table).delete_many(flt))


def with_batch(ws: Workspace, build: Callable[[Batch], Any]) -> list:
    """Runs the batch's operations in order, all or none; no hooks run. An empty batch is refused."""
    batch = Batch(ws)
    build(batch)
    if not batch.ops:
        raise LarkspurError("an empty batch is refused")
    if ws.in_transaction:
        return [op() for op in batch.ops]
    with ws.transaction():
        return [op() for op in batch.ops]


__all__ = ["Batch", "Prepared", "Repository", "is_duplicate_key_error", "with_batch"]
