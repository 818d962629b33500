"""Embeddings beside a table, and exact similarity search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import LarkspurError
from larkspur.operators import vector as vec
from larkspur.operators.paging import clamp
from larkspur.plans.compiler import where
from larkspur.sources.store import Delta
from larkspur.sources.tables import ColumnDef, TableDef


class Vectors:
    """A store <source>_vec (rowid, embedding) of one dimension and metric; key: the type of rowid."""

    def __init__(self, dim: int, metric: str = "cosine", store: str | None = None, key: T.DataType | None = None):
        if not 1 <= dim <= vec.MOST_DIMS:
            raise LarkspurError(f"dimensions go from 1 to {vec.MOST_DIMS}")
        if metric not in vec.METRICS:
            raise LarkspurError(f"no metric {metric!r}; one of {', '.join(vec.METRICS)}")
        if store is not None and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", store):
            raise LarkspurError(f"not an identifier: {store!r}")
        self.dim, self.metric, self.store, self.key = dim, metric, store, key or T.LongType()

    def apply(self, repo) -> None:
        name = self.store or f"{repo._name}_vec"
        table = TableDef(name, {"rowid": ColumnDef(self.key, False), "embedding": ColumnDef(T.ArrayType(T.FloatType()), False, mode="vector", dim=self.dim)}, "rowid")
        if name not in repo.ws.tables:
            if name in repo.ws.store.names():
                repo.ws.tables[name] = table
            else:
                repo.ws.register(table)

        def checked(vector: Sequence[float]) -> list[float]:
            if len(vector) != self.dim:
                raise LarkspurError(f"a vector of {len(vector)}; the store holds {self.dim}")
            return [float(x) for x in vector]

        def upsert_embeddings(rows: Sequence[tuple[int, Sequence[float]]]) -> None:
            kind = str if isinstance(self.key, T.StringType) else int
            for i, _ in rows:
                if isinstance(i, bool) or not isinstance(i, kind):
                    raise LarkspurError(f"rowid must be {'a string' if kind is str else 'an integer'}, not {i!r}")
            new = {i: checked(v) for i, v in rows}
            old = repo.ws.frame(name)
            fresh = table.frame(repo.ws.spark, [{"rowid": i, "embedding": v} for i, v in new.items()])
            after = old.join(fresh.select("rowid"), "rowid", "left_anti").select(*table.columns).unionByName(fresh)
            repo.ws.change(name, Delta(fresh, fresh.select("rowid")), after, "rowid")

        def delete_embedding(rowid: int) -> None:
            old, gone = repo.ws.frame(name), F.col("rowid") == rowid
            repo.ws.change(name, Delta(gone=old.where(gone).select("rowid")), old.where(~gone), "rowid")

        def hits(vector: Sequence[float], k=None, **options):
            """(rowid, distance), nearest first, of rows in scope."""
            scope = repo._ctx("search", options=options)
            repo.hooks.emit("before:search", scope)
            live = where(repo.df, scope.filter).select(F.col(repo.id_field).cast(self.key).alias("rowid"))
            return vec.nearest(repo.ws.frame(name).join(live, "rowid", "left_semi"), checked(vector), clamp(k, 10), self.metric)

        def similarity_search(vector: Sequence[float], k=None, **options) -> list[dict]:
            """[{rowid, distance, doc}], nearest first."""
            best = hits(vector, k, **options)
            doc = F.struct(*[F.col(c) for c in repo.table.columns]).alias("doc")
            source = repo.df.select(F.col(repo.id_field).cast(self.key).alias("rowid"), doc)
            return [r.asDict(True) for r in best.join(source, "rowid").orderBy("distance", "rowid").select("rowid", "distance", "doc").collect()]

        repo.upsert_embedding, repo.upsert_embeddings = (lambda i, v: upsert_embeddings([(i, v)])), upsert_embeddings
        repo.delete_embedding, repo.similarity_search, repo.similarity_hits = delete_embedding, similarity_search, hits
        repo.drop_vectors = lambda: repo.ws.put({name: None})
