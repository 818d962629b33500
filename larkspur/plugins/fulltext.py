"""Ranked full-text search over some of a table's columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from larkspur.errors import LarkspurError
from larkspur.operators import fulltext as ft
from larkspur.operators.paging import clamp
from larkspur.plans import filters as f
from larkspur.plans.compiler import where
from larkspur.sources.store import Delta

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class FullText:
    """Searches read the current rows, or the index that create_index() stores: postings by term and
    lengths, tables <source>_fts and <source>_fts_len. Writes of the repository change the index in
    the same commit, by the rows that come and the keys that go.

    prefix: lengths of prefixes that the index holds beside the terms."""

    def __init__(self, columns: Sequence[str], tokenizer: str = "words", prefix: Sequence[int] = ()):
        if not columns or not all(map(_NAME.fullmatch, columns)):
            raise LarkspurError("full text needs columns, by plain names")
        if not all(isinstance(n, int) and 1 <= n <= 99 for n in prefix):
            raise LarkspurError("prefix lengths go from 1 to 99")
        if tokenizer not in ("words", "porter", "trigram"):
            raise LarkspurError(f"no tokenizer {tokenizer!r}")
        self.columns, self.tokenizer, self.prefix = list(columns), tokenizer, sorted({*prefix})

    def apply(self, repo) -> None:
        for c in self.columns:
            if c not in repo.table.columns:
                raise LarkspurError(f"{repo.name} has no column {c!r}")
        terms, sizes, pk, ws = f"{repo._name}_fts", f"{repo._name}_fts_len", repo.id_field, repo.ws

        def built(df) -> dict:
            return {terms: ft.postings(df, pk, self.columns, self.tokenizer, self.prefix), sizes: ft.lengths(df, pk, self.columns, self.tokenizer)}

        def follow(delta: Delta | None, whole) -> dict:
            """The index's part of a change of the source."""
            if not ws.has(terms):
                return {}
            if delta is None:
                new = built(whole)
                return {terms: (None, ft.by_term(new[terms])), sizes: (None, new[sizes])}
            out, new = {}, built(delta.rows) if delta.rows is not None else {}
            gone = None if delta.gone is None else delta.gone.toDF(pk)
            for name in (terms, sizes):
                rest = ws.frame(name) if gone is None else ws.frame(name).join(gone, pk, "left_anti").select(*ws.frame(name).columns)
                after = rest.unionByName(new[name]) if new else rest
                out[name] = (Delta(new.get(name), gone) if ws.store.takes_layers(name, None) else None, after)
            return out

        def create_index() -> None:
            new = built(repo.df)
            ws.put({terms: ft.by_term(new[terms]), sizes: new[sizes]})

        def drop_index() -> None:
            ws.put({terms: None, sizes: None})

        ws.derived.setdefault(repo._name, {})[terms] = follow

        def hits(query: str, **options):
            """(id, rank) of the matching rows in scope, lazily."""
            scope = repo._ctx("search", options=options)
            repo.hooks.emit("before:search", scope)
            if ws.has(terms):
                found = ft.search_index(ws.frame(terms), ws.frame(sizes), pk, self.columns, query, self.tokenizer)
            else:
                found = ft.search(repo.df, pk, self.columns, query, self.tokenizer)
            if f.is_true(scope.filter):
                return found
            # Scope is applied before the best are taken, so that hidden rows take no places.
            return found.join(where(repo.df, scope.filter).select(pk), pk, "left_semi")

        def search_frame(query: str, **options):
            return repo.df.join(hits(query, **options), pk).drop("rank")

        def search(query: str, limit=None, offset: int = 0, **options):
            """Source rows, best first; ties by key."""
            best = hits(query, **options).orderBy("rank", pk).offset(max(offset, 0)).limit(clamp(limit, 50))
            return repo.df.join(best, pk).orderBy("rank", pk).drop("rank")

        repo.search, repo.search_frame, repo.search_hits = search, search_frame, hits
        repo.create_search_index, repo.drop_search_index, repo.rebuild_search_index = create_index, drop_index, create_index
