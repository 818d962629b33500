"""Ranked full-text search: a query grammar, boolean matching and BM25.

Grammar: terms, "phrases", prefixes*, column:term, AND, OR, NOT, parentheses; terms in a row
are joined by AND. NOT binds strongest, then AND, then OR.

Each leaf of a query is counted in each document, and corpus figures are one aggregation. There
are three ways to count, with the same results: over words a leaf becomes a pattern that is
counted in the text itself; other tokenizers make token arrays; and an index holds a row per
term, column and document with the term's positions, sorted by term, so that a search reads the
rows of its terms alone, and the documents' lengths.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import LarkspurError
from larkspur.functions.columns import MARKED, MARKS, PLAIN_, folded_text, let, tokens

#: BM25's customary constants.
K1, BETA = 1.2, 0.75
_LEX = re.compile(r'\s*(?:(?P<paren>[()])|(?:(?P<column>[A-Za-z_][A-Za-z0-9_]*)\s*:\s*)?(?:"(?P<phrase>(?:[^"]|"")*)"|(?P<word>[^\s()":]+)))')


@dataclass(frozen=True)
class Leaf:
    words: tuple[str, ...]
    column: str | None = None
    prefix: bool = False


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


def parse(query: str):
    """The query as a tree; words are left as written, to be tokenized by the index's tokenizer."""
    items, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise LarkspurError(f"search: can't read {query[at:]!r}")
        at = m.end()
        if m["paren"]:
            items.append(m["paren"])
        elif m["phrase"] is not None:
            items.append(Leaf((m["phrase"].replace('""', '"'),), m["column"]))
        elif m["column"] is None and m["word"] in ("AND", "OR", "NOT"):
            items.append(m["word"])
        else:
            word = m["word"]
            items.append(Leaf((word.rstrip("*"),), m["column"], word.endswith("*")))
    if not items:
        raise LarkspurError("search: the query is empty")
    pos = 0

    def peek():
        return items[pos] if pos < len(items) else None

    def atom():
        nonlocal pos
        x = peek()
        if x is None or x in ("AND", "OR", "NOT", ")"):
            raise LarkspurError(f"search: a term is missing in {query!r}")
        pos += 1
        if x != "(":
            return x
        inner = either()
        if peek() != ")":
            raise LarkspurError(f"search: ) is missing in {query!r}")
        pos += 1
        return inner

    def without():
        nonlocal pos
        left = atom()
        while peek() == "NOT":
            pos += 1
            left = Without(left, atom())
        return left

    def both():
        nonlocal pos
        left = without()
        while (x := peek()) is not None and x not in ("OR", ")"):
            pos += x == "AND"
            left = Both(left, without())
        return left

    def either():
        nonlocal pos
        left = both()
        while peek() == "OR":
            pos += 1
            left = Either(left, both())
        return left

    tree = either()
    if pos < len(items):
        raise LarkspurError(f"search: unexpected {items[pos]!r}")
    return tree


def _leaves(tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [*_leaves(tree.left), *_leaves(tree.right)]


def _frequency(words: list[str], prefix: bool, toks: Column) -> Column:
    """How often the words stand in a row in an array of tokens."""
    if not words:
        return F.lit(0)
    if len(words) == 1:
        hit = (lambda t: t.startswith(words[0])) if prefix else (lambda t: t == words[0])
        return F.size(F.filter(toks, hit))
    return let(toks, lambda t: _phrase(words, prefix, t))


def _phrase(words: list[str], prefix: bool, toks: Column) -> Column:
    n = len(words)
    starts = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        run = F.lit(True)
        for j, w in enumerate(words):
            t = F.element_at(toks, i + j)
            run = run & (t.startswith(w) if prefix and j == n - 1 else t == w)
        return run

    return F.size(F.filter(starts, at))


_SIGN = r"[\p{L}\p{N}]"
_WORD = rf"(?:{_SIGN}[{MARKS}]*)+"


def _pattern(words: list[str], prefix: bool) -> str:
    """A pattern that matches, in lower-case text, where the words stand in a row; matches end with
    the first word, so that rows that overlap count each."""

    def letters(word: str) -> str:
        one = lambda c: "[" + "".join(re.escape(x) for x in (c, *(m for m, p in zip(MARKED, PLAIN_, strict=True) if p == c))) + "]"
        return "".join(one(c) + f"[{MARKS}]*+" for c in word)

    end = rf"(?!{_SIGN})"
    parts = [letters(w) + end for w in words[:-1]] + [letters(words[-1]) + ("" if prefix else end)]
    rest = "".join(rf"[^\p{{L}}\p{{N}}]+{p}" for p in parts[1:])
    # A mark between two letters doesn't part them.
    return rf"(?<!{_SIGN})(?<!{_SIGN}[{MARKS}])" + parts[0] + (f"(?={rest})" if rest else "")


def token_table(df: DataFrame, pk: str, columns: Sequence[str], kind: str = "words") -> DataFrame:
    """(pk, one token array per column)."""
    made = [tokens(F.col(c).cast("string"), "words" if kind == "porter" else kind) for c in columns]
    if kind == "porter":
        from larkspur.functions.stemming import stemmed

        made = [stemmed(t) for t in made]
    return df.select(pk, *[t.alias(f"_t_{c}") for t, c in zip(made, columns, strict=True)])


def postings(df: DataFrame, pk: str, columns: Sequence[str], kind: str = "words", prefix: Sequence[int] = ()) -> DataFrame:
    """(term, part, pk, tf, at): a row per term, column and document; at: its positions. For each
    prefix length a column _p<length> holds the term's beginning."""
    table = token_table(df, pk, columns, kind)
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(f"_t_{c}").alias("t")) for c in columns])
    rows = table.select(pk, F.explode(parts).alias("p")).select(pk, "p.part", F.posexplode("p.t").alias("i", "term"))
    out = rows.groupBy("term", "part", pk).agg(F.array_sort(F.collect_list("i")).alias("at"))
    return out.select("term", "part", pk, F.size("at").alias("tf"), "at", *[F.substring("term", 1, n).alias(f"_p{n}") for n in prefix])


def by_term(index: DataFrame) -> DataFrame:
    """Postings as they are stored: in order of the term, so that files and row groups are skipped."""
    return index.repartitionByRange("term").sortWithinPartitions("term")


def lengths(df: DataFrame, pk: str, columns: Sequence[str], kind: str = "words") -> DataFrame:
    """(pk, len): how many tokens a document has."""
    table = token_table(df, pk, columns, kind)
    return table.select(pk, sum((F.size(f"_t_{c}") for c in columns), F.lit(0)).alias("len"))


def _tokenized(words: Sequence[str], kind: str) -> list[str]:
    """Query words by the tokenizer's own rules, on the driver: no job is run for them."""
    plain = folded_text(" ".join(words))
    if kind == "trigram":
        return [plain[i : i + 3] for i in range(len(plain) - 2)]
    out, run = [], ""
    for c in plain + " ":
        if c.isalpha() or c.isnumeric():
            run += c
        elif run:
            out.append(run)
            run = ""
    if kind == "porter":
        from larkspur.functions.stemming import stem

        return [stem(w) for w in out]
    return out


class Query:
    """A parsed query over some columns; leaves are counted in columns _f0, _f1 .."""

    def __init__(self, query: str, columns: Sequence[str], kind: str):
        self.tree, self.columns, self.kind = parse(query), list(columns), kind
        self.leaves = list(dict.fromkeys(_leaves(self.tree)))
        for x in self.leaves:
            if x.column is not None and x.column not in columns:
                raise LarkspurError(f"search: {x.column!r} isn't among the indexed columns")
        self.names = {x: f"_f{i}" for i, x in enumerate(self.leaves)}
        self.words = {x: _tokenized(x.words, kind) for x in self.leaves}

    def within(self, x: Leaf) -> list[str]:
        return [x.column] if x.column else self.columns

    def matches(self, t=None) -> Column:
        t = self.tree if t is None else t
        match t:
            case Leaf():
                return F.col(self.names[t]) > 0
            case Both(a, b):
                return self.matches(a) & self.matches(b)
            case Either(a, b):
                return self.matches(a) | self.matches(b)
            case Without(a, b):
                return self.matches(a) & ~self.matches(b)

    def document_counts(self) -> list[Column]:
        return [F.coalesce(F.sum((F.col(n) > 0).cast("long")), F.lit(0)).alias(n) for n in self.names.values()]

    def ranked(self, counted: DataFrame, pk: str, n: int, mean: float, found: dict[str, int]) -> DataFrame:
        """(pk, rank) of the matching rows of counted (pk, _len, _f0 ..), by BM25."""
        score = F.lit(0.0)
        for name in self.names.values():
            idf = max(math.log((n - found[name] + 0.5) / (found[name] + 0.5)), 1e-6)
            tf = F.col(name).cast("double")
            score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - BETA + BETA * F.col("_len") / F.lit(float(mean))))
        return counted.where(self.matches()).select(pk, (-score).alias("rank"))


def search(df: DataFrame, pk: str, columns: Sequence[str], query: str, kind: str = "words") -> DataFrame:
    """Hits of the texts of df as (pk, rank); lower ranks are better."""
    q = Query(query, columns, kind)
    if kind == "words":
        text = {c: f"_t_{c}" for c in q.columns}
        rows = df.select(pk, *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(t) for c, t in text.items()])
        count = lambda c, pattern: F.regexp_count(F.col(text[c]), F.lit(pattern))
        frequency = lambda x, c: count(c, _pattern(q.words[x], x.prefix)) if q.words[x] else F.lit(0)
        length = sum((count(c, _WORD) for c in q.columns), F.lit(0))
    else:
        rows = token_table(df, pk, columns, kind)
        frequency = lambda x, c: _frequency(q.words[x], x.prefix, F.col(f"_t_{c}"))
        length = sum((F.size(f"_t_{c}") for c in q.columns), F.lit(0))
    counted = rows.select(pk, length.alias("_len"), *[sum((frequency(x, c) for c in q.within(x)), F.lit(0)).alias(n) for x, n in q.names.items()])
    # One row of corpus figures: documents, mean length, documents per leaf.
    figures = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"), *q.document_counts()).first()
    return q.ranked(counted, pk, figures["n"], figures["mean"] or 1.0, figures.asDict())


def search_index(index: DataFrame, sizes: DataFrame, pk: str, columns: Sequence[str], query: str, kind: str = "words") -> DataFrame:
    """The same from stored postings() and lengths(): rows of the query's terms alone are read."""
    q = Query(query, columns, kind)

    def is_term(word: str, prefix: bool) -> Column:
        if not prefix:
            return F.col("term") == word
        at = f"_p{len(word)}"
        return F.col(at) == word if at in index.columns else F.col("term").startswith(word)

    def words(x: Leaf) -> list[Column]:
        return [is_term(w, x.prefix and j == len(q.words[x]) - 1) for j, w in enumerate(q.words[x])]

    def frequency(x: Leaf) -> Column:
        terms, here = words(x), F.col("part").isin(q.within(x))
        if len(terms) < 2:
            return F.coalesce(F.sum(F.when(terms[0] & here, F.col("tf"))), F.lit(0)) if terms else F.lit(0).cast("long")
        # A phrase begins where its words' positions, each less its place, agree.
        places = lambda t: F.flatten(F.collect_list(F.when(t & here, F.col("at"))))
        starts = lambda at, j: F.transform(at, lambda i: i - j)
        return F.size(reduce(F.array_intersect, [starts(places(t), j) for j, t in enumerate(terms)]))

    asked = [t for x in q.leaves for t in words(x)]
    rows = index.where(reduce(or_, asked, F.lit(False)))
    by_part = rows.groupBy(pk, "part").agg(*[frequency(x).cast("long").alias(n) for x, n in q.names.items()])
    counted = by_part.groupBy(pk).agg(*[F.sum(n).alias(n) for n in q.names.values()])
    figures = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    found = counted.agg(*q.document_counts()).first().asDict()
    return q.ranked(counted.join(sizes.withColumnRenamed("len", "_len"), pk), pk, figures["n"], figures["mean"] or 1.0, found)
