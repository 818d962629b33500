"""The filter language: immutable nodes, builders, simplification.

TRUE and FALSE are nodes; and_() drops TRUE, or_() with a TRUE is TRUE, not_(TRUE) is FALSE.
Refusals of unfiltered writes rest on that: is_true() holds for whatever filters nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return and_(self, other)

    def __or__(self, other: Filter) -> Filter:
        return or_(self, other)

    def __invert__(self) -> Filter:
        return not_(self)


@dataclass(frozen=True)
class Truth(Filter):
    value: bool


@dataclass(frozen=True)
class Compare(Filter):
    op: str  # eq ne gt gte lt lte
    field: str
    value: Any


@dataclass(frozen=True)
class Member(Filter):
    field: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Exists(Filter):
    field: str
    present: bool = True


@dataclass(frozen=True)
class Like(Filter):
    field: str
    pattern: str
    sensitive: bool = False


@dataclass(frozen=True)
class Regex(Filter):
    field: str
    pattern: str
    allowed: bool = False


@dataclass(frozen=True)
class And(Filter):
    children: tuple[Filter, ...]


@dataclass(frozen=True)
class Or(Filter):
    children: tuple[Filter, ...]


@dataclass(frozen=True)
class Not(Filter):
    child: Filter


@dataclass(frozen=True)
class Raw(Filter):
    sql: str
    params: tuple = ()


TRUE, FALSE = Truth(True), Truth(False)


def eq(field: str, value: Any) -> Filter:
    return Compare("eq", field, value)


def ne(field: str, value: Any) -> Filter:
    return Compare("ne", field, value)


def gt(field: str, value: Any) -> Filter:
    return Compare("gt", field, value)


def gte(field: str, value: Any) -> Filter:
    return Compare("gte", field, value)


def lt(field: str, value: Any) -> Filter:
    return Compare("lt", field, value)


def lte(field: str, value: Any) -> Filter:
    return Compare("lte", field, value)


def in_(field: str, values: Iterable) -> Filter:
    return Member(field, tuple(values))


def nin(field: str, values: Iterable) -> Filter:
    return Member(field, tuple(values), True)


def exists(field: str, present: bool = True) -> Filter:
    return Exists(field, present)


def is_null(field: str) -> Filter:
    return Exists(field, False)


def like(field: str, pattern: str, sensitive: bool = False) -> Filter:
    """SQL LIKE; case-insensitive unless asked otherwise, backslash escapes."""
    return Like(field, pattern, sensitive)


def contains(field: str, text: str, sensitive: bool = False) -> Filter:
    """The text anywhere; its own % and _ are literal."""
    literal = "".join("\\" + c if c in "%_\\" else c for c in text)
    return Like(field, f"%{literal}%", sensitive)


def regex(field: str, pattern: str, allowed: bool = False) -> Filter:
    """Refused when compiled, unless allowed: a regular expression is not portable."""
    return Regex(field, pattern, allowed)


def raw(sql: str, params: Iterable = ()) -> Filter:
    """A fragment of Spark SQL; each ? outside quotes takes a parameter."""
    return Raw(sql, tuple(params))


def and_(*children: Filter) -> Filter:
    rest = tuple(c for c in children if not is_true(c))
    return TRUE if not rest else rest[0] if len(rest) == 1 else And(rest)


def or_(*children: Filter) -> Filter:
    if any(is_true(c) for c in children):
        return TRUE
    return FALSE if not children else children[0] if len(children) == 1 else Or(tuple(children))


def not_(child: Filter) -> Filter:
    return FALSE if is_true(child) else Not(child)


def is_filter(x: Any) -> bool:
    return isinstance(x, Filter)


def is_true(f: Filter) -> bool:
    return f == TRUE or isinstance(f, And) and all(map(is_true, f.children))


def as_filter(x: Filter | Mapping | None) -> Filter:
    """A filter as it is; a flat record as equalities; nothing as TRUE."""
    if x is None:
        return TRUE
    if is_filter(x):
        return x
    return and_(*(eq(k, v) for k, v in x.items()))


def merge(a: Filter | Mapping | None, b: Filter | Mapping | None) -> Filter:
    return and_(as_filter(a), as_filter(b))


def tenant_scope(existing: Filter | Mapping | None, field: str, value: Any) -> Filter:
    return merge(existing, eq(field, value))


def flat_record(x: Filter | Mapping | None) -> dict[str, Any]:
    """The equalities of a plain record; a filter contributes none."""
    return dict(x) if isinstance(x, Mapping) else {}
