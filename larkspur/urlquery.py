"""URL queries: field[op]=value filters, sort, page, limit, select, populate, search, after.

Only these forms are read; a field without an operator means equality, and values are text
that the filter compiler fits to the column's type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from larkspur.errors import LarkspurError
from larkspur.plans import filters as f

RESERVED = ("sort", "page", "limit", "select", "populate", "search", "after")
_KEY = re.compile(r"^(\w+)(?:\[(\w+)\])?$")
_OPS = {
    "eq": f.eq, "ne": f.ne, "gt": f.gt, "gte": f.gte, "lt": f.lt, "lte": f.lte,
    "in": lambda k, v: f.in_(k, v.split(",") if v else ()), "nin": lambda k, v: f.nin(k, v.split(",") if v else ()),
    "like": f.like, "contains": f.contains, "exists": lambda k, v: f.exists(k, v.lower() not in ("false", "0")),
}


@dataclass
class ParsedQuery:
    filter: f.Filter = f.TRUE
    sort: str | None = None
    page: int | None = None
    limit: int | None = None
    select: list[str] = field(default_factory=list)
    populate: list[str] = field(default_factory=list)
    search: str | None = None
    after: str | None = None


def parse_url(query: str) -> ParsedQuery:
    out, nodes = ParsedQuery(), []
    for key, value in parse_qsl(query.partition("?")[2] or query, keep_blank_values=True):
        if key in RESERVED:
            if key in ("page", "limit"):
                if not value.isdigit():
                    raise LarkspurError(f"{key} must be a number, not {value!r}")
                setattr(out, key, int(value))
            else:
                setattr(out, key, [x for x in value.split(",") if x] if key in ("select", "populate") else value)
            continue
        m = _KEY.match(key)
        if not m or (m[2] or "eq") not in _OPS:
            raise LarkspurError(f"can't read the parameter {key!r}")
        nodes.append(_OPS[m[2] or "eq"](m[1], value))
    out.filter = f.and_(*nodes)
    return out
