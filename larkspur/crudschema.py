"""JSON schemas for the bodies, parameters and list queries of a table's HTTP interface."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from typing import Any

from larkspur.sources.tables import ColumnDef, TableDef

#: Schema of each logical type.
TYPES = {
    "date": {"type": "string", "format": "date-time"},
    "boolean": {"type": "boolean"},
    "json": {"type": "object", "additionalProperties": True},
    "integer": {"type": "integer"},
    "number": {"type": "number"},
    "buffer": {"type": "string", "contentEncoding": "base64"},
}


def column_schema(c: ColumnDef) -> dict:
    if c.kind == "string":
        out: dict[str, Any] = {"type": "string"}
        if c.enum:
            out["enum"] = list(c.enum)
        if c.length:
            out["maxLength"] = c.length
        return out
    return dict(TYPES.get(c.kind, {}))


def _left_out(options: Mapping, purpose: str) -> set[str]:
    rules = options.get("field_rules", {})
    marks = ("system_managed",) if purpose == "create" else ("system_managed", "immutable")
    return {*options.get(purpose, {}).get("omit_fields", ()), *(k for k, r in rules.items() if any(r.get(m) for m in marks))}


def _without(schema: dict, names: set[str]) -> None:
    schema["properties"] = {k: v for k, v in schema["properties"].items() if k not in names}
    if "required" in schema:
        schema["required"] = [k for k in schema["required"] if k not in names]


def crud_schemas(table: TableDef, options: Mapping | None = None) -> dict[str, dict]:
    """create_body, update_body, params and list_query.

    options: field_rules {name: {system_managed, immutable, optional}}, soft_required,
    create {omit_fields, required, optional, overrides}, update {omit_fields,
    require_at_least_one}, query {filterable}, strict."""
    options = options or {}
    make, change = options.get("create", {}), options.get("update", {})
    shown = {k: c for k, c in table.columns.items() if not (k == table.pk and c.kind == "integer")}
    create: dict[str, Any] = {"type": "object", "properties": {k: column_schema(c) for k, c in shown.items()}}
    create["required"] = [k for k, c in shown.items() if not c.nullable and c.default is None and k not in options.get("soft_required", ())]
    _without(create, _left_out(options, "create"))
    optional = {k for k, r in options.get("field_rules", {}).items() if r.get("optional")} | {*make.get("optional", ())}
    create["required"] += [k for k in make.get("required", ()) if k not in create["required"]]
    create["required"] = [k for k in create["required"] if k not in optional]
    create["properties"] |= {k: v for k, v in make.get("overrides", {}).items() if k in create["properties"]}
    update = copy.deepcopy(create)
    del update["required"]
    _without(update, _left_out(options, "update"))
    if options.get("strict"):
        create["additionalProperties"] = update["additionalProperties"] = False
    if change.get("require_at_least_one"):
        update["minProperties"] = 1
    key = column_schema(table.columns[table.pk])
    if key.get("type") in ("integer", "number"):
        key |= {"type": "string", "pattern": r"^-?\d+$"}
    listed: dict[str, Any] = {
        "page": {"type": "integer", "minimum": 1, "default": 1}, "limit": {"type": "integer", "minimum": 1, "default": 20},
        **{k: {"type": "string"} for k in ("sort", "search", "select", "after")}, "includeDeleted": {"type": "boolean", "default": False},
    }
    listed |= {k: v if isinstance(v, Mapping) and "type" in v else {"type": "string"} for k, v in options.get("query", {}).get("filterable", {}).items()}
    return {
        "create_body": create,
        "update_body": update,
        "params": {"type": "object", "properties": {"id": key}, "required": ["id"]},
        "list_query": {"type": "object", "properties": listed, "additionalProperties": True},
    }
