"""larkspur: a repository-style data API and analytics engine on Spark DataFrames.

The names below load what they need when they are first used, so that an executor's Python
which needs one module pays for that one.
"""

from importlib import import_module

_HOMES = {
    "ColumnDef": "sources.tables", "IndexDef": "sources.tables", "TableDef": "sources.tables", "Workspace": "sources.workspace", "configure": "sources.workspace",
    "Repository": "repository", "is_duplicate_key_error": "repository", "with_batch": "repository", "Update": "plans.compiler", "AggRequest": "operators.aggregate", "Lookup": "operators.lookup",
}
__all__ = [*_HOMES, "filters"]


def __getattr__(name: str):
    if name == "filters":
        return import_module("larkspur.plans.filters")
    if name in _HOMES:
        return getattr(import_module(f"larkspur.{_HOMES[name]}"), name)
    raise AttributeError(name)
