"""Errors that callers may want to tell apart."""


class LarkspurError(ValueError):
    """Any refusal of this library."""


class UnknownColumn(LarkspurError):
    def __init__(self, column: str, stage: str, known=()):
        super().__init__(f"{stage}: unknown column {column!r}; known: {', '.join(known)}")
        self.column, self.stage = column, stage


class UnknownTable(LarkspurError):
    def __init__(self, table: str):
        super().__init__(f"no table {table!r}: register it in the workspace, or pass it in the lookup's registry")


class DuplicateKeyError(LarkspurError):
    def __init__(self, table: str, columns):
        super().__init__(f"duplicate key in {table}: {', '.join(columns)}")
        self.table, self.columns = table, tuple(columns)


class ConstraintError(LarkspurError):
    """A NOT NULL or enum constraint was broken."""


class ReadOnlyError(LarkspurError):
    """A write through a read-only workspace."""


class ConflictError(LarkspurError):
    """Another writer committed first."""
