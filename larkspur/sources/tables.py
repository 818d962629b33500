"""Table definitions: columns, keys, defaults, indexes, and rows as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.errors import ConstraintError, LarkspurError, UnknownColumn


#: Logical types and the Spark types that they are by default.
_KINDS = {
    "string": T.StringType,
    "boolean": T.BooleanType,
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.FloatType, T.DoubleType, T.DecimalType),
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "buffer": T.BinaryType,
}


@dataclass(frozen=True)
class ColumnDef:
    """mode: how the logical type is meant (json, date, boolean, number, integer, string, buffer, vector)."""

    type: T.DataType
    nullable: bool = True
    default: Any = None
    length: int | None = None
    enum: tuple = ()
    mode: str | None = None
    dim: int | None = None

    @property
    def kind(self) -> str:
        if self.mode:
            return self.mode
        for name, types in _KINDS.items():
            if isinstance(self.type, types):
                return name
        return "custom"


@dataclass(frozen=True)
class IndexDef:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    where: str | None = None
    auto: bool = False


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: Mapping[str, ColumnDef]
    pk: str
    unique: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[IndexDef, ...] = ()
    autoincrement: bool = False
    _: Any = field(default=None, repr=False)

    def __post_init__(self):
        if self.pk not in self.columns:
            raise LarkspurError(f"{self.name}: no primary key column; name one of {', '.join(self.columns)}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, c.type, True) for k, c in self.columns.items()])

    @classmethod
    def of(cls, name: str, df: DataFrame, pk: str, **more) -> TableDef:
        """A definition from a DataFrame's schema."""
        return cls(name, {x.name: ColumnDef(x.dataType, x.nullable) for x in df.schema}, pk, **more)

    def with_index(self, index: IndexDef) -> TableDef:
        return replace(self, indexes=(*[i for i in self.indexes if i.name != index.name], index))

    def without_index(self, name: str) -> TableDef:
        return replace(self, indexes=tuple(i for i in self.indexes if i.name != name))

    def unique_keys(self) -> list[tuple[tuple[str, ...], str | None]]:
        """(columns, partial predicate) of all that must be unique."""
        return [((self.pk,), None), *[(u, None) for u in self.unique], *[(i.columns, i.where) for i in self.indexes if i.unique]]

    def complete(self, row: Mapping[str, Any]) -> dict[str, Any]:
        """The row with defaults; unknown columns, missing values and values off the enum raise."""
        for k in row:
            if k not in self.columns:
                raise UnknownColumn(k, "insert", self.columns)
        out = {}
        for k, c in self.columns.items():
            v = row.get(k) if k in row else (c.default() if callable(c.default) else c.default)
            if v is None and not c.nullable and not (k == self.pk and self.autoincrement):
                raise ConstraintError(f"{self.name}.{k} must not be null")
            if v is not None and c.enum and v not in c.enum:
                raise ConstraintError(f"{self.name}.{k}: {v!r} is none of {c.enum}")
            out[k] = v
        return out

    def frame(self, spark: SparkSession, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Complete rows as a DataFrame of this schema."""
        return spark.createDataFrame([tuple(_fitted(r[k], c.type) for k, c in self.columns.items()) for r in rows], self.schema)


def _fitted(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(v, int):
        return float(v)
    if isinstance(kind, T.BooleanType) and isinstance(v, int):
        return bool(v)
    return v
