"""Versioned tables with atomic commits over several tables.

A table's version is a list of layers, immutable Parquet folders: the rows that came, and the
keys whose earlier rows went. A write adds a layer of its own size; a reader merges them, a
row being there unless a later layer names its key. Beyond MOST_LAYERS a commit writes the
table whole. A catalog file lists the layers of every table; a commit writes its layers, then
creates the next catalog file by a rename that fails if another writer was first. Readers see
the catalog that they opened: snapshot reads, no partial commits. Everything goes through
Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import ConflictError, LarkspurError

#: Layers of a table before it is written whole again.
MOST_LAYERS = 24
#: Writes to a table in memory after which its plan is cut, where the session has a checkpoint folder.
MOST_WRITES = 32


@dataclass(frozen=True)
class Delta:
    """A change of a table: rows that come, and keys (a column named as the table's key) whose
    earlier rows go."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


#: What a commit takes for a table: all its rows, changes in order, or None to drop it.
Change = DataFrame | Sequence[Delta] | None


class MemoryStore:
    """Tables as lazy DataFrames: a commit is an assignment. It takes whole tables alone."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self._tables, self.version, self._writes = spark, dict(tables or {}), 0, {}

    def names(self) -> list[str]:
        return sorted(self._tables)

    def read(self, name: str) -> DataFrame:
        return self._tables[name]

    def commit(self, changed: Mapping[str, Change], seen: int) -> int:
        if seen != self.version:
            raise ConflictError("the tables changed since this transaction began")
        for name, df in changed.items():
            if df is None:
                self._tables.pop(name, None)
            else:
                self._tables[name] = self._cut(name, df)
        self.version += 1
        return self.version

    def _cut(self, name: str, df: DataFrame) -> DataFrame:
        """df, its plan cut now and then by a checkpoint, in the folder that the cluster names."""
        n = self._writes[name] = self._writes.get(name, 0) + 1
        context = self.spark.sparkContext._jsc.sc()
        if n % MOST_WRITES or not (folder := self.spark.conf.get("spark.checkpoint.dir", None)) and context.getCheckpointDir().isEmpty():
            return df
        if context.getCheckpointDir().isEmpty():
            context.setCheckpointDir(folder)
        return df.checkpoint()

    def takes_layers(self, name: str, key: str | None) -> bool:
        return False

    def compact(self, keep: int = 1) -> dict:
        return {"tables": len(self._tables), "removed": 0}


class FileStore:
    """Tables in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._checked = spark, root.rstrip("/"), {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/catalog"))

    def _versions(self) -> list[int]:
        return sorted(int(x.getPath().getName()[:-5]) for x in self._fs.listStatus(self._path(f"{self.root}/catalog")) if x.getPath().getName().endswith(".json"))

    def _catalog(self, version: int) -> dict[str, dict]:
        """By table: its key, whether that is known to be unique, and its layers."""
        if not version:
            return {}
        text = self.spark.read.text(f"{self.root}/catalog/{version:012d}.json", wholetext=True).first()
        return json.loads(text[0])

    @property
    def version(self) -> int:
        return (self._versions() or [0])[-1]

    def names(self) -> list[str]:
        return sorted(self._catalog(self.version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        catalog = self._catalog(self.version if version is None else version)
        if name not in catalog:
            raise LarkspurError(f"no table {name!r} in {self.root}")
        return self._merged(catalog[name])

    def _merged(self, entry: Mapping) -> DataFrame:
        layers, key = entry["layers"], entry["key"]
        at = lambda folder: f"{self.root}/{folder}"
        schema = self.spark.read.parquet(at(layers[0]["rows"])).schema
        read = self.spark.read.schema(schema)
        gone = [(i, x["gone"]) for i, x in enumerate(layers) if x.get("gone")]
        if not gone:
            return read.parquet(*[at(x["rows"]) for x in layers if x.get("rows")])
        rows = reduce(DataFrame.unionByName, [read.parquet(at(x["rows"])).withColumn("_layer", F.lit(i)) for i, x in enumerate(layers) if x.get("rows")])
        keys = reduce(DataFrame.unionByName, [self.spark.read.parquet(at(x)).select(F.col(key).alias("_key"), F.lit(i).alias("_last")) for i, x in gone])
        last = keys.groupBy("_key").agg(F.max("_last").alias("_last"))
        stays = F.col("_last").isNull() | (F.col("_layer") >= F.col("_last"))
        return rows.join(last, rows[key] == last["_key"], "left").where(stays).select(*[F.col(f"`{c}`") for c in schema.names])

    def takes_layers(self, name: str, key: str | None) -> bool:
        """Whether the table is here, and its key names one row (key None: rows are only added)."""
        entry = self._catalog(self.version).get(name)
        if entry is None or key is None or entry["key"] == key and entry["unique"]:
            return entry is not None
        if (name, self.version) not in self._checked:
            ids = self._merged(entry).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            self._checked[name, self.version] = ids.where(f"n > 1 OR `{key}` IS NULL").isEmpty()
        return self._checked[name, self.version]

    def _write(self, name: str, df: DataFrame | None, written: list[str]) -> str | None:
        if df is None:
            return None
        at = f"tables/{name}/{uuid.uuid4().hex}"
        written.append(at)
        df.write.parquet(f"{self.root}/{at}")
        return at

    def commit(self, changed: Mapping[str, Change], seen: int) -> int:
        """Writes the changes (None: the table is dropped), then swings the catalog; nothing shows before."""
        catalog, written = self._catalog(seen), []
        try:
            for name, change in changed.items():
                if change is None:
                    catalog.pop(name, None)
                    continue
                if isinstance(change, DataFrame):
                    catalog[name] = {"key": None, "unique": False, "layers": [{"rows": self._write(name, change, written)}]}
                    continue
                entry = catalog[name]
                for d in change:
                    if d.gone is not None:
                        entry |= {"key": d.gone.columns[0], "unique": True}
                    layer = {"rows": self._write(name, d.rows, written), "gone": self._write(name, d.gone, written)}
                    entry["layers"].append({k: v for k, v in layer.items() if v})
                if len(entry["layers"]) > MOST_LAYERS:
                    entry["layers"] = [{"rows": self._write(name, self._merged(entry), written)}]
            staged = self._path(f"{self.root}/catalog/.{uuid.uuid4().hex}")
            out = self._fs.create(staged)
            out.write(bytearray(json.dumps(catalog, sort_keys=True).encode()))
            out.close()
            target = self._path(f"{self.root}/catalog/{seen + 1:012d}.json")
            if self._fs.exists(target) or not self._fs.rename(staged, target):
                self._fs.delete(staged, False)
                raise ConflictError("another writer committed first")
        except BaseException:
            for at in written:
                self._fs.delete(self._path(f"{self.root}/{at}"), True)
            raise
        return seen + 1

    def layers(self, name: str) -> int:
        return len(self._catalog(self.version)[name]["layers"])

    def compact(self, keep: int = 1) -> dict:
        """Removes catalogs but the last `keep`, and the table versions that none of those names."""
        versions = self._versions()
        kept = versions[-keep:]
        held = {at for v in kept for entry in self._catalog(v).values() for x in entry["layers"] for at in x.values()}
        removed = 0
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/catalog/{v:012d}.json"), False)
        top = self._path(f"{self.root}/tables")
        for table in self._fs.listStatus(top) if self._fs.exists(top) else []:
            for x in self._fs.listStatus(table.getPath()):
                at = f"tables/{table.getPath().getName()}/{x.getPath().getName()}"
                if at not in held:
                    self._fs.delete(x.getPath(), True)
                    removed += 1
        return {"tables": len({at.split('/')[1] for at in held}), "removed": removed}

    def size(self, name: str) -> tuple[int, int]:
        """(files, bytes) of a table's current version."""
        entry = self._catalog(self.version)[name]
        parts = [self._fs.getContentSummary(self._path(f"{self.root}/{at}")) for x in entry["layers"] for at in x.values()]
        return sum(p.getFileCount() for p in parts), sum(p.getLength() for p in parts)
