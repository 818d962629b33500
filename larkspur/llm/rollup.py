"""Token counts as delta-maintained rollups.

A change feed of signed rows (inserts, deletes, revised counts) is folded into additive
totals by source, language and tokenizer version. A change carries what was and what is: an
insert has no old side, a delete no new one; a revision may also move a document to another
source, language or version. Each change becomes at most two signed rows, which are summed
per key before they are shuffled, so a hot source costs a row per task.

A batch is committed once, by moving its staged folder to the batch's name, a move that fails
where that name is taken, in one step on file systems like HDFS: of two writers of one name
one commits, the other changes nothing. A commit that died leaves only a staged folder that
nobody reads; a move that fails for any other reason raises and leaves the staged data.
Totals are the sum over committed batches; compact() folds them into a new base that remembers
their names, and drops what it folded only once that base is in place. Of two compactions one
raises and drops nothing. A batch name that the base holds isn't read again.

Defined results: null source, language and version are keys of their own; null counts are
0; an empty batch is a batch; repeated changes in one batch count each; a key whose sums
are all 0 has no row.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fresh_folder, only, stash, table

KEYS = ("source", "lang", "version")
SIDE = "struct<source:string,lang:string,version:string,tokens:bigint>"


def side(source, lang, version, tokens):
    """One side of a change."""
    return F.struct(source.alias("source"), lang.alias("lang"), version.alias("version"), tokens.cast("long").alias("tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """changes (old, new: SIDE structs or null) as signed sums (source, lang, version, docs, tokens)."""
    both = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("s")))).alias("c"))
    rows = both.where("c.s IS NOT NULL").select(*[f"c.s.{k}" for k in KEYS], F.col("c.sign").cast("long").alias("docs"), (F.col("c.sign") * F.coalesce("c.s.tokens", F.lit(0))).alias("tokens"))
    return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return out.where("docs <> 0 OR tokens <> 0")


class Rollup:
    """Totals in a folder of the cluster's shared file system, which must move folders in one step."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        top = self._path(f"{self.folder}/{kind}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _staged(self, label: str) -> str:
        return f"{self.folder}/staged/{fresh_folder(self.spark, label).rpartition('/')[2]}"

    def _move(self, staged: str, to: str) -> bool:
        """Moves a folder to a name; False if that is taken. Raises where the file system fails."""
        jvm, (old, new) = self.spark._jvm, (self._path(f"{x}") for x in (staged, to))
        self._fs.mkdirs(new.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(old, new, no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def _base(self) -> tuple[str | None, DataFrame]:
        """The newest base's totals and the names of the batches that it holds."""
        if not (names := self._names("base")):
            return None, self.spark.createDataFrame([], "batch string")
        at = f"{self.folder}/base/{names[-1]}"
        return f"{at}/totals", self.spark.read.schema("batch string").json(f"{at}/batches")

    def _open(self, held: DataFrame) -> list[str]:
        """Names of the committed batches that no base holds yet."""
        names = self._names("batch")
        return sorted({*names} - {r[0] for r in held.where(F.col("batch").isin(names)).collect()})

    def batches(self) -> DataFrame:
        """(batch): the names of all committed batches."""
        held = self._base()[1]
        return held.unionByName(self.spark.createDataFrame([(b,) for b in self._open(held)], "batch string"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False, and nothing done, if its name has been committed."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._committed(batch):
            return False
        staged = self._staged(batch)
        deltas(changes).write.parquet(staged)
        if not self._move(staged, f"{self.folder}/batch/{batch}"):
            self._fs.delete(self._path(staged), True)
            return False
        return True

    def _committed(self, batch: str) -> bool:
        return batch in self._names("batch") or not self._base()[1].where(F.col("batch") == batch).isEmpty()

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches."""
        base, held = self._base()
        return self._totals(base, self._open(held))

    def _totals(self, base: str | None, names: list[str]) -> DataFrame:
        paths = [base] * bool(base) + [f"{self.folder}/batch/{b}" for b in names]
        schema = "source string, lang string, version string, docs bigint, tokens bigint"
        return _summed(self.spark.read.schema(schema).parquet(*paths)) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Folds all committed batches into a new base, then drops them and the old bases."""
        old, (base, held) = self._names("base"), self._base()
        folded = self._open(held)
        staged, name = self._staged("base"), f"{int(old[-1]) + 1 if old else 0:09d}"
        self._totals(base, folded).write.parquet(f"{staged}/totals")
        held.unionByName(self.spark.createDataFrame([(b,) for b in folded], "batch string")).write.json(f"{staged}/batches")
        if not self._move(staged, f"{self.folder}/base/{name}"):
            raise RuntimeError(f"another compaction wrote base {name} first; what this one staged is in {staged}")
        for b in folded:
            self._fs.delete(self._path(f"{self.folder}/batch/{b}"), True)
        for b in old:
            self._fs.delete(self._path(f"{self.folder}/base/{b}"), True)


def op4_token_rollups(spark, sf_dir):
    """Loads all documents under two tokenizers, revises one, takes short documents down, and
    commits every batch twice."""
    docs = only(table(spark, sf_dir, "documents"), source="source", lang="lang", text="text")
    text = F.coalesce("text", F.lit(""))
    gap = r"[^\x20\x09-\x0D]+"
    runs = F.regexp_count(text, F.lit(r"[A-Za-z]+|[0-9]+"))
    counts = docs.select("source", "lang", F.regexp_count(text, F.lit(gap)).alias("words"), runs.alias("runs"), F.octet_length(text).alias("bytes"))
    counts = stash(counts, "token-counts")
    at = lambda version, n: side(F.col("source"), F.col("lang"), F.lit(version), F.col(n))
    none = F.lit(None).cast(SIDE)
    change = lambda old, new: counts.select(old.alias("old"), new.alias("new"))
    short = counts.where("words < 10")
    gone = short.select(at("words-2", "runs").alias("old"), none.alias("new")).unionByName(short.select(at("bytes-1", "bytes").alias("old"), none.alias("new")))
    feed = {
        "load-words": change(none, at("words-1", "words")),
        "load-bytes": change(none, at("bytes-1", "bytes")),
        "revise-words": change(at("words-1", "words"), at("words-2", "runs")),
        "take-down": gone,
    }
    rollup = Rollup(spark, fresh_folder(spark, "rollup"))
    for _ in range(2):
        for name, changes in feed.items():
            rollup.commit(name, changes)
    return rollup.totals()


SQL = r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+')) AS runs, strlen(t) AS bytes FROM d)
SELECT source, lang, v.version, count(*)::BIGINT AS docs, sum(CASE v.version WHEN 'words-2' THEN runs ELSE bytes END)::BIGINT AS tokens
FROM c, (VALUES ('words-2'), ('bytes-1')) v(version) WHERE words >= 10 GROUP BY ALL
"""
