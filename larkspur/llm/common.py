"""Shared pieces: the word definition, table loading and lineage cuts in shared storage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shared import shared_folder
from larkspur.sources.shipping import ship

#: Bytes that part words; a word is a maximal run of anything else.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The array of words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; nothing is created."""
    return f"{shared_folder(spark)}/larkspur/{label}-{uuid.uuid4().hex}"


#: Narrow rows (ids, labels, figures) of a file, where their number is known.
FILE_ROWS = 200_000


def stash(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lineage cut that outlives executors.

    most_rows: a bound of how many narrow rows there are; where they are few, they are written by
    as few tasks, as each file costs a file system more than its rows do."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    if most_rows is not None and (files := max(1, -(-most_rows // FILE_ROWS))) < shuffle_parts(spark):
        df = df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Removes tables that stash() wrote, once nothing reads them any more."""
    for df in stashed:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stash)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark removes the shuffle files of a finished job only when
    nothing refers to its plan any more, which may otherwise take half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: binds it as a lambda variable, so that the
    optimizer can't copy its expression into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only(df: DataFrame, **columns) -> DataFrame:
    """The named inputs alone, under names of ours: extra columns, whatever their names, go."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


#: Rows of an Arrow batch where the session has Spark's default, which is meant for narrow rows.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(), with this package on the executors and batches that suit whole texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
