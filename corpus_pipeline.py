"""The corpus pipeline: five stages over documents, each on all that the one before kept.

Quality rules reject documents; of each group of near duplicates one stays; repeated passages
are cut from the texts; sources are mixed to target weights; the mix is encoded and decoded.
A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared
folder as Parquet and rereads it.

Defined results: only the five columns of documents are read; other columns, whatever their
names, are left out; an empty table gives an empty table; null texts fail the quality rules, and
texts of any length are taken whole. Verdicts are of rows. A row whose id is null or another
row's too is judged by a number of its own, beyond all ids, so that of a group of near duplicates
a row with an id of its own stays, if there is one, and the smallest such id. The later stages
take rows of equal ids in order of their text; null sources are a source, null languages a group
of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, mixing, neardup, quality, substrings
from larkspur.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which no two rows share: doc_id, or beyond all ids where that is null or repeated."""
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    repeated = stash(ids.where("n > 1").select("_id"), "repeated-ids")
    if repeated.isEmpty() and docs.where("doc_id IS NULL").isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    beyond = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    # Rows without an id aren't joined: they would meet in one task.
    known = docs.where("doc_id IS NOT NULL").join(repeated, F.col("doc_id") == F.col("_id"), "left")
    rows = known.unionByName(docs.where("doc_id IS NULL").withColumn("_id", F.lit(None).cast("long")))
    own = F.col("doc_id").isNotNull() & F.col("_id").isNull()
    key = F.when(own, F.col("doc_id")).otherwise(F.lit(beyond) + F.monotonically_increasing_id())
    return stash(rows.withColumn("_key", key).drop("_id"), "keyed-documents")


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that judge (rows of doc_id and kept, from documents) keeps."""
    docs = _keyed(docs.select(*COLUMNS))
    gone = judge(docs.withColumn("doc_id", F.col("_key")).select(*COLUMNS)).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["_key"] == gone["_gone"], "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, quality.judge)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda d: neardup.near_duplicates(d, k=5, percent=80))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.dedup(docs, keep=("lang", "source"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mix sources", mix_sources),
    ("byte-level BPE", encode_bytes),
]

#: Robust estimates, likelihood and tokenization have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
