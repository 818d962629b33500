"""URL filters: host and path rules, then a Bloom filter cascade over the key universe.

Level 0 of the cascade encodes the listed keys; level 1 the other keys of the universe that
level 0 takes for listed; level 2 the listed keys that level 1 takes for false positives,
and so on until no key errs. A key's membership is decided by the first level that lacks
it: even levels deny, odd levels affirm. Over the universe it was built from, that is exact.

A probe reads the levels as scalar subqueries: no join, no Python. A level has BITS bits a
key, rounded up to 64. Where one would exceed MOST_BITS, keys are dealt by their hash into
shards, each with a cascade of its own, and a table is marked shard by shard: no broadcast
and no driver ever holds more than one shard's levels.

Defined results: a null url, or one without ://, has empty host and path, no rule, and isn't
listed; null and empty keys never enter the universe and are never listed, whatever bits they
hit; repeated keys count once, listed if any row of theirs is; no listed keys make an empty
cascade, which denies all; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, fresh_folder, only, stash, table

BITS = 10
HASHES = (5, 1)  # of level 0, of the levels after it
MOST_BITS = 1 << 28
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(key: Column, level: int, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(n_bits)) for i in range(HASHES[min(level, 1)])]


def _level(keys: DataFrame, level: int, n_bits: int) -> DataFrame:
    """One row: the level's bits as 64-bit words. Bits are or-ed by word before they meet."""
    bits = keys.select(F.explode(F.array(*_bits(F.col("key"), level, n_bits))).alias("b"))
    bits = bits.select(F.floor(F.col("b") / 64).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m"))
    ored = bits.groupBy("w").agg(F.bit_or("m").alias("m"))
    every = keys.sparkSession.range(n_bits // 64).withColumnRenamed("id", "w").join(ored, "w", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0)).alias("m")))).alias("x")).select(F.col("x.m").alias("bits"))


class Overflow(ValueError):
    """A level would have more bits than it may."""


class Cascade:
    """Exact membership over a universe: build(), then contains(key) as a column."""

    def __init__(self, levels: list[tuple[DataFrame, int]]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, bits: int = BITS, most_bits: int = MOST_BITS) -> Cascade:
        """universe: rows (key, listed). Raises Overflow where a level would pass most_bits."""
        return cls._of(_universe(universe), bits, most_bits)

    @classmethod
    def _of(cls, u: DataFrame, bits: int, most_bits: int) -> Cascade:
        levels: list[tuple[DataFrame, int]] = []
        # Who is to be encoded next, and who may be taken for it by mistake.
        inside, outside = u.where("listed").select("key"), u.where("not listed").select("key")
        written: list[DataFrame] = []
        while n := inside.count():
            n_bits = 64 * math.ceil(n * bits / 64)
            if n_bits > most_bits:
                raise Overflow(f"a level of {n_bits} bits")
            words = stash(_level(inside, len(levels), n_bits), "url-level")
            levels.append((words, n_bits))
            wrong = outside.where(cls._probe(F.col("key"), words, len(levels) - 1, n_bits))
            inside, outside = stash(wrong, "url-errors"), inside
            written.append(inside)
        discard(*written)
        return cls(levels)

    @staticmethod
    def _probe(key: Column, words: DataFrame, level: int, n_bits: int) -> Column:
        hit = F.lit(True)
        for b in _bits(key, level, n_bits):
            word = F.element_at(words.scalar(), (F.floor(b / 64) + 1).cast("int"))
            hit = hit & (F.call_function("shiftrightunsigned", word, (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return hit

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            words, n_bits = self.levels[i]
            out = F.when(self._probe(key, words, i, n_bits), out).otherwise(F.lit(i % 2 == 1))
        return F.when(key.isNull() | (key == ""), False).otherwise(out)


def _universe(rows: DataFrame) -> DataFrame:
    """The distinct keys of rows (key, listed)."""
    keys = rows.where("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.coalesce(F.max("listed"), F.lit(False)).alias("listed"))
    return stash(keys, "url-universe")


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), F.coalesce(key, F.lit(""))), F.lit(shards)).cast("int")


def _dealt(df: DataFrame, key: str, shards: int, label: str) -> list[DataFrame]:
    """df by shard of its key: written once, a folder a shard."""
    spark, at = df.sparkSession, fresh_folder(df.sparkSession, label)
    n = _free("shard", df.columns)
    df.withColumn(n, _shard(df[key], shards)).write.partitionBy(n).parquet(at)
    every = spark.read.schema(df.withColumn(n, F.lit(0)).schema).parquet(at)
    return [every.where(F.col(n) == i).drop(n) for i in range(shards)]


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def mark_listed(df: DataFrame, key: str, name: str, universe: DataFrame, bits: int = BITS, most_bits: int = MOST_BITS) -> DataFrame:
    """df with a boolean column: is its key listed in the universe (key, listed)?"""
    u = _universe(universe)
    n = u.agg(F.count(F.lit(1)).alias("all"), F.count_if("listed").alias("listed")).first()
    # Level 0 holds the listed keys, level 1 those others that it takes for listed; shards are about even.
    wrong = (1 - math.exp(-HASHES[0] / bits)) ** HASHES[0]
    shards = max(1, math.ceil(1.1 * bits * max(n["listed"], wrong * (n["all"] - n["listed"])) / most_bits))
    while True:
        try:
            if shards == 1:
                return df.withColumn(name, Cascade._of(u, bits, most_bits).contains(F.col(key)))
            cascades = [Cascade._of(part, bits, most_bits) for part in _dealt(u, "key", shards, "url-universe")]
            break
        except Overflow:
            shards *= 2
    spark, at = df.sparkSession, fresh_folder(df.sparkSession, "url-marked")
    for part, cascade in zip(_dealt(df, key, shards, "url-rows"), cascades, strict=True):
        marked = part.withColumn(name, cascade.contains(F.col(key)))
        marked.write.mode("append").parquet(at)
    return spark.read.schema(marked.schema).parquet(at)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """pages (page_id, url) as rows (page_id, host, path, rule, verdict, listed).

    listed: rows (key), each a host followed by a path, to be blocked where no rule fits."""
    named = only(pages, page_id="page_id", host=host(pages["url"]), path=path(pages["url"])).withColumn("key", F.concat("host", "path"))
    universe = named.where("key <> ''").select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = mark_listed(named, "key", "listed", universe, most_bits=most_bits).withColumn("_rule", rule)
    verdict = F.coalesce("_rule.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")


def op7_url_filters(spark, sf_dir):
    """Lists the keys of hosts with a hyphen, as in names strung together from search words."""
    pages = table(spark, sf_dir, "pages")
    keys = pages.select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"))
    return judge(pages, keys.where(F.col("h").contains("-")).select(F.concat("h", "p").alias("key")).distinct())


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
        contains(host, '-') AS listed FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
