"""Mixing sources to target weights.

Tokens are aggregated per source, a water-filling pass turns weights into targets, and the
ratio of target to size is the source's repetition rate: each document is emitted
floor(rate) times, plus one copy by a hash of seed and document id whose probability is the
rate's fraction.

The copies of a source are drawn in strata of sizes, powers of two, from the longest documents
to the shortest. A stratum takes its documents in order of their hash, as many as its share of
them says; the last cell of hashes, of CELLS, is taken or not by a hash of source and stratum, so
that they are as many on average. The share is the fraction, plus what the strata before gave
short or over in tokens: on average nothing, so a document's own probability stays the fraction,
while errors don't add up over a source but are made good by its shorter documents. What is
handed down is scaled, by sizes alone and not by what was drawn, to what the next stratum can
make good; the share is cut to 0 and 1 in the rare case that it can't. Sums by source, stratum and
cell are all that is shuffled.

Defined results: a null text has size 0; a null source is a source of its own, ordered
last; sources without words have target 0 and no copies; documents without words are drawn one
by one; an empty table gives an empty table; repeated ids draw the same number, so copies of a
row fare alike, and null ids draw by their text; very long texts are strata of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import only, stash, table, words

#: Sources up to this many are broadcast (a row each of under 1 KB); more are joined by key.
BROADCAST_SOURCES = 10_000
#: Cells of the hash that order a stratum's documents.
CELLS = 256


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order take the weights in turn. share times all sizes is dealt out
    by weight; what exceeds most times a source's size is dealt anew to the others. With
    caps c and weights w the result is min(c, level * w): sorted by c / w, the level is that
    of the first source that its share doesn't fill, and the greatest of those there are.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # One row per source from here on, not per document.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    capped = total.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("fill").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        capped.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
        .withColumn("at", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every))
    )
    return level.select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("w"))).alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of seed and key; the same in every run."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), key), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def document_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))


def stratum(size: Column) -> Column:
    """The power of two that a size reaches; -1 for none."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(-1)


def _fraction(target: Column, size: Column) -> Column:
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    return rate - F.floor(rate)


def quotas(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """(source, source_size, target, upto) of rows (source, size, u): one row a source. upto maps a
    stratum to the first cell of hashes that gets no more copy."""
    size, cell = F.col("size"), F.floor(F.col("u") * CELLS).cast("int")
    figures = [F.sum(size).alias("size"), F.count(size).alias("n"), F.sum(size * size).alias("sq"), F.max(size).alias("top")]
    sums = stash(sizes.groupBy("source", stratum(size).alias("b"), cell.alias("cell")).agg(*figures), "mix-sums")
    by_cell = Window.partitionBy("source", "b").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = sums.where("b >= 0").withColumns({"after": F.sum("n").over(by_cell), "after_size": F.sum("size").over(by_cell)})
    each = F.struct("cell", (F.col("after") - F.col("n")).alias("before"), "after", (F.col("after_size") - size).alias("before_size"), "after_size")
    whole = [F.sum("n").alias("n"), F.sum("size").alias("total"), F.sum("sq").alias("sq"), F.max("top").alias("top")]
    strata = cells.groupBy("source", "b").agg(F.sort_array(F.collect_list(each)).alias("cells"), *whole)
    per_source = strata.groupBy(F.col("source").alias("_source")).agg(F.sort_array(F.collect_list(F.struct("b", "n", "total", "sq", "top", "cells")), False).alias("strata"))
    targets = source_targets(sums, weights, share, most)
    joined = targets.join(per_source, targets["source"].eqNullSafe(per_source["_source"]), "left")
    owed = _fraction(F.col("target"), F.col("source_size"))
    one, zero = F.lit(1.0), F.lit(0.0)

    def step(state: Column, s: Column) -> Column:
        # bound: of the carry, about, whatever was drawn; room: what this stratum can give or save beyond its own share.
        room = F.least(owed, one - owed) * s["total"]
        part = F.when(state["bound"] > room, room / state["bound"]).otherwise(one)
        due = F.least(F.greatest(owed + state["carry"] * part / s["total"], zero), one) * s["n"]
        last = F.element_at(F.filter(s["cells"], lambda c: c["before"] < due), -1)
        chance = (due - last["before"]) / (last["after"] - last["before"])
        every = draw(F.concat(F.coalesce("source", F.lit("null")), F.lit("/"), s["b"].cast("string")), seed) < chance
        given = F.when(due <= 0, F.lit(0)).when(every, last["after_size"]).otherwise(last["before_size"])
        end = F.when(due <= 0, F.lit(0)).when(every, last["cell"] + 1).otherwise(last["cell"])
        spread = s["top"] * (one + s["n"] / F.lit(64.0)) + F.sqrt(F.greatest(s["sq"] - s["total"] * one * s["total"] / s["n"], zero))
        upto = F.array_append(state["upto"], F.struct(s["b"].alias("b"), end.cast("int").alias("end")))
        return F.struct((state["carry"] + owed * s["total"] - given).alias("carry"), (state["bound"] * (one - part) + spread).alias("bound"), upto.alias("upto"))

    start = F.struct(zero.alias("carry"), zero.alias("bound"), F.array().cast("array<struct<b:int,end:int>>").alias("upto"))
    strata = F.coalesce("strata", F.array().cast(per_source.schema["strata"].dataType))
    upto = F.aggregate(strata, start, step, lambda s: F.map_from_entries(s["upto"]))
    return stash(joined.select("source", "source_size", "target", upto.alias("upto")), "mix-quotas")


def with_copies(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """rows (source, size, u and others) with source_size, target and copies. The quotas have a row
    per source: they are broadcast behind a count of the sources, and joined by key beyond it."""
    few = quotas.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    q = quotas.withColumnRenamed("source", "_source")
    out = rows.join(F.broadcast(q) if few else q, rows["source"].eqNullSafe(q["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = F.coalesce(F.try_element_at("upto", stratum(F.col("size"))), F.lit(0))
    more = F.when(F.col("size") > 0, F.floor(F.col("u") * CELLS) < end).otherwise(F.col("u") < rate - F.floor(rate))
    return out.withColumn("copies", (F.floor(rate) + more.cast("int")).cast("long")).drop("upto")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, text) as rows (doc_id, size, source_size, target, copies, taken)."""
    sized = stash(_sized(only(docs, doc_id="doc_id", source="source", text="text"), seed).drop("text"), "mix-sizes")
    out = with_copies(sized, quotas(sized, weights, share, most, seed))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.withColumns({"size": F.size(words(F.col("text"))).cast("long"), "u": draw(document_key(F.col("doc_id"), F.col("text")), seed)})


def mixed_documents(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs with all their columns, each emitted as often as it is taken."""
    packed = docs.select(F.struct("*").alias("row"))
    named = packed.select("row", *[F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text")])
    sized = _sized(named, seed).drop("text", "doc_id")
    out = with_copies(sized, quotas(sized.select("source", "size", "u"), weights, share, most, seed))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM documents),
p AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS b, floor(u * 256)::INT AS cell FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS fill, (SELECT sum(size) FROM d)::DOUBLE * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= fill) * w, cap)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
h AS (SELECT source, b, cell, sum(size)::BIGINT AS size, count(*)::BIGINT AS n, sum(size * size)::DOUBLE AS sq, max(size) AS top FROM p WHERE size > 0 GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY source, b ORDER BY cell)::BIGINT AS after, sum(size) OVER (PARTITION BY source, b ORDER BY cell)::BIGINT AS after_size FROM h),
g AS (SELECT source, b, sum(n)::DOUBLE AS n, sum(size)::DOUBLE AS total, sum(sq) AS sq, max(top)::DOUBLE AS top, row_number() OVER (PARTITION BY source ORDER BY b DESC) AS k,
        ('0x' || substr(sha256('mix:' || coalesce(source, 'null') || '/' || b::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS v FROM h GROUP BY source, b),
q AS (
  SELECT source, 0::BIGINT AS k, -1 AS b, 0 AS upto, 0.0::DOUBLE AS carry, 0.0::DOUBLE AS bound, rate - floor(rate) AS owed FROM r
  UNION ALL
  SELECT source, k, b, CASE WHEN due <= 0 THEN 0 WHEN v < chance THEN x.cell + 1 ELSE x.cell END,
    carry + owed * total - CASE WHEN due <= 0 THEN 0 WHEN v < chance THEN x.after_size ELSE x.before_size END,
    bound * (1.0::DOUBLE - part) + (top * (1.0::DOUBLE + n / 64.0::DOUBLE) + sqrt(greatest(sq - total * total / n, 0.0::DOUBLE))), owed
  FROM (SELECT *, (due - x.before) / (x.after - x.before) AS chance FROM (
    SELECT *, (SELECT max({'cell': e.cell, 'before': e.after - e.n, 'after': e.after, 'before_size': e.after_size - e.size, 'after_size': e.after_size}) FROM e
       WHERE e.source IS NOT DISTINCT FROM o.source AND e.b = o.b AND e.after - e.n < o.due) AS x
    FROM (SELECT *, least(greatest(owed + carry * part / total, 0.0::DOUBLE), 1.0::DOUBLE) * n AS due FROM (
      SELECT q.source, q.carry, q.bound, q.owed, g.k, g.b, g.v, g.n, g.total, g.sq, g.top,
        CASE WHEN q.bound > least(q.owed, 1.0::DOUBLE - q.owed) * g.total THEN least(q.owed, 1.0::DOUBLE - q.owed) * g.total / q.bound ELSE 1.0::DOUBLE END AS part
      FROM q JOIN g ON g.source IS NOT DISTINCT FROM q.source AND g.k = q.k + 1)) o)))
SELECT p.doc_id, p.size, r.source_size, r.target::DOUBLE AS target,
  (p.size * (floor(r.rate) + CASE WHEN p.size > 0 AND p.cell < q.upto THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source LEFT JOIN q ON q.k > 0 AND q.source IS NOT DISTINCT FROM p.source AND q.b = p.b
"""
