"""Quality rules: base statistics of a text, then robust multivariate outliers.

Documents that pass the base rules are described by four transformed statistics. Per
language and source a regularised minimum-covariance-determinant estimate gives centre and
scatter; a document whose squared Mahalanobis distance exceeds a high chi-square quantile is
rejected.

The estimate has six starts: all rows, those without symbols and repeats to speak of, and four
draws of about ten rows by hash. Two concentration steps are made from each, then more from the
two of least determinant a group. A step takes exactly COVERAGE of a group's rows, those of
least distance; a consistency factor corrects their scatter. Most statistics are 0 for most
texts, so the scatter of the rows taken is regularised by a target: least standard deviations,
correlated as the statistics are over the whole table, within groups.

Built of DataFrame functions alone. A concentration step is one partial aggregation: rows
are summed into logarithmic bins of their distance, and the sums of the bin in which COVERAGE
is reached count by the share that is taken of it; so a group's rows are never sorted. The
statistics are rounded to 1/1024 and summed as integers, so the estimates don't depend on
the partitioning.

Defined results: null and empty texts have no words and fail the base rules; null language
or source form groups of their own; a group of equal rows has the target as its scatter and
rejects none of them; repeated rows are judged each; very long texts are judged whole; an empty
table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import discard, let, only, stash, table, words

UNIT = 1024
#: Least standard deviations of the transformed statistics: log word length, and log shares
#: in per cent of symbols, repeated lines and repeated words. Where a group has no spread of its
#: own, a share of 10 % symbols, 22 % lines or 16 % words (of the steadied sums below) is rejected
#: on its own; the base rules let 20 % of the words pass.
FLOOR = (0.06, 0.5, 0.65, 0.58)
#: 0.9999 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 23.513
COVERAGE = 0.75
#: Up to so many groups the estimates (six rows of some 150 bytes each) are broadcast.
BROADCAST_GROUPS = 20_000
#: Draws by hash of about so many rows a group; concentration steps from all starts, then from the best.
DRAWS, DRAWN = 4, 10
FIRST_STEPS, STEPS, BEST = 2, 4, 2
#: Share of the table's correlations in the target's; below 1, so that it has an inverse.
CORRELATED = 0.95
#: Words, word characters, lines that steady the ratios of short texts.
STEADY_WORDS, STEADY_CHARS, STEADY_LINES = 100, 100, 10


def repeated_words(ws: Column, k: int = 5) -> Column:
    """How many words lie in k-word windows found twice or more in the array, first included.

    Windows are compared by a 64-bit hash within their one text; texts without a repeated
    hash, most of them, stop after one distinct()."""
    each = F.transform(ws, lambda w: F.xxhash64(w))
    windows = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])), 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))
    hashes = let(each, windows)

    def covered(sorted_pairs: Column) -> Column:
        twice = F.filter(sorted_pairs, lambda p, j: (F.get(sorted_pairs, j - 1)["h"] == p["h"]).__or__(F.get(sorted_pairs, j + 1)["h"] == p["h"]))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        step = lambda a, s: F.struct((a["n"] + s + k - F.greatest(a["end"], s.cast("long"))).alias("n"), (s + k).cast("long").alias("end"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return let(hashes, count)


def base_statistics(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    t = only(docs, doc_id="doc_id", lang="lang", source="source", text=F.coalesce(docs["text"], F.lit("")))
    wordy = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    t = t.withColumns({"ws": words(F.col("text")), "lines": wordy, "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long")})
    return t.select(
        "doc_id", "lang", "source",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("ws"), lambda ws: repeated_words(ws, k)).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _transformed(stats: DataFrame, few: bool) -> DataFrame:
    """Adds gkey and the integers q0..q3 (transformed statistics in units of 1/1024)."""
    keyed = stats.withColumn("gkey", F.to_json(F.struct("lang", "source")))
    mean = keyed.where(~F.col("base_failed")).groupBy("gkey").agg((F.sum("word_chars") / F.sum("n_words")).alias("m"))
    keyed = _joined(keyed, mean, ["gkey"], few, "left").withColumn("m", F.coalesce("m", F.lit(5.0)))
    share = lambda a, b: F.log1p(100.0 * a / b)
    x = (
        F.log((F.col("word_chars") + STEADY_WORDS * F.col("m")) / (F.col("n_words") + STEADY_WORDS)),
        share(F.col("n_symbols"), F.col("word_chars") + STEADY_CHARS),
        share(F.col("n_dup_lines"), F.col("n_lines") + STEADY_LINES),
        share(F.col("n_repeat_words"), F.col("n_words") + STEADY_WORDS // 5),
    )
    return keyed.withColumns({f"q{j}": F.round(v * UNIT).cast("long") for j, v in enumerate(x)}).drop("m")


def consistency(p: int, coverage: float) -> float:
    """coverage / P(chi2(p+2) <= chi2 quantile(p)), for even p."""
    cdf = lambda x, d: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, p) < coverage else (lo, mid)
    return coverage / cdf(lo, p + 2)


def _moments(p: int) -> list[Column]:
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(f"q{j}").alias(f"s{j}") for j in range(p)]
    return sums + [F.sum(F.col(f"q{j}") * F.col(f"q{k}")).alias(f"s{j}_{k}") for j in range(p) for k in range(j + 1)]


def scatter_target(sums: DataFrame, floor) -> list[list[float]]:
    """The regularising scatter: floor as standard deviations, correlated as rows are within groups.

    sums: _moments() by group, a row each; ten figures come back."""
    p = len(floor)
    pairs = [(j, k) for j in range(p) for k in range(j + 1)]
    within = sums.agg(*[F.sum(F.col(f"s{j}_{k}") - F.col(f"s{j}") / F.col("n") * F.col(f"s{k}")).alias(f"v{j}_{k}") for j, k in pairs]).first()
    v = {(j, k): within[f"v{j}_{k}"] or 0.0 for j, k in pairs}

    def correlation(j: int, k: int) -> float:
        j, k = max(j, k), min(j, k)
        if j == k:
            return 1.0
        size = math.sqrt(max(v[j, j], 0.0) * max(v[k, k], 0.0))
        return round(CORRELATED * max(-1.0, min(1.0, v[j, k] / size)), 6) if size else 0.0

    return [[floor[j] * floor[k] * correlation(j, k) for k in range(p)] for j in range(p)]


def _estimate(sums: DataFrame, target: list[list[float]], factor: float) -> DataFrame:
    """Centre, Cholesky factor and log determinant from the sums of each (gkey, start)."""
    p, n = len(target), F.col("n").cast("double")
    out = sums.withColumns({f"c{j}": F.col(f"s{j}") / n / UNIT for j in range(p)})
    cov = {(j, k): (F.col(f"s{j}_{k}") / n / UNIT**2 - F.col(f"c{j}") * F.col(f"c{k}")) * factor + target[j][k] for j in range(p) for k in range(j + 1)}
    for j in range(p):
        for k in range(j + 1):
            inner = cov[j, k]
            for i in range(k):
                inner = inner - F.col(f"l{j}_{i}") * F.col(f"l{k}_{i}")
            out = out.withColumn(f"l{j}_{k}", F.sqrt(F.greatest(inner, F.lit(target[j][j] * 1e-6))) if j == k else inner / F.col(f"l{k}_{k}"))
    det = sum((F.log(F.col(f"l{j}_{j}")) for j in range(p)), F.lit(0.0))
    return out.select("gkey", "start", det.alias("det"), *[f"c{j}" for j in range(p)], *[f"l{j}_{k}" for j in range(p) for k in range(j + 1)])


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for j in range(p):
        v = F.col(f"q{j}") / UNIT - F.col(f"c{j}")
        for k in range(j):
            v = v - F.col(f"l{j}_{k}") * z[k]
        z.append(v / F.col(f"l{j}_{j}"))
    return sum((x * x for x in z), F.lit(0.0))


def _joined(rows: DataFrame, estimate: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows with their group's estimate: by broadcast behind a count of the groups, else by key."""
    return rows.join(F.broadcast(estimate) if few else estimate, on, how)


def few_groups(rows: DataFrame) -> bool:
    return rows.select("gkey").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _first_sums(rows: DataFrame, sums: DataFrame, p: int, few: bool) -> DataFrame:
    """_moments() of the rows of each start."""
    plain = sum((F.col(f"q{j}") for j in range(1, p)), F.lit(0)) < UNIT
    hashed = lambda i: F.pmod(F.xxhash64(F.lit(i), "doc_id", *[f"q{j}" for j in range(p)]), F.lit(1 << 20))
    drawn = [F.when(hashed(i) * F.col("_n") < DRAWN << 20, i + 2) for i in range(DRAWS)]
    sized = _joined(rows, sums.select("gkey", F.col("n").alias("_n")), ["gkey"], few)
    dealt = sized.withColumn("start", F.explode(F.array_compact(F.array(F.lit(0), F.when(plain, 1), *drawn))))
    return dealt.groupBy("gkey", "start").agg(*_moments(p))


def concentrate(rows: DataFrame, estimate: DataFrame, target: list[list[float]], coverage: float, few: bool = False) -> DataFrame:
    """The next estimate of each (gkey, start): from the rows of least distance, exactly coverage of them."""
    p = len(target)
    far = F.least(F.greatest(_distance(p), F.lit(1e-6)), F.lit(1e6))
    binned = _joined(rows, estimate, ["gkey"], few).withColumn("bin", F.floor(F.log(far) * 8).cast("int"))
    bins = binned.groupBy("gkey", "start", "bin").agg(*_moments(p))
    names = [c for c in bins.columns if c not in ("gkey", "start", "bin")]
    group = Window.partitionBy("gkey", "start")
    below = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = (F.sum("n").over(group) * F.lit(coverage) - below) / F.col("n")
    parts = bins.withColumn("_taken", F.least(taken, F.lit(1.0))).where("_taken > 0")
    # One bin at most counts in part, so the order of summing doesn't matter.
    total = lambda c: F.coalesce(F.sum(F.when(F.col("_taken") == 1, F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(F.col("_taken") < 1, F.col(c) * F.col("_taken"))), F.lit(0.0))
    sums = parts.groupBy("gkey", "start").agg(*[total(c).alias(c) for c in names])
    return _small(_estimate(sums, target, consistency(p, coverage)), "quality-estimates", few)


def _small(df: DataFrame, label: str, few: bool) -> DataFrame:
    return stash(df, label, (2 + DRAWS) * BROADCAST_GROUPS if few else None)


def _best(estimate: DataFrame, n: int) -> DataFrame:
    rank = Window.partitionBy("gkey").orderBy("det", "start")
    return estimate.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n).drop("_r")


def mcd(rows: DataFrame, floor=FLOOR, coverage: float = COVERAGE, steps: int = STEPS, few: bool = False) -> DataFrame:
    """Per gkey of rows (gkey, doc_id, q0..): the estimate of least determinant."""
    p = len(floor)
    sums = _small(rows.groupBy("gkey").agg(*_moments(p)), "quality-sums", few)
    target = scatter_target(sums, floor)
    estimate = _small(_estimate(_first_sums(rows, sums, p, few), target, 1.0), "quality-estimates", few)
    discard(sums)
    for step in range(FIRST_STEPS + steps):
        last = estimate
        estimate = concentrate(rows, _best(last, BEST) if step == FIRST_STEPS else last, target, coverage, few)
        discard(last)
    return _best(estimate, 1).drop("start", "det")


def judge(docs: DataFrame, floor=FLOOR, cutoff: float = CUTOFF, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """Base statistics, base_failed, the robust squared distance and kept, for each document."""
    stats = stash(base_statistics(docs).withColumn("base_failed", base_failed()), "quality-statistics")
    few = few_groups(stats.withColumn("gkey", F.to_json(F.struct("lang", "source"))))
    rows = _transformed(stats, few)
    estimate = mcd(rows.where(~F.col("base_failed")).select("gkey", "doc_id", *[f"q{j}" for j in range(len(floor))]), floor, coverage, steps, few)
    far = _joined(rows, estimate, ["gkey"], few, "left").withColumn("distance2", _distance(len(floor)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)
    return far.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def op1_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2"))
