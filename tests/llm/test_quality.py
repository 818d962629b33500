import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import quality
from tests.llm.helpers import DOCS, WORDS, by_id, clashing, documents


def brute(text, k=5):
    ws = WORDS.findall(text or "")
    seen, covered = {}, set()
    for i in range(len(ws) - k + 1):
        seen.setdefault(tuple(ws[i : i + k]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + j for i in at for j in range(k))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "a b c d e a b c d e f", "x " * 40, "l\nl\n\n \n l\nl", "é#| <b>&\x0b\x1cz\x0c$%*", "w" * 5000, "one two three four five " * 3 + "six"]


def test_base_statistics(spark):
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) + "\n" for _ in range(40)] + [" ".join(map(str, range(3000))) + " " + " ".join(map(str, range(50)))]
    got = by_id(quality.base_statistics(clashing(documents(spark, texts))))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), (i, t)


def test_a_very_long_text(spark):
    text = " ".join(str(i % 90_000) for i in range(100_000)) + "\n" + "z" * 1_000_000
    r = quality.base_statistics(documents(spark, [text])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)


def _words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_outliers_go_and_clean_documents_stay(spark):
    rnd = random.Random(2)
    clean = [_words(rnd, rnd.choice([12, 30, 100, 300, 2000])) for _ in range(150)]
    junk = [" ".join(w + "***" for w in _words(rnd, 80).split()) for _ in range(10)] + [_words(rnd, 60).replace(" ", "zzzzzzzzzzzzzzz ") for _ in range(10)]
    short = ["too short"] * 5
    got = by_id(quality.judge(documents(spark, clean + junk + short)))
    assert all(got[i].kept for i in range(150))
    assert not any(got[i].kept or got[i].base_failed for i in range(150, 170))
    assert all(got[i].base_failed and not got[i].kept for i in range(170, 175))


TARGET = [[0.02, 0.01, 0.0, 0.0], [0.01, 0.3, 0.0, 0.1], [0.0, 0.0, 0.4, 0.2], [0.0, 0.1, 0.2, 0.5]]


def test_estimates_equal_a_direct_computation(spark):
    """One step from given rows: the sums, the scatter and the distance against numpy."""
    rnd = np.random.default_rng(3)
    x = (rnd.normal(size=(400, 4)) @ rnd.normal(size=(4, 4)) * 200).round().astype(int)
    rows = spark.createDataFrame([("g", i, *map(int, r)) for i, r in enumerate(x)], "gkey string, doc_id long, q0 long, q1 long, q2 long, q3 long")
    est = quality._estimate(rows.withColumn("start", F.lit(0)).groupBy("gkey", "start").agg(*quality._moments(4)), TARGET, 1.3)
    got = {r.doc_id: r.d for r in rows.join(est, "gkey").withColumn("d", quality._distance(4)).collect()}
    y = x / quality.UNIT
    inverse = np.linalg.inv(np.cov(y.T, bias=True) * 1.3 + np.array(TARGET))
    z = y - y.mean(0)
    assert np.allclose([got[i] for i in range(400)], np.einsum("ij,jk,ik->i", z, inverse, z))


def test_mcd_ignores_contamination(spark):
    rnd = np.random.default_rng(4)
    good, bad = rnd.normal(0, 300, (300, 4)), rnd.normal(5000, 100, (60, 4))
    rows = spark.createDataFrame([("g", i, *map(int, r)) for i, r in enumerate(np.vstack([good, bad]))], "gkey string, doc_id long, q0 long, q1 long, q2 long, q3 long")
    for few in (False, True):
        r = quality.mcd(rows, few=few).first()
        assert all(abs(r[f"c{j}"] - good[:, j].mean() / quality.UNIT) < 0.15 for j in range(4))


def reference_mcd(x, ids, target, starts):
    """The method as its docstring tells it, on one group's rows in numpy; x in units of 1/1024."""
    y, factor = x / quality.UNIT, quality.consistency(4, quality.COVERAGE)

    def estimate(weight, factor):
        centre = np.average(y, axis=0, weights=weight)
        z = y - centre
        return centre, (z.T * weight) @ z / weight.sum() * factor + target

    def distance(centre, scatter):
        return np.einsum("ij,jk,ik->i", y - centre, np.linalg.inv(scatter), y - centre)

    def step(centre, scatter):
        bins = np.floor(np.log(np.clip(distance(centre, scatter), 1e-6, 1e6)) * 8)
        weight, left = np.zeros(len(y)), quality.COVERAGE * len(y)
        for b in np.unique(bins):
            here = bins == b
            weight[here] = min(1.0, left / here.sum())
            left -= here.sum()
            if left <= 0:
                break
        return estimate(weight, factor)

    found = [step(*step(*estimate(s, 1.0))) for s in starts if s.any()]
    det = lambda e: np.linalg.slogdet(e[1])[1]
    best = sorted(found, key=det)[: quality.BEST]
    for _ in range(quality.STEPS):
        best = [step(*e) for e in best]
    return distance(*min(best, key=det))


def test_verdicts_equal_the_method_in_numpy(spark):
    """kept and the distance of every row, against base statistics and estimates made apart from Spark."""
    rnd, texts = random.Random(7), []
    for i in range(260):
        words = _words(rnd, rnd.choice([12, 40, 100, 300])).split()
        line = " ".join(words[:9])
        texts.append(" ".join(words) + (("\n" + line) * rnd.randrange(3) if i % 4 == 0 else "") + " #" * (rnd.randrange(30) if i % 11 == 0 else 0))
    groups = [("en", "s") if i % 3 else ("de", None) for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, *g, 0) for i, (t, g) in enumerate(zip(texts, groups, strict=True))], DOCS)
    got = by_id(quality.judge(df.repartition(5)))
    base = [brute(t) for t in texts]
    failed = [b[0] < 10 or 100 * b[4] > 20 * b[0] for b in base]
    n_lines = [sum(1 for x in t.split("\n") if WORDS.search(x)) for t in texts]
    x, rows_of = {}, {}
    for g in set(groups):
        at = [i for i in range(len(texts)) if groups[i] == g and not failed[i]]
        m = sum(base[i][1] for i in at) / sum(base[i][0] for i in at)
        share = lambda a, b: np.log1p(100 * a / b)
        x[g] = np.round(quality.UNIT * np.array([[np.log((base[i][1] + 100 * m) / (base[i][0] + 100)), share(base[i][2], base[i][1] + 100), share(base[i][3], n_lines[i] + 10), share(base[i][4], base[i][0] + 20)] for i in at]))
        rows_of[g] = at
    v = sum((a - a.mean(0)).T @ (a - a.mean(0)) for a in x.values())
    r = np.where(np.eye(4) > 0, 1.0, np.round(0.95 * v / np.sqrt(np.outer(np.diag(v), np.diag(v))), 6))
    target = np.outer(quality.FLOOR, quality.FLOOR) * r
    rejected = 0
    for g, at in rows_of.items():
        q = spark.createDataFrame([(i, *map(int, row)) for i, row in zip(at, x[g], strict=True)], "doc_id long, q0 long, q1 long, q2 long, q3 long")
        hashed = q.select("doc_id", *[F.pmod(F.xxhash64(F.lit(d), "doc_id", "q0", "q1", "q2", "q3"), F.lit(1 << 20)).alias(f"h{d}") for d in range(4)]).orderBy("doc_id").collect()
        starts = [np.ones(len(at)), (x[g][:, 1:].sum(1) < quality.UNIT) * 1.0] + [np.array([h[d + 1] * len(at) < 10 << 20 for h in hashed]) * 1.0 for d in range(4)]
        want = reference_mcd(x[g], at, target, starts)
        assert np.allclose([got[i].distance2 for i in at], want, rtol=1e-6), g
        assert [got[i].kept for i in at] == (want <= quality.CUTOFF).tolist()
        rejected += (want > quality.CUTOFF).sum()
    assert rejected and all(got[i].base_failed == failed[i] and not (failed[i] and got[i].kept) for i in range(len(texts)))


def test_each_statistic_alone_rejects(spark):
    rnd = random.Random(8)
    clean = [_words(rnd, 300) for _ in range(120)]
    lines = [_words(rnd, 10) for _ in range(30)]
    words = [w[: 400 * 6] for w in (_words(rnd, 400),)]
    many = words[0].split()
    repeats = " ".join(many[:300] + many[200:224] + many[300:] + many[100:124])  # 96 of 448 words, in one line
    while 100 * brute(repeats)[4] > 20 * brute(repeats)[0]:
        repeats += " " + _words(rnd, 20)
    odd = {"words": repeats, "lines": "\n".join(lines + [str(i)[:1] for i in range(10)] * 4), "symbols": clean[0] + "#" * 250, "length": " ".join(w + "qqqq" for w in clean[1].split())}
    got = by_id(quality.judge(documents(spark, clean + [*odd.values()])))
    assert all(got[i].kept for i in range(120))
    for i, name in enumerate(odd, 120):
        assert not got[i].kept and not got[i].base_failed, name
    r = got[120]
    assert (r.n_symbols, r.n_dup_lines) == (0, 0) and 100 * r.n_repeat_words <= 20 * r.n_words


def test_groups_nulls_and_no_rows(spark):
    rows = [(i, "a b c d e f g h i j k l", lang, source, 1) for i, (lang, source) in enumerate([("en", None), (None, None), (None, "en"), ("en", "s"), ("en", "s")])] + [(None, None, None, None, None)]
    got = quality.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 5
    assert quality.judge(spark.createDataFrame([], DOCS)).collect() == []


def test_native(spark):
    plan = quality.judge(documents(spark, ["a b c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_consistency():
    assert abs(quality.consistency(4, 0.75) - 1.4866) < 1e-3
