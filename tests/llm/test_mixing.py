import random

from pyspark.sql import functions as F

from larkspur.llm import mixing
from tests.llm.helpers import DOCS, WORDS, clashing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Rounds as told: excess is dealt anew by weight until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def rows(rnd, n, sources):
    return [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 3, 20]))), "en", rnd.choice(sources), 0) for i in range(n)]


def test_targets(spark):
    rnd = random.Random(1)
    for trial in range(6):
        sizes = {s: rnd.choice([0, 1, 10, 100, 1000, 5000]) for s in rnd.sample(["a", "b", "B", "é", "z", "10", "9", None], rnd.randrange(1, 8))}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), (sizes, got, want)


def test_mix(spark):
    df = spark.createDataFrame(rows(random.Random(2), 4000, ["a", "b", None, "c"]), DOCS)
    out = mixing.mix(clashing(df))
    got = out.collect()
    text = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == 4000 and all(r.size == len(WORDS.findall(text[r.doc_id])) and r.taken in (0, r.size, 2 * r.size) for r in got)
    for r in out.groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 0.01 * r.g
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    clash = clashing(df).withColumns({c: F.lit(c) for c in ("_copy", "_size", "_source", "_s", "_target", "row", "col", "u", "upto", "source_size", "strata", "d.t")})
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and mixed.where("_copy <> '_copy' OR row <> 'row' OR `d.t` <> 'd.t'").count() == 0
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert times == {r.doc_id: r.copies for r in got if r.copies}


def test_few_documents_of_very_different_sizes(spark):
    rnd = random.Random(3)
    texts = [(i, "w " * round(2 ** (13 * rnd.random() ** 2)), "en", f"s{i % 5}", 0) for i in range(400)] + [(1000, "w " * 20_000, "en", "s0", 0)]
    out = mixing.mix(spark.createDataFrame(texts, DOCS)).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert len(out) == 5 and all(abs(r.t - r.g) < 0.03 * r.g for r in out), out


def test_a_copy_has_the_probability_of_the_fraction(spark):
    """Many sources of the same sizes, one document of which outweighs the others: each draws anew."""
    sizes, n = [1, 2, 3, 5, 8, 9, 30, 70, 71, 90, 500, 4000], 300
    docs = spark.createDataFrame([(s * 100 + i, "w " * size, "en", f"s{s}", 0) for s in range(n) for i, size in enumerate(sizes)], DOCS)
    for share in (0.3, 1.74):
        out = mixing.mix(docs.repartition(4), weights=(1.0,), share=share).groupBy("size").agg(F.avg("copies").alias("mean"), F.count("size").alias("n")).collect()
        sigma = (share % 1 * (1 - share % 1) / n) ** 0.5
        assert len(out) == len(sizes) and all(r.n == n and abs(r.mean - share) < 4 * sigma for r in out), out


def test_nulls_and_no_rows(spark, monkeypatch):
    df = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", "", "s", 0), (1, "a b c", "", "s", 0), (2, "", "", "t", 0)], DOCS)
    got = sorted(((r.doc_id, r.size, r.source_size, r.target) for r in mixing.mix(df).collect()), key=str)
    assert got == [(1, 3, 6, 9.0), (1, 3, 6, 9.0), (2, 0, 0, 0.0), (None, 0, 0, 0.0)]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(((r.doc_id, r.size, r.source_size, r.target) for r in mixing.mix(df).collect()), key=str) == got
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
