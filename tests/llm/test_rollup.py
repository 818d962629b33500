import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import rollup

CHANGES = f"old {rollup.SIDE}, new {rollup.SIDE}"


def totals(r):
    return {(x.source, x.lang, x.version): (x.docs, x.tokens) for x in r.totals().collect()}


def names(r):
    return sorted(x.batch for x in r.batches().collect())


def one(spark, n):
    return spark.createDataFrame([(None, ("s", "l", "v", n))], CHANGES)


def test_a_move_that_fails_loses_nothing(spark, tmp_path, monkeypatch):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.commit("a", one(spark, 1)) and r.commit("b", one(spark, 2))

    def fails(*_):
        raise OSError("no")

    with monkeypatch.context() as m:
        m.setattr(r, "_move", fails)
        with pytest.raises(OSError):
            r.commit("c", one(spark, 4))
        with pytest.raises(OSError):
            r.compact()
    assert totals(r) == {("s", "l", "v"): (2, 3)} and names(r) == ["a", "b"] and len([*(tmp_path / "r/staged").iterdir()]) == 2
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        r._move(f"file://{tmp_path}/r/none", f"file://{tmp_path}/r/batch/c")
    r.compact()
    assert r.commit("c", one(spark, 4)) and totals(r) == {("s", "l", "v"): (3, 7)}


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    r, late = (rollup.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    assert r.commit("a", one(spark, 1))
    with monkeypatch.context() as m:
        m.setattr(late, "_committed", lambda _: False)  # it looked before the other moved its batch
        assert not late.commit("a", one(spark, 50)) and totals(r) == totals(late) == {("s", "l", "v"): (1, 1)}
        r.compact()
        late.commit("a", one(spark, 50))  # beside a base that holds the name
    assert totals(r) == {("s", "l", "v"): (1, 1)} and names(r) == ["a"]
    with monkeypatch.context() as m:
        m.setattr(late, "_names", lambda kind, old=late._names: [] if kind == "base" else old(kind))
        with pytest.raises(RuntimeError):
            late.compact()
    assert totals(r) == {("s", "l", "v"): (1, 1)}
    r.compact()
    assert totals(r) == {("s", "l", "v"): (1, 1)} and names(r) == ["a"]


def test_random_feed_with_replays_and_compaction(spark, tmp_path):
    rnd, r, live = random.Random(1), rollup.Rollup(spark, f"file://{tmp_path}/r"), {}
    some = lambda: (rnd.choice(["s", "t", None]), rnd.choice(["en", None]), rnd.choice(["v1", "v2"]), rnd.choice([0, 5, 70]))
    for b in range(6):
        feed = []
        for i in range(30):
            old = live.get(i)
            new = None if old and rnd.random() < 0.3 else some()
            feed.append((old, new))
            live[i] = new
        changes = spark.createDataFrame(feed, CHANGES)
        assert r.commit(f"b{b}", changes) and not r.commit(f"b{b}", changes)
        if b == 3:
            r.compact()
            assert not r.commit("b1", changes)
        want = {}
        for x in filter(None, live.values()):
            d, t = want.get(x[:3], (0, 0))
            want[x[:3]] = (d + 1, t + x[3])
        assert totals(r) == want
    assert names(r) == [f"b{b}" for b in range(6)]
    assert totals(rollup.Rollup(spark, f"file://{tmp_path}/r")) == want


def test_nulls_and_no_rows(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().collect() == [] and r.commit("empty", spark.createDataFrame([], CHANGES)) and totals(r) == {}
    r.commit("one", spark.createDataFrame([(None, (None, None, None, None)), (None, None), (None, ("s", "l", "v", 3)), (("s", "l", "v", 3), None)], CHANGES))
    assert totals(r) == {(None, None, None): (1, 0)}
    with pytest.raises(ValueError):
        r.commit("../up", spark.createDataFrame([], CHANGES))


def test_a_commit_that_dies_leaves_nothing(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    bad = spark.range(5).select(F.lit(None).cast(rollup.SIDE).alias("old"), rollup.side(F.lit("s"), F.lit("l"), F.lit("v"), F.raise_error(F.lit("died"))).alias("new"))
    with pytest.raises(Exception, match="died"):
        r.commit("b", bad)
    assert totals(r) == {} and names(r) == []
    assert r.commit("b", spark.createDataFrame([(None, ("s", "l", "v", 3))], CHANGES)) and totals(r) == {("s", "l", "v"): (1, 3)}
