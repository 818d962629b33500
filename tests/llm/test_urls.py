import random
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import urls
from tests.llm.helpers import clashing


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule(host, path):
    fits = [(v, h, p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


ODD = [None, "", "x", "http:/a", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://net/", "http://xnet/", "a://b://c/d", "http://org/fr/", "http://a.org/fr/é?x", "ftp://example.com/de/#a?b", "http://h?a/b", "http://h#a/b", "http://İ.ÉX.org/fr/\n/a", "http://a\nb.net/\nc"]


def test_judge(spark):
    rnd = random.Random(1)
    pages = [(i, u) for i, u in enumerate(ODD + [f"http://{rnd.choice('abc')}.{rnd.choice(['example.net', 'example.com', 'x.org', 'y.net'])}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.randrange(30)}" for _ in range(300)])]
    listed = {h + p for _, u in pages for h, p in [brute(u)] if h and (zlib.crc32((h + p).encode()) % 3 == 0 or p.endswith("7"))} | {"elsewhere.com/x"}
    got = {r.page_id: r for r in urls.judge(clashing(spark.createDataFrame(pages, "page_id long, url string")), spark.createDataFrame([(k,) for k in listed], "key string")).collect()}
    assert len(got) == len(pages)
    for i, u in pages:
        h, p = brute(u)
        r = rule(h, p)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, r and r[1] + r[2]), u
        assert got[i].listed == (h + p in listed)
        assert got[i].verdict == (r[0] if r else "block" if h + p in listed else "allow"), u


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.98, 1.0])
@pytest.mark.parametrize("bits", [2, 10])
def test_cascades_are_exact_over_their_universe(spark, share, bits):
    rnd = random.Random(str(share))
    keys = [(f"k{i}", rnd.random() < share) for i in range(3000)]
    u = spark.createDataFrame(keys + [(None, True)], "key string, listed boolean")
    c = urls.Cascade.build(u, bits=bits)
    out = spark.createDataFrame(keys, "key string, want boolean").withColumn("got", c.contains(F.col("key")))
    assert out.where("got <> want").count() == 0 and out.count() == 3000
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    if 0 < share < 1:
        assert len(c.levels) > 1


def test_shards_beyond_the_bound(spark):
    keys = [(f"k{i}", i % 2 == 0) for i in range(500)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    with pytest.raises(urls.Overflow):
        urls.Cascade.build(universe, most_bits=640)
    rows = spark.createDataFrame(keys + [("", False), (None, False)], "key string, want boolean").withColumn("shard", F.lit("mine"))
    out = urls.mark_listed(rows, "key", "got", universe, most_bits=640)
    assert out.where("got <> want").count() == 0 and out.count() == 502 and out.where("shard <> 'mine'").count() == 0
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    pages = [(i, f"http://h{i % 90}.org/{i % 7}") for i in range(400)] + [(900, None)]
    listed = [(f"h{i}.org/{i % 7}",) for i in range(0, 90, 2)]
    args = [spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(listed, "key string")]
    assert sorted(urls.judge(*args, most_bits=128).collect()) == sorted(urls.judge(*args).collect())


def test_keys_without_a_host_are_never_listed(spark):
    """Lists of one to a few keys, until some set of bits takes the empty key for listed."""
    odd, hit = spark.createDataFrame([("",), (None,), ("k0",)], "key string"), 0
    for n in range(8):
        keys = [(f"k{i}", i <= 30 + n) for i in range(60)]
        c = urls.Cascade.build(spark.createDataFrame(keys, "key string, listed boolean"), bits=1)
        words, n_bits = c.levels[0]
        hit += odd.where("key = ''").select(urls.Cascade._probe(F.col("key"), words, 0, n_bits)).first()[0]
        assert [r[0] for r in odd.select(c.contains(F.col("key"))).collect()] == [False, False, True]
    assert hit


def test_no_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, spark.createDataFrame([], "key string")).collect() == []
