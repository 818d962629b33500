import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import chunks
from tests.llm.helpers import DOCS, by_id, clashing, documents


def slow_hashes(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one(monkeypatch):
    data = random.Random(1).randbytes(3000)
    assert chunks.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == slow_hashes(data)
    whole = chunks.candidates(np.frombuffer(data, np.uint8))
    monkeypatch.setattr(chunks, "BLOCK", 100)
    for a, b in zip(whole, chunks.candidates(np.frombuffer(data, np.uint8)), strict=True):
        assert a.tolist() == b.tolist()


def test_chunks_cover_the_text_and_keep_to_sizes():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh é\n") for _ in range(20000))
    p = chunks.Print(text)
    cuts = chunks.boundaries(len(p.data), p.ends, p.strict)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(p.data) and sizes[:-1].min() >= chunks.LEAST and sizes.max() <= chunks.MOST
    assert chunks.parse(p.text()) == p.chunks
    assert max(np.diff([0, *chunks.boundaries(5000, np.empty(0, int), np.empty(0, bool))])) <= chunks.MOST


def test_shift_resistance_and_reuse():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh é\n") for _ in range(20000))
    p = chunks.Print(text)
    assert p.contained(chunks.Print("some words before " + text)) > 0.95
    assert 0.4 < p.contained(chunks.Print(text[:10000])) < 0.6 and chunks.Print(text[:10000]).contained(p) > 0.95
    new = text[:7000] + "другой конец" + text[9000:]
    assert chunks.Print(new, p, len(text[:7000].encode())).chunks == chunks.Print(new).chunks


def check(spark, rows, parts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = sorted(chunks.with_edits(clashing(df), parts).collect(), key=lambda r: r.doc_id)
    order = sorted(rows)
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        text, other, r = text or "", order[(i + 1) % len(order)][1] or "", got[i]
        changed, _ = chunks.edited(text, other)
        p, e = chunks.Print(text), chunks.Print(changed)
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (p.text(), e.text())
        assert (r.near_edited, r.near_next) == (p.contained(e), p.contained(chunks.Print(other)))


def test_edits_follow_the_order_of_ids(spark):
    rnd = random.Random(4)
    rows = [(i * 7 - 100, rnd.choice(["", "é" * rnd.randrange(300), "word " * rnd.randrange(400)])) for i in range(120)]
    for parts in (1, 2, 9, 60, 200):
        check(spark, rows, parts)
    check(spark, [(i * (2**56 + 12345) - 2**62, f"{i} " * 20) for i in range(90)] + [(2**62 + i, f"x{i} " * 20) for i in range(30)], 25)
    check(spark, [(5, "alone at last")], 4)
    check(spark, [(1, "aa"), (2, "bb")], 4)


def test_a_very_long_text(spark):
    check(spark, [(1, "abcdefghij é " * 150_000), (2, "b"), (3, "c" * 1_500_000)], 3)


def test_nulls_ties_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "", "", 0), (1, "b", "", "", 0), (1, "b", "", "", 0), (2, "", "", "", 0), (None, "x", "", "", 0)], DOCS)
    assert len(chunks.with_edits(df).collect()) == 5
    assert chunks.with_edits(spark.createDataFrame([], DOCS)).collect() == []
    got = by_id(chunks.fingerprints(documents(spark, ["same", "same", None])))
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint == ""
    assert chunks.containment({}, {}) == 1.0 and chunks.containment({}, {"a": 1}) == 0.0 and chunks.containment({"a": 1}, {}) == 0.0


def test_null_ids_come_first_and_follow_the_last(spark):
    long = "begins alike, for more than sixty-four code points of each of these texts "
    for rows in ([(None, "alone at last")], [(None, "b" * 90), (None, None), (None, "a")], [(None, long + "b"), (None, long + "a"), (1, "one " * 30), (2, "two " * 30)], [(i, f"{i} " * 50) for i in range(40)] + [(None, "x" * 70)], [(None, f"{i} " * 40) for i in range(60)] + [(None, "again")] * 5 + [(i, f"{i} " * 50) for i in range(9)]):
        hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, hashed[r[1]] if r[0] is None else r[0], r[1] or ""))
        want = [(i, hashlib.sha256(chunks.edited(t or "", order[(n + 1) % len(order)][1] or "")[0].encode()).hexdigest()) for n, (i, t) in enumerate(order)]
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(2)
        for parts in (1, 4, 30):
            assert sorted(((r.doc_id, r.edited_sha256) for r in chunks.with_edits(df, parts).collect()), key=str) == sorted(want, key=str)
