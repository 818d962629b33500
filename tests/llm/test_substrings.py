import random

import numpy as np
import pyarrow as pa

from larkspur.llm import substrings, wordhash
from tests.llm.helpers import DOCS, WORDS, clashing


def brute(rows, window):
    seen, out = set(), []
    for doc_id, text in rows:
        ws = WORDS.findall(text or "")
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((doc_id, len(ws), sum(gone), [w for w, g in zip(ws, gone, strict=True) if not g]))
    return out


def compare(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = {(r.doc_id, r.n_words, r.n_removed, tuple(WORDS.findall(r.text or ""))) for r in substrings.dedup(clashing(df), **options).collect()}
    want = {(a, b, c, tuple(d)) for a, b, c, d in brute(sorted(rows), options.get("window", 20))}
    assert got == want


def text(rnd, n, words="abcdefghijklmnopqrstuvwxyz"):
    return "".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))


def test_against_brute_force(spark):
    rnd = random.Random(1)
    passages = [text(rnd, 40) for _ in range(5)]
    rows = []
    for i in range(80):
        t = text(rnd, rnd.choice([0, 5, 19, 20, 60, 200]))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(30)
            t += p[a:] + text(rnd, 3)
        rows.append((i * 3, t))
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (1002, None), (1003, ""), (1004, "x " * 200), (1005, "x " * 30)]
    for options in ({}, {"block_bytes": 500}, {"window": 8, "least": 2}, {"window": 40, "least": 5}, {"window": 7}):
        compare(spark, rows, **options)


def test_a_very_long_text(spark):
    compare(spark, [(1, " ".join(str(i % 70_000) for i in range(150_000))), (2, "x" * 2_000_000 + " y"), (3, "short")])


def test_overlapping_repeats_in_one_text(spark):
    compare(spark, [(1, "a b " * 50), (2, "b a " * 50), (3, "a a a b " * 20)])


def test_nothing_repeats_and_no_rows(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(5)]
    compare(spark, rows)
    assert substrings.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_the_ladder_ends_where_nothing_survives(spark, monkeypatch):
    rungs = []
    monkeypatch.setattr(substrings, "_sender", lambda window, length, buckets, old=substrings._sender: rungs.append(length) or old(window, length, buckets))
    unique = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(6)]
    compare(spark, unique)
    assert rungs == [5]
    rungs.clear()
    # Seven words are shared, so no window's parts of ten repeat; then twelve, so its windows of twenty don't.
    passage = [f"p{j}" for j in range(30)]
    compare(spark, [(i, " ".join(f"a{i}x{j}" for j in range(30)) + " " + " ".join(passage[:7] + [f"b{i}x{j}" for j in range(30)])) for i in range(3)])
    assert rungs[:1] == [5] and 20 not in rungs
    rungs.clear()
    compare(spark, unique + [(10 + i, " ".join(passage)) for i in range(3)])
    assert rungs == [5, 10, 20]


def test_null_ids(spark):
    shared = " ".join(f"p{j}" for j in range(30))
    df = spark.createDataFrame([(None, f"u{i} v{i} " + shared, "en", "s", 0) for i in range(40)] + [(None, shared, "en", "s", 0)] * 2, DOCS).repartition(4)
    got = substrings.dedup(df).collect()
    assert len(got) == 42 and sorted(r.n_removed for r in got) == [0] + [30] * 41
    assert sorted(r.n_words for r in got) == [30, 30] + [32] * 40


def test_untouched_texts_stay_as_they_are_and_null_ids_are_last(spark):
    p = " ".join(f"p{j}" for j in range(25))
    df = spark.createDataFrame([(1, "  odd \n\n spacing ", "en", "s", 0), (None, p, "en", "s", 0), (2, "keep  this\n" + p, "en", "s", 0), (3, p + " and\tthat", "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in substrings.dedup(df, keep=("lang",)).collect()}
    assert got[1].text == "  odd \n\n spacing " and got[2].n_removed == 0 and got[None].text == "" and got[3].text == "and\tthat" and got[3].lang == "en"
    assert [(s.start, s.end) for s in got[3].removed] == [(0, 25)]


def test_ladder():
    assert substrings.ladder(20) == [5, 10, 20] and substrings.ladder(20, 10) == [10, 20] and substrings.ladder(40, 5) == [5, 10, 20, 40] and substrings.ladder(7) == [7]


def test_word_hashes(monkeypatch):
    rnd = random.Random(5)
    texts = ["", None, " a", "a ", "ab\x0bcd", "é ü\u00a0x", "Word WORD word"] + [text(rnd, 30, ["α", "bb", "ccc"]) for _ in range(20)]
    w = wordhash.words_of(pa.array(texts))
    flat = [x for t in texts for x in WORDS.findall(t or "")]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    assert np.diff(w.first).tolist() == [len(WORDS.findall(t or "")) for t in texts]
    assert len({*zip(flat, w.hash.tolist(), strict=True)}) == len({*flat}) == len({*w.hash.tolist()})
    monkeypatch.setattr(wordhash, "SPAN", 16)
    assert wordhash.words_of(pa.array(texts)).hash.tolist() == w.hash.tolist()
    low = wordhash.words_of(pa.array(["Word WORD word É é"]), lower=True).hash
    assert low[0] == low[1] == low[2] and low[3] != low[4]
    sliced = wordhash.words_of(pa.array(["x", "a b", "c"]).slice(1, 1))
    assert sliced.hash.tolist() == wordhash.words_of(pa.array(["a b"])).hash.tolist()
    for k in (1, 2, 3, 5, 20):
        sums = wordhash.window_sums(w.hash, k)
        steps = wordhash._power(wordhash._STEP, k)
        for i in range(len(flat) - k):
            assert sums[i] == sum((int(w.hash[i + j]) * int(steps[j]) for j in range(k))) % 2**64
