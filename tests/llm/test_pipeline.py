import base64
import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import bpe, catalog, common, mixing
from tests.llm.helpers import DOCS, WORDS
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_quality import brute as base
from tests.llm.test_substrings import brute as cut_brute

BASE = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passage, copied = words(60), words(120)
    rows = [(i, words(80), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, copied, "en", "s0", 0), (101, copied, "en", "s1", 0), (102, copied + " more", "en", "s0", 0), (103, "short", "en", "s0", 0)]
    rows += [(110 + i, words(50) + "\n" + passage + "\n" + words(50), "en", "s0", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, str(tmp_path)), "t")
        seen.append(docs)
        assert {*docs.columns} == BASE or name == corpus_pipeline.STAGES[-1][0]
    kept, single, cut, mixed, _ = ({r.doc_id: r for r in d.collect()} for d in seen)
    assert {*kept} == {r[0] for r in rows} - {103}
    assert {*single} == {*kept} - {101, 102}
    assert {*cut} == {*single} and passage in cut[110].text and passage not in cut[111].text and passage not in cut[112].text
    assert all(cut[i].text == kept[i].text for i in range(60)) and cut[111].n_chars == len(cut[111].text)
    assert {*mixed} <= {*cut}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1].count() == seen[-2].count()


def test_catalogue():
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert len(queries) == 10 and {*sql} <= {*queries}
    assert sorted(int(q[2:].split("_")[0]) for q in queries) == list(range(1, 11))


def test_verdicts_are_of_rows(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    shared, single, one, other = (words(100) for _ in range(4))
    rows = [(i, words(80)) for i in range(40)] + [(None, "short"), (50, "short"), (50, one), (51, single), (51, single), (51, single), (52, one), (52, other), (None, shared), (None, shared), (60, shared), (None, words(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    docs = common.stash(docs, "t")
    good = common.stash(corpus_pipeline.quality_rules(spark, docs, ""), "t")
    key = lambda rs: sorted(((r[0], r[1]) for r in rs), key=str)
    assert key(good.collect()) == key(r for r in rows if r[1] != "short")
    left = common.stash(corpus_pipeline.near_dedup(spark, good, ""), "t").collect()
    assert sorted(r.text for r in left) == sorted({t for _, t in rows} - {"short"})
    assert [r.doc_id for r in left if r.text == shared] == [60] and {r.doc_id for r in left if r.text == other} == {52}


def _corpus(seed):
    rnd = random.Random(seed)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passage = words(45)
    texts = [words(rnd.choice([15, 60, 200])) for _ in range(70)]
    for base in texts[:15]:
        near = base.split()
        near[rnd.randrange(len(near))] = "other"
        texts += [base, " ".join(near)]
    texts += [words(40) + "\n" + passage + " " + words(30) for _ in range(5)] + ["few words", "", None, "a b c d e " * 20, " ".join(w + "###" for w in words(60).split())]
    rnd.shuffle(texts)
    return [(i * 2, t, "en", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts)]


def test_each_stage_against_brute_force_on_its_input(spark, tmp_path):
    """Base rules, near duplicates, repeats, the mix's copies and token ids, each worked out anew in Python or SQL."""
    spark.createDataFrame(_corpus(3), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, inputs, outputs = spark.read.parquet(f"{tmp_path}/documents.parquet"), [], []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in docs.collect()])
        docs = common.stash(stage(spark, docs, str(tmp_path)), "t")
        outputs.append(docs.collect())
    quality_in, near_in, cut_in, mix_in, bpe_in = inputs
    left = {r.doc_id for r in outputs[0]}
    for i, t, *_ in quality_in:
        n, _, symbols, lines, repeated = base(t)
        if n < 10 or 100 * repeated > 20 * n:
            assert i not in left, t
        elif not (symbols or lines or repeated):
            assert i in left, t
    want = near_brute([r[0] for r in near_in], [r[1] for r in near_in], 5, 80)
    assert {r.doc_id for r in outputs[1]} == {i for i, (_, c) in want.items() if c == i} and len(outputs[1]) < len(near_in)
    cut = {i: w for i, _, _, w in cut_brute(sorted(r[:2] for r in cut_in), 20)}
    assert {r.doc_id: WORDS.findall(r.text) for r in outputs[2]} == cut and sum(map(len, cut.values())) < sum(len(WORDS.findall(r[1])) for r in cut_in)
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(mix_in, columns=corpus_pipeline.COLUMNS))
    taken = {r[0]: r[1] // r[2] for r in duck.sql(f"SELECT doc_id, taken, size FROM ({mixing.SQL}) WHERE size > 0").fetchall()}
    times = Counter(r.doc_id for r in outputs[3])
    assert all(times[i] == n for i, n in taken.items())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    told = Counter((i, len(ids := own.encode_ordinary(t)), sha(",".join(map(str, ids))), sha(t)) for i, t, *_ in bpe_in)
    assert told == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in outputs[4])
    assert told == Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ranks():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def test_no_rows_and_extra_columns(spark, tmp_path):
    names = ("_key", "_id", "_gone", "size", "copies", "row", "alive", "block", "component_id", "kept", "u", "upto")
    for folder, rows in (("none", []), ("some", _corpus(4)[:30])):
        for extra in ((), names):
            at = f"{tmp_path}/{folder}{len(extra)}"
            spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in extra} if extra else {"n_chars": F.col("n_chars")}).write.parquet(f"{at}/documents.parquet")
        few, more = (sorted(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/{folder}{n}").collect())) for n in (0, len(names)))
        assert few == more and bool(few) == bool(rows)
