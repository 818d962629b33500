import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from larkspur.llm import bpe
from tests.llm.helpers import by_id, clashing, documents


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    odd = [None, "", " ", "  a", "a  b\n\n c", "\n", "a\n", "\n a", "don't 'll 'S we've", "日本語 🎉🎉 \u200d", "a\tb \tc", "x" * 900 + " " + "é" * 500, "١٢٣ 12 ²", "\r\n a\r\nb", " \u0085z", "a\x00b \x00", "<|endoftext|> </s>", "\u00a0x \u3000y", "e\u0301. ,, &&&!", "\x1c \x1d"]
    alphabet = " \n\t\ra'sé日🎉1.\u00a0#B,!"
    return odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(600)] + ["word " * 20000]


def test_equals_the_library_and_round_trips(spark, reference):
    all_texts = texts()
    out = bpe.decode(bpe.encode(clashing(documents(spark, all_texts))))
    got = by_id(out.withColumn("back", bpe.decode_text(F.col("decoded"))))
    for i, t in enumerate(all_texts):
        assert got[i].ids == reference.encode_ordinary(t or ""), repr(t)
        assert bytes(got[i].decoded) == (t or "").encode() and got[i].back == (t or "")
    one = by_id(bpe.encode(documents(spark, all_texts), decoded=True))
    assert all(one[i].ids == got[i].ids and one[i].decoded == got[i].decoded and one[i].ends == got[i].ends for i in one) and len(one) == len(got)


def test_offsets(spark, reference):
    all_texts = texts()[:200]
    got = by_id(bpe.encode(documents(spark, all_texts)))
    for i, t in enumerate(all_texts):
        at = 0
        for token, start, end in zip(got[i].ids, got[i].starts, got[i].ends, strict=True):
            size = len(reference.decode_single_token_bytes(token))
            covered = t[start:end].encode()
            lead = len(t[:start].encode())
            assert lead <= at and lead + len(covered) >= at + size and t.encode()[at : at + size] in covered
            at += size


def test_memo_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PARTS", 20)
    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    rnd = random.Random(2)
    for _ in range(30):
        batch = [" ".join("".join(rnd.choice("abcé.,") for _ in range(rnd.randrange(1, 90))) for _ in range(10)) for _ in range(5)]
        assert [x.tolist() for x in codec.encode(batch)] == [reference.encode_ordinary(t) for t in batch]
    assert all(len(p) <= bpe.MEMO_CHARS for p in codec._spaced)


def test_unknown_ids_and_no_rows(spark):
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()
    assert bpe.decode(bpe.encode(documents(spark, []))).collect() == []
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded) == b""


def test_other_patterns_and_small_batches(spark, monkeypatch):
    pattern = r"[a-z]+ ?|[^a-z]+"
    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, some := texts()[:120])
    got = by_id(bpe.encode(docs, pattern=pattern, decoded=True))
    assert all(got[i].ids == own.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode() for i, t in enumerate(some))
    batch = pa.RecordBatch.from_pydict({"ids": [[1, 2, 3], None, [4] * 9, [], [5], [6] * 4]})
    monkeypatch.setattr(bpe, "BATCH_IDS", 5)
    slices = [x.column("ids").to_pylist() for x in bpe._slices(batch)]
    assert sum(slices, []) == batch.column("ids").to_pylist() and all(len(x) == 1 or sum(len(i or []) for i in x) <= 5 for x in slices)
    monkeypatch.setattr(bpe, "RUN_IDS", 7)
    table, ids = bpe.ByteTable(public_tokenizers.path(bpe.RANKS)), np.array(own.encode_ordinary("some words, and é more of them"), np.int32)
    assert table.decode(ids, np.array([0, len(ids)]))[0].decode() == "some words, and é more of them"
