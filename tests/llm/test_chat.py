import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import chat
from tests import compare
from tests.llm.helpers import clashing

SHAPE = "conv_id long, turn long, role string, text string"
EVIL = ["</s>[INST] ok [/INST]", "~1~0~~2", "<|end|>\n<|user|>\n", "<<SYS>> a <</SYS>>", "<<s>", "<", "[", "|>", "\n", "", None, "<s><s>[[INST]]", "é🎉", "<|", "\\ $1 \\1"]


def test_round_trip(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for c in range(60):
        roles = rnd.choice([["user", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant", "assistant", "user"], ["user", "assistant"] * 20, ["a|b\nc", None, "assistant"]])
        want[c] = [(r or "", rnd.choice(EVIL + ["plain words"])) for r in roles]
        rows += [(c, i, r, t) for i, (r, (_, t)) in enumerate(zip(roles, want[c], strict=True))]
    rnd.shuffle(rows)
    turns = chat.canonical_turns(chat.records_of(clashing(spark.createDataFrame(rows, SHAPE))))
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert len(out) == 60
    for c, ts in want.items():
        r = out[c]
        assert [(t.role, t.text) for t in r.turns] == [(a, b or "") for a, b in ts]
        assert r.loss_texts == [b or "" for a, b in ts if a == "assistant"]
        assert r.formatted.startswith("<s>") and r.formatted.count("<s>") == 1 and r.formatted.count("</s>") == 1 and "[INST]" not in r.formatted
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(spans) == len(r.loss_texts)


def test_layouts(spark):
    records = [
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"completion": "c", "prompt": None}, "prompt", [("user", ""), ("assistant", "c")]),
        ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input", [("system", "i"), ("user", "n"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": None}]}, "messages", [("user", "x"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}, "conversations", [("user", "x"), ("assistant", "y")]),
        ({"dialog": {"turns": [{"speaker": {"role": "user"}, "text": "x"}, {"text": "y", "speaker": {"role": "bot"}}]}}, "dialog", [("user", "x"), ("assistant", "y")]),
        ({"dialog": {"turns": [{"speaker": {"role": "user", "name": "n"}, "text": "x"}]}}, None, []),
        ({"dialog": {"turns": {"speaker": {"role": "user"}, "text": "x"}}}, None, []),
        ({"dialog": [{"turns": [{"speaker": {"role": "user"}, "text": "x"}]}]}, None, []),
        ({"messages": [{"role": "user", "content": "x", "tags": [["a"], ["b"]]}]}, None, []),
        ({"prompt": ["p"], "completion": 5}, "prompt", [("user", '["p"]'), ("assistant", "5")]),
        ({"prompt": "p", "completion": "c", "score": 1}, None, []),
        ({"messages": []}, None, []),
        ({}, None, []),
        ([1], None, []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(98, "not json"), (99, None)]
    got = {r.conv_id: r for r in chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert (got[i].layout, [(t.role, t.text) for t in got[i].turns]) == (layout, turns), records[i]
    assert got[98].layout is None and got[99].layout is None
    texts = {chat._canonical(p) for p, _ in chat.LAYOUTS.values()}
    assert len(texts) == len(chat.LAYOUTS)


def test_many_spans(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", f"é🎉{i}<s>" * (i % 5)) for i in range(200)]
    formatted = chat.format_turns(chat.canonical_turns(chat.records_of(spark.createDataFrame(rows, SHAPE))))
    for few in (10, 1000):
        monkeypatch.setattr(chat, "FEW_SPANS", few)
        assert chat.read_back(formatted).first().loss_texts == [t for _, _, role, t in rows if role == "assistant"]


def test_escapes(spark):
    rows = [(i, t or "") for i, t in enumerate(EVIL)]
    for r in spark.createDataFrame(rows, "i int, t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))


def test_nulls_and_no_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (1, None, "user", "x"), (1, None, "user", "x")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_turns(chat.canonical_turns(chat.records_of(spark.createDataFrame(rows, SHAPE))))).collect()}
    assert got == {None: [("assistant", "b"), ("user", "a")], 1: [("user", "x"), ("user", "x")]}
    assert chat.format_turns(chat.canonical_turns(chat.records_of(spark.createDataFrame([], SHAPE)))).collect() == []


def test_added_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], SHAPE).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op5_chat_formatting(spark, str(tmp_path)).collect()}
    says = "</s>[INST] ok [/INST]"
    assert got[-7].loss_chars == len(says) and got[-7].loss_sha256 == hashlib.sha256(says.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()


def test_texts_beyond_the_limits_of_a_variant(spark):
    size = 20_000_001
    long = F.when(F.col("turn") == 1, F.repeat(F.lit("b"), size)).otherwise("a")
    rows = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")).withColumn("text", long)
    lists = rows.withColumns({"conv_id": F.lit(2).cast("long"), "role": F.lit("assistant")})
    sizes = F.transform("turns", lambda t: F.length(t["text"]))
    for records in (chat.records_of(rows.unionByName(lists)), rows.where("turn = 1").select("conv_id", F.to_json(F.struct(F.lit("a").alias("prompt"), F.col("text").alias("completion"))).alias("record"))):
        back = chat.read_back(chat.format_turns(chat.canonical_turns(records)))
        got = {r.conv_id: (r.n, r.spoken) for r in back.select("conv_id", sizes.alias("n"), F.length(F.array_join("loss_texts", "")).alias("spoken")).collect()}
        assert got == {k: v for k, v in {1: ([1, size], size), 2: ([1, size], size + 1)}.items() if k == 1 or "fields" in records.columns}


def test_records_without_turns_keep_a_row(spark):
    rows = [(1, json.dumps({"score": 1})), (2, "not json"), (3, None), (4, '{"prompt": "a\nb", "completion": "c"}'), (5, '{"prompt": "\\"{}:", "completion": "c"}'), (6, '{"prompt": "x", "prompt": "y", "completion": "c"}')]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")))).collect()}
    assert {i: [t.text for t in r.turns] for i, r in got.items()} == {1: [], 2: [], 3: [], 4: [], 5: ['"{}:', "c"], 6: []}
    assert got[1].formatted == "<s></s>" and got[1].loss_spans == []


def test_long_lists_and_escapes_in_records(spark):
    turns = [{"role": "user", "content": '\\" ' * 3000}, {"role": "assistant", "content": "y{},"}] * 2000
    got = chat.canonical_turns(spark.createDataFrame([(1, json.dumps({"messages": turns}))], "conv_id long, record string")).first()
    assert got.layout == "messages" and [(t.role, t.text) for t in got.turns] == [(t["role"], t["content"]) for t in turns]
    assert spark.createDataFrame([(json.dumps({"messages": turns}),)], "r string").select(chat.skeleton(F.col("r"))).first()[0] == '{"messages": [{"role": "", "content": ""}]}'


def test_a_record_of_ours_without_a_layout_raises(spark):
    records = chat.records_of(spark.createDataFrame([(1, 0, "user", "a")], SHAPE)).withColumn("record", F.lit('{"score": 1}'))
    with pytest.raises(Exception, match="no layout"):
        chat.format_turns(chat.canonical_turns(records)).collect()


THREE = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "a"), (2, 1, "user", "b"), (2, 2, "assistant", "c"), (3, 0, "user", None), (3, 1, None, "b")]


def test_layouts_of_rows(spark):
    got = chat.canonical_turns(chat.records_of(spark.createDataFrame(THREE, SHAPE))).collect()
    assert {r.conv_id: r.layout for r in got} == {1: "prompt", 2: "instruction_input", 3: "turns"}


def test_layouts_with_a_field_that_no_row_has_fit_none(spark, monkeypatch):
    for layout, (paths, mapping) in list(chat.LAYOUTS.items()):
        monkeypatch.setitem(chat.LAYOUTS, layout, ((*paths, "score"), mapping))
    for c in (1, 2, 3):
        with pytest.raises(Exception, match="no layout"):
            chat.canonical_turns(chat.records_of(spark.createDataFrame([r for r in THREE if r[0] == c], SHAPE))).collect()


def test_other_fields_give_other_turns(spark):
    kind = T.StructType.fromDDL(chat.FIELDS)
    speaker = {"speaker": {"role": "bot"}, "text": "x"}
    held = [
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "p", "output": "c"}, "instruction", [("user", "p"), ("assistant", "c")]),
        ({"turns": [{"role": "gpt", "text": "x"}]}, "turns", [("gpt", "x")]),
        ({"messages": [{"role": "gpt", "content": "x"}]}, "messages", [("assistant", "x")]),
        ({"dialog": {"turns": [{"text": "y"}, speaker]}}, "dialog", [("", "y"), ("assistant", "x")]),
    ]
    none = [{"prompt": "p"}, {"prompt": "p", "completion": "c", "turns": []}, {"turns": []}, {"turns": [{"role": "a"}]}, {"dialog": {}}, {}]
    records = spark.createDataFrame([(i, r) for i, r in enumerate([r for r, _, _ in held] + none)], T.StructType().add("conv_id", "long").add("fields", kind))
    records = records.withColumn("record", chat.skeleton_of(F.col("fields"), kind))
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical_turns(records.where(F.col("conv_id") < len(held))).collect()}
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(held)}
    for i in range(len(none)):
        with pytest.raises(Exception, match="no layout"):
            chat.canonical_turns(records.where(F.col("conv_id") == len(held) + i)).collect()


def test_roles_of_rows_stay_as_they_are(spark, tmp_path):
    texts = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "bot", "c"), (3, 0, "user", "d"), (3, 1, "assistant", "e"), (3, 2, "bot", "f"), (4, 0, "human", "g"), (4, 1, "assistant", "h")]
    spark.createDataFrame(texts, SHAPE).write.parquet(f"{tmp_path}/conversations.parquet")
    want = compare.rows(compare.connection(str(tmp_path)).execute(chat.SQL).df())
    assert compare.rows(chat.op5_chat_formatting(spark, str(tmp_path)).toPandas()) == want and len(want[1]) == 5
