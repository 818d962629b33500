"""Chat formatting: records of any known layout to canonical turns, then to one template.

A record is JSON. Its schema, as the set of nested field paths without their types, is
hashed; the hash selects a declarative mapping out of LAYOUTS, which names the fields that
become turns. Records whose hash no mapping has are kept aside (layout null, no turns).
Rows by turn become records too; which layout one of them has is read from the fields it holds.

Only a record's skeleton, its structure with empty strings, becomes a variant, as a variant
holds 128 MiB and a string in it 20 M characters at most. Texts stay beside it in columns.

The template wraps a conversation in <s> and </s>; a turn is <|role|>, a line break, its
text and <|end|>. Control strings inside texts are escaped reversibly: ~ becomes ~0, and
the first character of a control string ~1 (for <) or ~2 (for [). A loss mask is the list of
spans, in code points of the formatted text, that hold assistant texts.

Built of DataFrame functions alone. Turns stay rows until the last step, so that offsets are
a running sum in turn order; only a conversation's own output is gathered in one row.

Defined results: a null text is empty, a null role is an empty role; turns are ordered by
turn (nulls first), then role, then text; rows with a null conversation id form one
conversation; an empty table gives an empty table; fields that no mapping names are a layout
of their own; a record without turns is formatted as <s></s>, without spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import let, only, table

#: layout: (nested field paths, mapping). [] marks lists of objects. A mapping lists (role, path) of
#: single turns, or names the list of turns and the paths of role and text in it.
LAYOUTS = {
    "prompt": (("prompt", "completion"), [("user", "prompt"), ("assistant", "completion")]),
    "question": (("question", "answer"), [("user", "question"), ("assistant", "answer")]),
    "instruction": (("instruction", "output"), [("user", "instruction"), ("assistant", "output")]),
    "instruction_input": (("instruction", "input", "output"), [("system", "instruction"), ("user", "input"), ("assistant", "output")]),
    "messages": (("messages[].role", "messages[].content"), ("messages", "role", "content")),
    "conversations": (("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
    "dialog": (("dialog.turns[].speaker.role", "dialog.turns[].text"), ("dialog.turns", "speaker.role", "text")),
    "turns": (("turns[].role", "turns[].text"), ("turns", "role", "text")),
}
#: The values of all layouts, as from_json() reads them.
FIELDS = (
    "prompt string, completion string, question string, answer string, instruction string, input string, output string, "
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
    "dialog struct<turns:array<struct<speaker:struct<role:string>,text:string>>>, turns array<struct<role:string,text:string>>"
)
#: A skeleton of more bytes raises; as a variant it might not fit.
SKELETON_BYTES = 64 << 20
#: Spans that are cut from the text itself; more are cut from a wide copy, of texts up to so many bytes.
FEW_SPANS, MOST_WIDE = 32, 128 << 20
#: Names of the same role in other layouts than that of rows by turn, whose roles are taken as they are.
ROLES, AS_THEY_ARE = {"human": "user", "gpt": "assistant", "bot": "assistant"}, "turns"


def _tree(paths) -> dict:
    """Field paths as nested names; a list of objects has a name that ends in []."""
    out: dict = {}
    for p in paths:
        node = out
        for name in p.split("."):
            node = node.setdefault(name, {})
    return out


def _canonical(paths) -> str:
    """The schema text that the field paths give, in the form of schema_text()."""

    def text(node: dict) -> str:
        inner = lambda name: f":ARRAY<{text(node[name])}>" if name.endswith("[]") else f":{text(node[name])}" if node[name] else ""
        return "OBJECT<" + ",".join(sorted(name.removesuffix("[]") + inner(name) for name in node)) + ">"

    return text(_tree(paths))


#: Lists of lists of scalars are scalars down to this depth.
LISTS = 8
_SCALAR = r"[A-Z_]+(?:\([0-9, ]*\))?"


def schema_text(variant: Column) -> Column:
    """A record's nested field paths without types of scalars, at any depth, as in
    OBJECT<messages:ARRAY<OBJECT<content,role>>>."""
    schema = F.schema_of_variant(variant)
    for _ in range(LISTS):
        schema = F.regexp_replace(schema, rf"ARRAY<({_SCALAR})>", "$1")
    schema = F.regexp_replace(schema, rf": {_SCALAR}(?=[,>])", "")
    return F.regexp_replace(schema, r"(?<=[:,]) ", "")


def fingerprint(variant: Column) -> Column:
    return F.xxhash64(schema_text(variant))


def skeleton(record: Column) -> Column:
    """A JSON record with its strings emptied, but for field names, and without repeats of an equal
    flat object in a list. Possessive, so that matching takes no stack."""
    string = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
    bare = F.regexp_replace(record, rf'(?s)("{string}"\s*+:)|("){string}(")', "$1$2$3")
    return F.regexp_replace(bare, r"(\{[^{}]*+\})(?:\s*+,\s*+\1)++", "$1")


def _at(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value[name]
    return value


def _turns(fields: Column, layout: str) -> Column:
    """array<struct<role, text>> of a record's fields by a layout's mapping."""
    mapping = LAYOUTS[layout][1]
    if isinstance(mapping, list):
        return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(_at(fields, at), F.lit("")).alias("text")) for role, at in mapping])
    at, role, text = mapping
    same = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    named = lambda r: r if layout == AS_THEY_ARE else F.coalesce(F.try_element_at(same, r), r)
    return F.transform(_at(fields, at), lambda x: F.struct(named(F.coalesce(_at(x, role), F.lit(""))).alias("role"), F.coalesce(_at(x, text), F.lit("")).alias("text")))


def canonical_turns(records: DataFrame) -> DataFrame:
    """records (conv_id, record: JSON string) as (conv_id, layout, turns). With a column fields, a
    struct of FIELDS as records_of() gives it, record is a skeleton that must have a layout."""
    own = "fields" in records.columns
    if own:
        v = records.select("conv_id", "fields", F.parse_json("record").alias("v"))
    else:
        read = F.from_json("record", f"{FIELDS}, _broken string", {"columnNameOfCorruptRecord": "_broken", "maxStringLen": str(2**31 - 1)})
        v = records.select("conv_id", read.alias("fields"), skeleton(F.col("record")).alias("bare"))
        large = F.raise_error(F.lit(f"a record of more than {SKELETON_BYTES} bytes without its texts"))
        bare = F.when(F.octet_length("bare") > SKELETON_BYTES, large).when(F.col("fields._broken").isNull(), F.col("bare"))
        v = v.select("conv_id", "fields", F.try_parse_json(bare).alias("v"))
    v = v.withColumn("fp", fingerprint(F.col("v")))
    layout, turns = F.raise_error(F.lit("a record of ours has no layout")) if own else F.lit(None), F.array()
    layout, turns = layout.cast("string"), turns.cast("array<struct<role:string,text:string>>")
    for name, (paths, _) in LAYOUTS.items():
        fits = F.col("fp") == F.xxhash64(F.lit(_canonical(paths)))
        layout, turns = F.when(fits, name).otherwise(layout), F.when(fits, _turns(F.col("fields"), name)).otherwise(turns)
    if own:  # turns alone may be asked for
        turns = F.when(layout.isNotNull(), turns)
    return v.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    t = F.regexp_replace(text, "~", "~0")
    t = F.regexp_replace(t, r"<(?=/?s>|</?SYS>>|\|)", "~1")
    return F.regexp_replace(t, r"\[(?=/?INST\])", "~2")


def unescape(text: Column) -> Column:
    for mark, was in (("~1", "<"), ("~2", "["), ("~3", "|"), ("~4", "\n"), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(was))
    return text


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("|"), F.lit("~3")), F.lit("\n"), F.lit("~4"))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turns: array<struct<role, text>>) as (conv_id, formatted, loss_spans).

    loss_spans: array<struct<start, length>>, in code points of formatted."""
    rows = turns.select("conv_id", F.posexplode_outer("turns").alias("pos", "t"))
    head, body, trained = F.concat(F.lit("<|"), _role(F.col("t.role")), F.lit("|>\n")), escape(F.col("t.text")), F.col("t.role") == "assistant"
    rows = rows.select("conv_id", "pos", head.alias("head"), body.alias("body"), trained.alias("trained"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit("<|end|>\n")))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + 3 + F.length("head")
    rows = rows.withColumn("span", F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "trained", "span"))).alias("p"))
    text = F.concat(F.lit("<s>"), F.array_join("p.piece", ""), F.lit("</s>"))
    return packed.select("conv_id", text.alias("formatted"), F.transform(F.filter("p", lambda x: x["trained"]), lambda x: x["span"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns and loss_texts, parsed from the formatted text and its spans alone."""
    pieces = F.array_remove(F.split(F.expr("substring(formatted, 4, length(formatted) - 7)"), r"<\|end\|>\n"), "")

    def turn(x: Column) -> Column:
        head = F.locate("|>\n", x)
        return F.struct(unescape(F.substring(x, F.lit(3), head - 3)).alias("role"), unescape(F.substring(x, head + 3, F.length(x))).alias("text"))

    def loss(s: Column) -> Column:
        return unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))

    def many(wide: Column) -> Column:
        # Characters of four bytes each: a span is found without reading what stands before it.
        cut = lambda s: F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int"))
        return F.transform("loss_spans", lambda s: unescape(F.decode(cut(s), "UTF-32")))

    few = (F.size("loss_spans") <= FEW_SPANS) | (F.octet_length("formatted") > MOST_WIDE)
    losses = F.when(few, F.transform("loss_spans", loss)).otherwise(let(F.encode("formatted", "UTF-32"), many))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_texts": losses})


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as records (conv_id, record: skeleton, fields): exchanges of user and assistant
    in the prompt layout, those with a system turn first in the instruction layout, all others as
    turns. Only a record's own fields are filled; the skeleton is theirs."""
    rows = only(conversations, conv_id="conv_id", turn="turn", role=F.coalesce(conversations["role"], F.lit("")), text=F.coalesce(conversations["text"], F.lit("")))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    grouped = grouped.withColumn("kind", F.when(_roles("user", "assistant"), "prompt").when(_roles("system", "user", "assistant"), "instruction_input").otherwise("turns"))
    text = lambda kind, i: F.when(F.col("kind") == kind, F.get("t", F.lit(i))["text"])
    turns = F.when(F.col("kind") == "turns", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    of = {"prompt": text("prompt", 0), "completion": text("prompt", 1), "turns": turns}
    of |= {name: text("instruction_input", i) for i, name in enumerate(("instruction", "input", "output"))}
    fields = [of.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (x.split(" ") for x in FIELDS.split(", "))]
    held = grouped.select("conv_id", F.struct(*fields).alias("fields"))
    return held.select("conv_id", skeleton_of(F.col("fields"), held.schema["fields"].dataType).alias("record"), "fields")


def _roles(*roles: str) -> Column:
    return F.col("t.role") == F.array(*[F.lit(r) for r in roles])


def skeleton_of(fields: Column, kind: T.StructType) -> Column:
    """The JSON skeleton of the fields that a struct holds: those that aren't null. A list of objects
    has one, with the fields that any of them has."""

    def held(f: T.StructField, some) -> Column:
        """some(test): whether an object with f at this place passes."""
        inner, value = f.dataType, F.lit("")
        if isinstance(inner, T.StructType):
            value = F.struct(*[held(x, lambda test: some(lambda o: test(o[f.name]))) for x in inner])
        elif isinstance(inner, T.ArrayType):
            one = F.struct(*[held(x, lambda test: some(lambda o: F.exists(o[f.name], test))) for x in inner.elementType])
            value = F.when(some(lambda o: F.size(o[f.name]) > 0), F.array(one)).otherwise(F.array())
        return F.when(some(lambda o: o[f.name].isNotNull()), value).alias(f.name)

    return F.to_json(F.struct(*[held(f, lambda test: test(fields)) for f in kind]))


def op5_chat_formatting(spark, sf_dir):
    says = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_turns(canonical_turns(records_of(rows))))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"), F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(2 + length(role) + 3 + length(e) + 8))::BIGINT AS formatted_chars
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '~', '~0'), '<(/?s>|/?<SYS>>|\|)', '~1\1', 'g'), '<(</?SYS>>)', '~1\1', 'g'), '\[(/?INST\])', '~2\1', 'g') AS e FROM c)
GROUP BY conv_id
"""
