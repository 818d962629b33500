"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file. Its byte strings become character strings by the byte-level
alphabet (each byte a printable character), and the merges are every pair of vocabulary
entries whose concatenation is an entry, in rank order, so the lowest rank merges first.

With the default pattern a text is cut at single spaces and line breaks between characters that
are no white space: no match spans such a place, so the parts encode on their own; with any other
pattern texts are encoded whole. Each distinct part
of a batch goes through the library once, many joined in one string whose ids are told apart
by their lengths in bytes; the memo that carries parts to later batches is bounded.

Offsets come from the byte table: token lengths in bytes sum to byte offsets, and a
byte-to-character map of the text turns those into code points. A token may begin or end
within a character; its span then covers that character. Decoding looks each id up in the
byte table and joins the bytes, so split characters come back whole; only decode_text()
has to replace what isn't UTF-8.

Defined results: null and empty texts have no ids and decode to no bytes; ids outside the
vocabulary raise; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from larkspur.llm.common import map_arrow, only, table
from larkspur.llm.wordhash import pieces

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct parts that a task remembers between batches, and the longest that it remembers.
MEMO_PARTS, MEMO_CHARS = 200_000, 64
ENDINGS = ".,;:!?*&$%#"
#: Parts that go through the library in one string.
RUN = 64
#: Text bytes that are encoded at a time, and ids that are decoded, of one row at least; ids that are
#: looked up at a time.
BATCH_BYTES, BATCH_IDS, RUN_IDS = 64 << 20, 8 << 20, 1 << 19
ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable in Latin-1, else the next code point from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    table = {b: chr(b) for b in printable}
    table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
    return [table[b] for b in range(256)]


class ByteTable:
    """The bytes of each id of a rank file: all that decoding and offsets need."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            bytes_of[r] = t
        self.lengths = np.array([len(t) for t in bytes_of], np.int64)
        self._table, self._starts = np.frombuffer(b"".join(bytes_of), np.uint8), np.cumsum(self.lengths) - self.lengths

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last code point of each token, by way of its bytes."""
        data = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32) - 1
        end = np.cumsum(self.lengths[ids])
        return char_of[end - self.lengths[ids]], char_of[end - 1] + 1

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of a run of ids by the byte table, and where those of ids[:end] end."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths) and self.lengths[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        parts, total = [], np.cumsum(self.lengths[ids])
        for i in range(0, len(ids), RUN_IDS):
            some = ids[i : i + RUN_IDS]
            size = self.lengths[some]
            at = np.arange(size.sum()) + np.repeat(self._starts[some] - (np.cumsum(size) - size), size)
            parts.append(self._table[at].tobytes())
        return b"".join(parts), np.concatenate([[0], total])[ends]


class Codec(ByteTable):
    """The encoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        super().__init__(path)
        self._whole = pattern != public_tokenizers.PATTERN
        ranks, chars = self.ranks, byte_characters()
        told = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for t in sorted(ranks, key=ranks.get):
            pairs = [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
            merges += [(told[a], told[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
        self._tokenizer = Tokenizer(models.BPE(vocab={told[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self._tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Ids, as bytes, of parts after a space and of parts after a line break or at the start.
        self._spaced: dict[str, bytes] = {"": self._one(" ")}
        self._bare: dict[str, bytes] = {"": b""}
        self._line = self._one("\n")
        self._endings: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _encoded(self, parts: list[str], before: str) -> list[bytes]:
        """The ids of parts that stand after a space or a line break, many in one string."""
        if not parts:
            return []
        runs = [before + before.join(parts[i : i + RUN]) for i in range(0, len(parts), RUN)]
        ids = [np.array(e.ids, np.int32) for e in self._tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate(ids)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)) + len(before))
        ends = 4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)
        data, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        skip = 0 if before == " " else len(self._line)
        return [data[a + skip : b] for a, b in zip(starts, ends.tolist(), strict=True)]

    def _learn(self, spaced: set[str], bare: set[str]) -> list[tuple[dict, str]]:
        """Encodes what isn't remembered; returns what is too long to be remembered.

        Punctuation after a word is a match of its own, so a word is encoded once for all its endings."""
        long = []
        for memo, seen, before in ((self._spaced, spaced, " "), (self._bare, bare, "\n")):
            new = seen - memo.keys()
            ended = {p: stem for p in new if (stem := p.rstrip(ENDINGS)) != p and stem and stem[-1].isalpha()}
            # At the start of a text, where white space may stand, a part goes alone.
            alone = [p for p in new if p[0].isspace() or p[-1].isspace()]
            whole = list({*(new - ended.keys()).difference(alone), *(set(ended.values()) - memo.keys())})
            memo.update(zip(whole, self._encoded(whole, before), strict=True))
            memo.update((p, self._one(p if memo is self._bare else " " + p)) for p in alone)
            for p, stem in ended.items():
                memo[p] = memo[stem] + self._ending(p[len(stem) :])
            long += [(memo, p) for p in {*new, *whole} if len(p) > MEMO_CHARS]
        return long

    def _ending(self, mark: str) -> bytes:
        if (ids := self._endings.get(mark)) is None:
            ids = self._one(mark)
            if len(self._endings) < 10_000:
                self._endings[mark] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self._whole:
            return [np.frombuffer(self._one(t), np.int32) for t in texts]
        cut = [_parts(t) for t in texts]
        bare = {line[0] for lines in cut for line in lines}
        spaced: set[str] = set()
        for lines in cut:
            for line in lines:
                spaced.update(line[1:])
        for memo in (self._spaced, self._bare):
            if len(memo) > MEMO_PARTS:
                nothing = memo[""]
                memo.clear()
                memo[""] = nothing
        long = self._learn(spaced, bare)
        after, first = self._spaced.__getitem__, self._bare.__getitem__
        out = [np.frombuffer(self._line.join([b"".join([first(line[0]), *map(after, line[1:])]) for line in lines]), np.int32) for lines in cut]
        for memo, p in long:
            memo.pop(p, None)
        return out


def _parts(text: str) -> list[list[str]]:
    """A text's lines, each cut at spaces. Lines joined by line breaks and their parts by spaces are
    the text; no match of the pattern but a part's own leading space spans a cut."""
    if not _DOUBLE.search(text):
        return [line.split(" ") for line in text.split("\n")]
    return [_CUT.split(text)]


@functools.lru_cache(2)
def _codec(path: str, pattern: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Codec(path, pattern)


@functools.lru_cache(2)
def _table(path: str) -> ByteTable:
    return ByteTable(path)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def _encoded(codec: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
    """ids, starts and ends of a batch's texts."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    ids = codec.encode(texts)
    spans = [codec.offsets(t, i) if len(i) else (i, i) for t, i in zip(texts, ids, strict=True)]
    return [_lists(ids), _lists([a for a, _ in spans]), _lists([b for _, b in spans])]


def _decoded(table: ByteTable, ids: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids."""
    lists = ids.fill_null([])
    ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
    data, ends = table.decode(lists.flatten().to_numpy(), ends)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, rows: int = 400, decoded: bool = False) -> DataFrame:
    """docs (doc_id, text) as (doc_id, ids, starts, ends); path: of the rank file, on every machine.

    decoded: adds decode()'s bytes of those ids, in the same pass over a batch."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for whole in batches:
            for batch in (x for at in range(0, whole.num_rows, rows) for x in pieces(whole.slice(at, rows), "text", BATCH_BYTES)):
                made = _encoded(codec, batch)
                more = [_decoded(codec, made[0])] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *more], ["doc_id", "ids", "starts", "ends", *["decoded"] * decoded])

    return map_arrow(only(docs, doc_id="doc_id", text="text"), run, ENCODED + ", decoded binary" * decoded)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of ids, one row at least; their bytes have 32-bit offsets."""
    at, held = 0, 0
    for i, n in enumerate(batch.column("ids").fill_null([]).value_lengths().to_pylist()):
        if held and held + n > BATCH_IDS:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def decode(encoded: DataFrame, path: str | None = None, rows: int = 500) -> DataFrame:
    """Rows with ids, with the decoded bytes added as decoded."""
    path = path or public_tokenizers.path(RANKS)
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for whole in batches:
            for batch in (x for at in range(0, whole.num_rows, rows) for x in _slices(whole.slice(at, rows))):
                yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(table, batch.column("ids"))], [*batch.schema.names, "decoded"])

    return map_arrow(encoded, run, schema)


def decode_text(decoded):
    """A column of decoded bytes as text, where they are UTF-8; else null."""
    return F.when(F.is_valid_utf8(decoded.cast("string")), decoded.cast("string"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode() and decode()."""
    out = encode(docs, path, decoded=True)
    told = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
