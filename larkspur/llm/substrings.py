"""Substring dedup by level-wise doubling.

A window of `window` words that also starts earlier (in a document of smaller id, or before
in the same one) is a repeat; the words that repeats cover are removed. Candidates are found
on a ladder of lengths, each twice the one below, up to the window: a window can only repeat
if its parts do, so only what repeats at one length is extended to the next. Each rung is a
job of its own: it reads the documents that still have candidates, with a bit per word for
those, and writes them back; where no candidate survives, the ladder ends.

Below the top a window stands in by two parts: those with the least and the greatest hash among
its parts of that length (equal windows choose equal parts), so a rung looks at a quarter or a
third of all positions; a window of which either doesn't repeat is no candidate.

Documents are dealt into blocks by a hash of their id. On each rung a block sends its
distinct part hashes, packed, to buckets by hash; a bucket answers each block with one bit
per hash: does it repeat? However often a passage repeats, a block names it once. At the top
a hash goes with the smallest id that has it in the block, and the bit says whether another
block has a smaller one. All texts are shuffled once, by the lowest rung; higher ones shuffle
what has candidates left.

Windows are compared by 64-bit hashes of their words; a false repeat needs a collision at
the top between windows whose parts repeat on every rung below.

Defined results: null and empty texts have no words and lose none; texts shorter than the
window lose none; null ids come last, in an order by a hash of their text; rows of equal id
stand in order of text; a table without repeats keeps all its texts unchanged; an empty table
gives an empty table; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.llm.common import let_go, only, shuffle_parts, stash, table, words
from larkspur.llm.wordhash import Words, mixed, pieces, words_of
from larkspur.sources.shipping import ship

WINDOW = 20
#: Text bytes of a block and hash bytes of a bucket, both in one task's memory at a time.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
_LAST = np.iinfo(np.int64).max
_SENT = "bucket int, block int, hashes binary, twice binary, ids binary, base long"
_ANSWER = "block int, bucket int, bits binary"


def ladder(window: int, least: int = 5) -> list[int]:
    """Lengths that double up to the window; the lowest is at least `least` where that can be."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= least:
        out.insert(0, out[0] // 2)
    return out


def _slid(a: np.ndarray, m: int, op, fill, back: bool = False) -> np.ndarray:
    """op over a[i : i + m] (back: a[i - m + 1 : i + 1]), by doubling."""
    if back:
        return _slid(a[::-1], m, op, fill)[::-1]

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.full_like(x, fill)
        if by < len(x):
            out[: len(x) - by] = x[by:]
        return out

    size = 1
    while size * 2 <= m:
        a, size = op(a, shifted(a, size)), size * 2
    return op(a, shifted(a, m - size)) if size < m else a


class Block:
    """One block's documents, in order, on one rung."""

    def __init__(self, rows: pa.Table, window: int, length: int):
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.window, self.length = window, length
        self.words = [words_of(p.column("text")) for p in pieces(self.rows)]
        self.first = np.concatenate([[0], np.cumsum([n for w in self.words for n in np.diff(w.first)])]).astype(np.int64)
        #: Of each word: does a candidate window start here?
        if "alive" in rows.column_names:
            alive = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(self.rows.column("alive").to_pylist(), np.diff(self.first), strict=True)]
            alive = np.concatenate([np.empty(0, np.uint8), *alive]).astype(bool)
            ends = np.cumsum([len(w.hash) for w in self.words])
            self.alive = [alive[e - len(w.hash) : e] for w, e in zip(self.words, ends, strict=True)]
        else:
            self.alive = [w.whole(window) for w in self.words]

    def _stand_in(self, w: Words, alive: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The least and the greatest part hash of each window, and which parts stand in for a candidate."""
        h, m = w.windows(self.length), self.window - self.length + 1
        chosen, stands = [], np.zeros(len(h), bool)
        for turned in (False, True):
            part = ~h if turned else h
            least = _slid(part, m, np.minimum, np.uint64(2**64 - 1))
            most = _slid(np.where(alive, least, np.uint64(0)), m, np.maximum, np.uint64(0), back=True)
            stands |= (most == part) & (part != 0)
            chosen.append(~least if turned else least)
        return chosen, stands

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of this rung, whether each repeats here, and the smallest id that has it."""
        none = np.empty(0, np.uint64)
        if self.length < self.window:
            found = [self._stand_in(w, a) for w, a in zip(self.words, self.alive, strict=True)]
            self.chosen = [x for x, _ in found]
            h = np.concatenate([none, *(w.windows(self.length)[s] for w, (_, s) in zip(self.words, found, strict=True))])
            hashes, n = np.unique(h, return_counts=True)
            return hashes, n > 1, np.empty(0, np.int64)
        self.at = np.flatnonzero(np.concatenate([np.empty(0, bool), *self.alive]))
        h = np.concatenate([none, *(w.windows(self.length)[a] for w, a in zip(self.words, self.alive, strict=True))])
        hashes, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.earliest = self.at[first]
        ids = np.asarray(self.rows.column("doc_id").fill_null(_LAST).combine_chunks(), np.int64)
        return hashes, np.zeros(len(hashes), bool), ids[np.searchsorted(self.first, self.earliest, "right") - 1]

    def survivors(self, repeated: np.ndarray) -> list[bytes | None]:
        """Of each document: the bits of the candidates whose parts are among the repeated hashes, if any."""
        out = []
        for w, alive, chosen in zip(self.words, self.alive, self.chosen, strict=True):
            stays = alive if len(repeated) else np.zeros(len(alive), bool)
            for part in chosen if len(repeated) else ():
                stays = stays & (repeated[np.minimum(np.searchsorted(repeated, part), len(repeated) - 1)] == part)
            docs = (stays[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True))
            out += [np.packbits(x).tobytes() if x.any() else None for x in docs]
        return out

    def covered(self, elsewhere: np.ndarray) -> np.ndarray:
        """Of each word: do repeats cover it? elsewhere: of each distinct top hash, is it earlier in another block?"""
        n = int(self.first[-1])
        repeat = elsewhere[self.which] | (self.at != self.earliest[self.which]) if len(self.at) else np.empty(0, bool)
        starts = self.at[repeat]
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.window, -1)
        return np.cumsum(change[:n]) > 0


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(buckets)).astype(np.int64)


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by bucket, and where each bucket's begin in it."""
    b = _bucket(hashes, buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def _told(block: Block, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's hashes on this rung, and what the buckets say of each."""
    hashes, flag, _ = block.sent()
    order, cuts = _dealt(hashes, buckets)
    for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        own = order[cuts[bucket] : cuts[bucket + 1]]
        flag[own] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    return hashes, flag


def _sender(window: int, length: int, buckets: int):
    def run(key, rows):
        hashes, twice, ids = Block(rows, window, length).sent()
        order, cuts = _dealt(hashes, buckets)
        out: dict[str, list] = {c: [] for c in ("bucket", "block", "hashes", "twice", "ids", "base")}
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[bucket] : cuts[bucket + 1]]
            mine = ids[own] if len(ids) else ids
            base = int(mine.min()) if len(mine) else 0
            # Ids take as few bytes as they need beyond the smallest.
            small = (mine.astype(np.uint64) - np.uint64(base % 2**64)) if len(mine) else mine
            kind = np.uint32 if len(small) and int(small.max()) < 2**32 else np.uint64
            row = (bucket, key[0].as_py(), hashes[own].tobytes(), np.packbits(twice[own]).tobytes(), small.astype(kind).tobytes(), base)
            for column, v in zip(out.values(), row, strict=True):
                column.append(v)
        return pa.table([pa.array(out[c], t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], list(out))

    return run


def _answerer(top: bool):
    def run(key, sent):
        hashes = [np.frombuffer(x, np.uint64) for x in sent.column("hashes").to_pylist()]
        every = np.concatenate(hashes)
        source = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        order = np.argsort(every, kind="stable")
        same = every[order]
        begins = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        counts = np.diff(np.concatenate([begins, [len(same)]]))
        if top:
            ids = []
            for h, raw, base in zip(hashes, sent.column("ids").to_pylist(), sent.column("base").to_pylist(), strict=True):
                small = np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(h) else np.uint64).astype(np.uint64)
                ids.append((small + np.uint64(base % 2**64)).astype(np.int64))
            ids = np.concatenate(ids)[order]
            least = np.repeat(np.minimum.reduceat(ids, begins), counts)
            # Blocks share no id but the null one, whose rows come last: the first block has it.
            tie = (ids == least) & (ids == _LAST)
            if tie.any():
                block_of = np.asarray(sent.column("block").to_pylist())[source][order]
                lowest = np.repeat(np.minimum.reduceat(np.where(tie, block_of, _LAST), begins), counts)
                flag = (ids != least) | (tie & (block_of != lowest))
            else:
                flag = ids != least
        else:
            here = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(sent.column("twice").to_pylist(), hashes, strict=True)]).astype(bool)[order]
            flag = np.repeat((counts > 1) | np.logical_or.reduceat(here, begins), counts)
        back = np.empty(len(flag), bool)
        back[order] = flag
        cuts = np.cumsum([0, *map(len, hashes)])
        out = [(block, np.packbits(back[a:b]).tobytes()) for block, a, b in zip(sent.column("block").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if back[a:b].any()]
        n = len(out)
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["block", "bucket", "bits"])

    return run


def _marker(window: int, length: int, buckets: int, schema: pa.Schema):
    """Rows with n_words and their candidates after this rung."""

    def run(key, rows, answers):
        block = Block(rows, window, length)
        hashes, flag = _told(block, answers, buckets)
        new = {"n_words": np.diff(block.first), "alive": block.survivors(hashes[flag])}
        return pa.table([pa.array(new[f.name], f.type) if f.name in new else block.rows.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def _remover(window: int, buckets: int, schema: pa.Schema):
    """Rows without the words that repeats cover."""

    def run(key, rows, answers):
        block = Block(rows, window, window)
        gone = block.covered(_told(block, answers, buckets)[1])
        texts, spans, n_words, n_removed, doc = [], [], [], [], 0
        originals = block.rows.column("text").to_pylist()
        for w in block.words:
            for i in range(len(w.first) - 1):
                a, b = int(block.first[doc]), int(block.first[doc + 1])
                lost = gone[a:b]
                n_words.append(b - a)
                n_removed.append(int(lost.sum()))
                if not n_removed[-1]:
                    texts.append(originals[doc])
                    spans.append([])
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate([[1], lost.astype(np.int8), [1]])))
                    kept = edges.reshape(-1, 2)
                    at = int(w.first[i])
                    texts.append("\n".join(w.data[w.start[at + x] : w.end[at + y - 1]].tobytes().decode() for x, y in kept.tolist()))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).reshape(-1, 2)
                    spans.append([{"start": x, "end": y} for x, y in edges.tolist()])
                doc += 1
        new = {"text": texts, "n_words": n_words, "n_removed": n_removed, "removed": spans}
        return pa.table([pa.array(new[f.name], f.type) if f.name in new else block.rows.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def dedup(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), least: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, and the columns of keep) with text cut, and n_words, n_removed, removed.

    text: unchanged where nothing goes, else the kept runs as they stood, a line each;
    removed: array<struct<start, end>>, spans of words of the input."""
    spark = docs.sparkSession
    ship(spark)
    rows = only(docs, doc_id="doc_id", text="text", **{c: c for c in keep})
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shuffle_parts(spark)
    blocks = max(parts, -(-total // block_bytes))
    out = StructType([*rows.schema.fields, *StructType.fromDDL("n_words long, n_removed long, removed array<struct<start:int,end:int>>").fields])
    marked = StructType([*StructType.fromDDL("block int").fields, *rows.schema.fields, *StructType.fromDDL("n_words long, alive binary").fields])
    key = F.coalesce("doc_id", F.xxhash64("text"))  # null ids don't meet in one block
    left, done = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), *rows.columns), []
    for length in ladder(window, least):
        # At most 8 bytes for each of total / 5 words, a third of them below the top.
        buckets = max(parts, -(-(total * 8 // (5 if length == window else 15)) // BUCKET_BYTES))
        sent = left.groupBy("block").applyInArrow(_sender(window, length, buckets), _SENT)
        answers = sent.groupBy("bucket").applyInArrow(_answerer(length == window), _ANSWER)
        both = left.groupBy("block").cogroup(answers.groupBy("block"))
        if length == window:
            done.append(both.applyInArrow(_remover(window, buckets, to_arrow_schema(out)), out))
            break
        rung = stash(both.applyInArrow(_marker(window, length, buckets, to_arrow_schema(marked)), marked), f"substrings-{length}")
        whole = [F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,end:int>>").alias("removed")]
        done.append(rung.where("alive IS NULL").select(*rows.columns, "n_words", *whole))
        left = rung.where("alive IS NOT NULL")
        del sent, answers, both
        let_go(spark)
        if left.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, done)


def op3_substring_dedup(spark, sf_dir):
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("kept_sha256"))
