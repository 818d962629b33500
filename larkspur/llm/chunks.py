"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's bytes: each step shifts the hash by one bit and adds a
random number of the byte, so the hash depends on the last 32 bytes alone. A chunk ends
where the hash has zeros under a mask: a strict mask before the normal size, a loose one
after it (normalised chunking), never before the least or after the most size. An edit moves
the boundaries near it only, whatever it shifts.

A fingerprint is the set of a text's chunk digests, each with its length. The likeness of
a text to another is containment weighted by length: the share of its chunks' bytes that
lie in chunks the other has too.

All positions of a text are hashed at once: the sum over 32 bytes is built by doubling, in
blocks with 31 bytes of lead, so memory is bounded for texts of any length.

Defined results: null is the empty text; an empty text's fingerprint is the empty string; it
is contained in anything, and wholly like itself (1.0), while no other text is like it (0.0);
null ids come first, in order of a hash of their text, and rows of equal id stand in order of
text; an empty table gives an empty table; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, only, shuffle_parts, table

LEAST, NORMAL, MOST = 48, 128, 1024
#: Zero bits asked for before and after the normal size; the top bits depend on the most bytes.
STRICT_BITS, LOOSE_BITS = 9, 5
BLOCK = 1 << 18
_GEAR = np.array([random.Random(f"gear-{b}").getrandbits(32) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of gear[data[i - k]] << k over k < 32."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


def candidates(data: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ends (one past) of places from start on that pass the loose mask, and whether the strict too."""
    ends, strict = [], []
    for at in range(start, len(data), BLOCK):
        lead = max(0, at - 31)
        h = gear_hashes(data[lead : at + BLOCK])[at - lead :]
        hit = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
        ends.append(hit + at + 1)
        strict.append(h[hit] >> np.uint32(32 - STRICT_BITS) == 0)
    return (np.concatenate(ends), np.concatenate(strict)) if ends else (np.empty(0, np.int64), np.empty(0, bool))


def boundaries(size: int, ends: np.ndarray, strict: np.ndarray) -> list[int]:
    """Ends of the chunks of size bytes with the given candidates."""
    loose, hard = ends.tolist(), ends[strict].tolist()
    out, at, i, j = [], 0, 0, 0
    while size - at > LEAST:
        normal = at + NORMAL
        while j < len(hard) and hard[j] < at + LEAST:
            j += 1
        if j < len(hard) and hard[j] < normal:
            cut = hard[j]
        else:
            while i < len(loose) and loose[i] < normal:
                i += 1
            cut = loose[i] if i < len(loose) else size
        at = min(cut, at + MOST, size)
        out.append(at)
    if at < size:
        out.append(size)
    return out


class Print:
    """A text's chunks: digest to length, with what a text that shares its beginning can reuse."""

    def __init__(self, text: str, base: Print | None = None, shared: int = 0):
        """shared: how many leading bytes equal those of base's text."""
        self.data = text.encode()
        data = np.frombuffer(self.data, np.uint8)
        if base is None:
            self.ends, self.strict = candidates(data)
        else:
            n = int(np.searchsorted(base.ends, shared, "right"))
            ends, strict = candidates(data, shared)
            self.ends, self.strict = np.concatenate([base.ends[:n], ends]), np.concatenate([base.strict[:n], strict])
        self.chunks: dict[str, int] = {}
        start = 0
        for end in boundaries(len(data), self.ends, self.strict):
            self.chunks[hashlib.blake2b(self.data[start:end], digest_size=8).hexdigest()] = end - start
            start = end

    def text(self) -> str:
        return " ".join(f"{d}.{n:x}" for d, n in sorted(self.chunks.items()))

    def contained(self, other: Print) -> float:
        return containment(self.chunks, other.chunks)


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else float(not b)


def parse(fingerprint: str) -> dict[str, int]:
    """The digests and lengths of a fingerprint."""
    return {d: int(n, 16) for d, n in (x.split(".") for x in fingerprint.split())}


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with (fingerprint, n_bytes): the operator for texts on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [Print(t or "") for t in batch.column("text").to_pylist()]
            made = [pa.array([p.text() for p in prints], pa.string()), pa.array([len(p.data) for p in prints], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "fingerprint", "n_bytes"])

    return map_arrow(only(docs, doc_id="doc_id", text="text"), run, "doc_id long, fingerprint string, n_bytes long")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) dealt into runs of their order, with columns h, part and halo: the first
    rows of a run stand at the end of the run before it too, as halo rows, and the first of all
    after the last. The order is that of ids; null ids come first, by a hash h of their text. Cuts
    are values of the table, `parts` of them at most; a row finds its run by bisection."""
    docs = only(docs, doc_id="doc_id", text="text").withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    cuts, n_nulls, n = _cuts(docs, parts)
    least = {c: x[0] if x else None for c, x in cuts.items()}
    cuts = {c: x[1:] for c, x in cuts.items()}
    # Null ids have as many runs as their share asks for.
    few = max(1, -(-len(cuts["h"]) * n_nulls // max(1, n)))
    cuts["h"] = cuts["h"][:: max(1, len(cuts["h"]) // few)]
    runs = len(cuts["h"]) + 1 if n_nulls else 0  # of null ids
    told = {c: F.from_json(F.lit(str(x)), "array<bigint>") for c, x in cuts.items()}  # literals, folded when planned
    null = F.col("doc_id").isNull()
    rank = F.when(null, _rank(told["h"], "h", len(cuts["h"]))).otherwise(_rank(told["doc_id"], "doc_id", len(cuts["doc_id"])))
    dealt = docs.withColumn("rank", rank).withColumn("part", F.col("rank") + F.when(null, 0).otherwise(runs))
    leads = F.when(null, F.get(told["h"], F.col("rank") - 1) == F.col("h")).otherwise(F.get(told["doc_id"], F.col("rank") - 1) == F.col("doc_id"))
    leads = F.when(F.col("rank") > 0, leads).otherwise(~null & (F.col("doc_id") == F.lit(least["doc_id"])))
    own = F.struct("part", F.lit(0).alias("halo"))
    before = F.when(leads & (F.col("part") > 0), F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("halo")))
    first = null & (F.col("h") == F.lit(least["h"])) if n_nulls else F.col("doc_id") == F.lit(least["doc_id"])
    last = runs + len(cuts["doc_id"]) - (n_nulls == n)
    around = F.when(first, F.struct(F.lit(last).alias("part"), F.lit(2).alias("halo")))
    copies = F.filter(F.array(own, before, around), lambda x: x.isNotNull())
    return dealt.withColumn("p", F.explode(copies)).select("p.part", "p.halo", "doc_id", "h", "text")


def _cuts(docs: DataFrame, parts: int) -> tuple[dict[str, list[int]], int, int]:
    """By column (h, doc_id), the least value and those at which a run begins, sorted, `parts` at most;
    and how many rows have no id, and how many there are. Percentiles are approximate, and of
    doubles; the least value from each on is one of the table's."""
    at, accuracy = [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts)
    counts = docs.agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    out: dict[str, list[int]] = {}
    # Texts are read for their hashes where there are null ids alone.
    for c, n in (("h", counts["nulls"]), ("doc_id", counts["n"] - counts["nulls"])):
        rows = docs.where(F.col("doc_id").isNull() if c == "h" else F.col("doc_id").isNotNull()).select(c)
        told = sorted({*(rows.agg(F.percentile_approx(c, at, accuracy)).first()[0] if n and parts > 1 else ())})
        rank = _rank(F.from_json(F.lit(str(told)), "array<bigint>"), c, len(told))
        out[c] = sorted(r["v"] for r in rows.groupBy(rank.alias("rank")).agg(F.min(c).alias("v")).collect()) if n else []
    return out, counts["nulls"], counts["n"]


def _rank(cuts, name: str, n: int):
    """How many of the n sorted cuts are at or below a column."""

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))
        left = F.struct(a["lo"].alias("lo"), mid.alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(F.get(cuts, mid) <= F.col(name), right).otherwise(left)

    rounds = F.array(*[F.lit(i) for i in range(n.bit_length() + 1)])
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step, lambda a: a["lo"])


def edited(text: str, other: str) -> tuple[str, int]:
    """text with its last half (floor) replaced by as many first code points of other, or all of
    them; and how many code points were kept."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half], len(text) - half


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each text's fingerprint beside that of its edit by the next document's, in the order of
    in_order(): rows of SCHEMA. A table of one row is its own next."""
    spark = docs.sparkSession
    parts = parts or 8 * shuffle_parts(spark)
    dealt = in_order(docs, parts).repartition(shuffle_parts(spark), "part").sortWithinPartitions("part", "halo", F.col("doc_id").asc_nulls_first(), "h", "text")

    def row(doc_id, own: Print, other: Print, text: str, next_text: str) -> tuple:
        changed, kept = edited(text, next_text)
        e = Print(changed, own, len(text[:kept].encode()))
        return doc_id, len(text), hashlib.sha256(e.data).hexdigest(), own.text(), e.text(), own.contained(e), own.contained(other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, False  # the row that waits for its next: part, id, text, print
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch, rows = whole.slice(i, 500), []
                for part, halo, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "doc_id", "text")), strict=True):
                    text = text or ""
                    if last is not None and last[0] != part:
                        last, done = None, False
                    if halo and (done or last is None):
                        continue
                    own = Print(text)
                    if last is not None:
                        rows.append(row(last[1], last[3], own, last[2], text))
                    done = bool(halo)
                    last = (part, doc_id, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return map_arrow(dealt, run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def op2_chunk_fingerprints(spark, sf_dir):
    return with_edits(table(spark, sf_dir, "documents"))
