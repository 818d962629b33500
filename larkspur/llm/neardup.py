"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct word shingles, lower-cased in A-Z. Its sketch has a register
per hash function: the least of exponentially distributed hashes of the set, on an
exponential scale and truncated, floor(1 - log_b(least)). Sketches merge by their greatest
registers, and two sketches agree in a register about as often as their sets are similar, so
runs of registers serve as band keys. The similarity of a pair is estimated jointly by
likelihood from how many registers are greater, less and equal, given both set sizes; what
may reach the threshold is then verified on the full sets.

Equal sets are one class, found by a digest; only a class's first document goes on. Within
a band key's group no all-pairs join is made:

1. Every member is paired with the group's hub, the member with the most company over all
   its groups; the verified links give components.
2. Members of a group that are in different components, and neither of them a hub, may still
   be linked. Such groups get another star, around a member that isn't in the last hub's
   component, as long as that at least halves them.
3. Of what is left, members meet by their rarest shingles (an exact prefix filter with bounds
   by position). Those that could be linked form clusters; a cluster is dealt into blocks, and
   two blocks at a time are compared on full sets, by an inverted index. Fewer links come out
   than members go in. Nothing is capped.

Links are all pairs at or above the threshold that share a band key: at 32 bands of five
registers a pair at 0.85 is missed with a chance of 7e-9, at 0.8 of 3e-6. A star pair at the
threshold has an estimate too low to be verified with a chance of 3e-10 at 0.85, 1e-10 at 0.8.

Defined results: null and empty texts have an empty set and are linked with nothing; texts
with fewer words than a shingle have one shingle, all their words; a null id has a null
component and is kept; rows of equal id share a component; an empty table gives an empty
table. Only doc_id and text are read; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, map_arrow, only, shuffle_parts, stash, table
from larkspur.llm.urls import MOST_BITS, _bits, _level
from larkspur.llm.wordhash import mixed, pieces, window_sums, words_of
from larkspur.sources.shipping import ship

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: The sketch's parameters: base, rate, and the greatest register below the last.
B, A, Q = 1.001, 20.0, 2**16 - 2
_rnd = random.Random("setsketch")
_MUL = np.array([_rnd.getrandbits(64) | 1 for _ in range(REGISTERS)], np.uint64)
_ADD = np.array([_rnd.getrandbits(64) for _ in range(REGISTERS)], np.uint64)
#: Standard deviations below the threshold at which an estimate still is verified.
SIGMAS = 7
#: Members of a cluster that are compared with as many others in one task.
BLOCK = 400
#: Set bytes of a block of open members and of a bucket of shingles, both in one task's memory.
SET_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
SKETCH = "doc_id long, n_shingles long, digest binary, registers binary"


# ---------------------------------------------------------------- sets and sketches


def shingle_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one after another; and where each set begins."""
    w = words_of(texts, lower=True)
    n = np.diff(w.first)
    h, doc = w.windows(k)[w.whole(k)], np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        alone = np.array([mixed(window_sums(w.hash[w.first[i] : w.first[i + 1]], int(n[i]))[:1] + np.uint64(n[i]))[0] for i in few], np.uint64)
        h, doc = np.concatenate([h, alone]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def sketch_sets(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (documents x REGISTERS, uint16) of sets that aren't empty; of empty ones zeros."""
    full = np.flatnonzero(np.diff(first))
    least = np.empty((REGISTERS, len(full)), np.uint64)
    for r in range(REGISTERS):
        least[r] = np.minimum.reduceat(h * _MUL[r] + _ADD[r], first[full]) if len(full) else 0
    out = np.zeros((len(first) - 1, REGISTERS), np.uint16)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / A
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(B)), 0, Q + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest similarity of each pair of rows of registers, given the sizes of their sets."""
    greater, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - greater - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-x * (B - 1) / B) / math.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0)
        return log(greater, up) + log(less, down) + log(equal, np.maximum(1 - up - down, 0))

    lo, hi, g = np.zeros(len(a)), np.minimum(u / v, v / u), (math.sqrt(5) - 1) / 2
    for _ in range(32):  # golden section: the likelihood has one peak
        left, right = hi - g * (hi - lo), lo + g * (hi - lo)
        up = likelihood(left) < likelihood(right)
        lo, hi = np.where(up, left, lo), np.where(up, hi, right)
    return (lo + hi) / 2


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) as rows of SKETCH."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                h, first = shingle_sets(part.column("text"), k)
                registers = sketch_sets(h, first)
                digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
                made = [pa.array(np.diff(first), pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "n_shingles", "digest", "registers"])

    return map_arrow(only(docs, doc_id="doc_id", text="text"), run, SKETCH)


def band_keys(classes: DataFrame) -> DataFrame:
    """(rep, registers) as rows (key, rep), one for each band."""

    def run(batches):
        weight = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mixed(np.arange(100, 100 + BANDS, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                r = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = mixed((mixed(r + np.uint64(1)) * weight).sum(2, dtype=np.uint64) + salt)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(part.column("rep")), BANDS))], ["key", "rep"])

    return map_arrow(classes.select("rep", "registers"), run, "key long, rep long")


# ---------------------------------------------------------------- pairs


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes allow the threshold and whose estimate comes near it."""
    t = percent / 100
    least = t - SIGMAS * math.sqrt(t * (1 - t) / REGISTERS)
    one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "na", "nb", "ra", "rb")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                near = jaccard(ra, rb, np.asarray(part.column("na"), float), np.asarray(part.column("nb"), float)) >= least
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(near)), part.column("b").filter(pa.array(near))], ["a", "b"])

    return map_arrow(both, run, "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, text) of about the ids (id) given: a Bloom filter of bounded size, read as a scalar
    subquery, drops most other texts at the scan; beyond its bound all texts pass. And what to
    discard once they are read."""
    n = ids.count()
    n_bits = 64 * max(1, -(-n * 12 // 64))
    if n_bits > MOST_BITS:
        return docs, []
    bits = stash(_level(ids.select(F.col("id").alias("key")), 0, n_bits), "near-ids")
    hit = F.lit(True)
    for b in _bits(F.col("doc_id"), 0, n_bits):
        word = F.element_at(bits.scalar(), (F.floor(b / 64) + 1).cast("int"))
        hit = hit & (F.call_function("shiftrightunsigned", word, (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return docs.where(hit), [bits]


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough; written."""
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-members", 2 * pairs.count())
    texts, scratch = texts_of(docs, ids)
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "ta"):
                ha, fa = shingle_sets(part.column("ta"), k)
                hb, fb = shingle_sets(part.column("tb"), k)
                near = []
                for i in range(part.num_rows):
                    x, y = ha[fa[i] : fa[i + 1]], hb[fb[i] : fb[i + 1]]
                    shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    near.append(100 * shared >= percent * (len(x) + len(y) - shared))
                near = pa.array(near, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(near), part.column("b").filter(near)], ["a", "b"])

    out = stash(map_arrow(both, run, "a long, b long"), "near-links")
    discard(ids, *scratch)
    return out


def hashed_sets(reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """reps (rep, label) with hashes, the full sets of their texts; written."""
    ids = reps.select(F.col("rep").alias("id"))
    texts, scratch = texts_of(docs, ids)
    texts = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                h, first = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["rep", "hashes"])

    out = stash(reps.join(map_arrow(texts, run, "rep long, hashes binary"), "rep"), "near-sets")
    discard(*scratch)
    return out


def _packed(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table([pa.array(columns[c], t) for c, t in types.items()], list(types))


def _cuts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of hashes by bucket, and (bucket, begin, end) of the buckets that have any."""
    bucket = (mixed(h) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, [(int(i), int(ends[i]), int(ends[i + 1])) for i in np.flatnonzero(np.diff(ends))]


_INT, _LONG, _BYTES = pa.int32(), pa.int64(), pa.binary()


def prefix_stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that span the groups of members (rep, label, hashes) in which a link between
    different labels can be.

    All shingles stand in one order, the rarest among the members first. Two sets of the
    similarity asked for share one of the first n - ceil(t n) + 1 shingles of either, and what
    stands from there on in each is an upper bound of what they share. So members meet by those
    shingles alone, and one whose bound is too low for any other member there is out. Members are
    dealt into blocks: a block names a shingle once, with its count, and gets one packed answer
    from each bucket of shingles."""
    spark, parts = members.sparkSession, shuffle_parts(members.sparkSession)
    total = members.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    blocks, buckets = (max(parts, -(-total // size)) for size in (SET_BYTES, BUCKET_BYTES))
    dealt = members.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), "rep", "label", "hashes")

    def shingles(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        return np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)

    counted = {"bucket": _INT, "block": _INT, "hashes": _BYTES, "counts": _BYTES}
    answer = {"block": _INT, "bucket": _INT, "counts": _BYTES}
    named = {"bucket": _INT, "hashes": _BYTES, "rows": _BYTES}

    def send(key, t):
        h, n = np.unique(shingles(t)[0], return_counts=True)
        order, cuts = _cuts(h, buckets)
        h, n = h[order], n[order].astype(np.uint32)
        told = {"hashes": [h[x:y].tobytes() for _, x, y in cuts], "counts": [n[x:y].tobytes() for _, x, y in cuts]}
        return _packed({"bucket": [i for i, _, _ in cuts], "block": [key[0].as_py()] * len(cuts)} | told, counted)

    def count(key, t):
        h, n = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("hashes", np.uint64), ("counts", np.uint32)))
        _, which = np.unique(h, return_inverse=True)
        n = np.minimum(np.bincount(which, n), 2**32 - 1).astype(np.uint32)[which]
        ends = np.cumsum([0, *(len(x) // 8 for x in t.column("hashes").to_pylist())]).tolist()
        return _packed({"block": t.column("block").to_pylist(), "bucket": [key[0].as_py()] * t.num_rows, "counts": [n[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]}, answer)

    def prefix(key, t, answers):
        h, n = shingles(t)
        known, which = np.unique(h, return_inverse=True)
        order, cuts = _cuts(known, buckets)
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        counts = np.empty(len(known), np.uint32)
        counts[order] = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(told[i], np.uint32) for i, _, _ in cuts)])
        counts, of = counts[which], np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, counts, of))
        h, counts, of = h[order], counts[order], of[order]
        before = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        first = (counts > 1) & (before <= n[of] + -(percent * n[of]) // 100)
        h, of, before = h[first], of[first], before[first]
        order, cuts = _cuts(h, buckets)
        h, of, before = h[order], of[order], before[order]
        rows = np.stack([np.asarray(t.column("rep"), np.int64)[of], np.asarray(t.column("label"), np.int64)[of], n[of], n[of] - before], 1)
        return _packed({"bucket": [i for i, _, _ in cuts], "hashes": [h[x:y].tobytes() for _, x, y in cuts], "rows": [rows[x:y].tobytes() for _, x, y in cuts]}, named)

    def meet(key, t):
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        rep, label, n, rest = np.frombuffer(b"".join(t.column("rows").to_pylist()), np.int64).reshape(-1, 4).T
        order = np.argsort(h, kind="stable")
        h, rep, label, n, rest = (x[order] for x in (h, rep, label, n, rest))
        left = -1
        while len(h) and len(h) != left:  # until no member goes
            left = len(h)
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([begin, [left]]))
            spread = lambda op, x: np.repeat(op.reduceat(x, begin), size)  # noqa: B023, E731
            # The least size of a partner: what is here, and what the similarity allows.
            other = np.maximum(spread(np.minimum, n), -(-percent * n // 100))
            stays = (spread(np.minimum, label) != spread(np.maximum, label)) & ((100 + percent) * rest >= percent * (n + other))
            h, rep, label, n, rest = (x[stays] for x in (h, rep, label, n, rest))
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        hub = np.repeat(np.minimum.reduceat(rep, begin), np.diff(np.concatenate([begin, [len(h)]]))) if len(h) else rep
        pairs = np.unique(np.stack([hub, rep], 1)[hub != rep], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], _LONG), "b": pa.array(pairs[:, 1], _LONG)})

    ddl = lambda types: ", ".join(f"{c} {'int' if t == _INT else 'binary'}" for c, t in types.items())
    ship(spark)
    answers = dealt.groupBy("block").applyInArrow(send, ddl(counted)).groupBy("bucket").applyInArrow(count, ddl(answer))
    prefixes = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(prefix, ddl(named))
    return prefixes.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _overlaps(mine: list[np.ndarray], others: list[np.ndarray]):
    """For each of mine, the sizes of its intersections with all others, by an inverted index."""
    h = np.concatenate(others)
    doc = np.repeat(np.arange(len(others)), [len(x) for x in others])
    order = np.argsort(h, kind="stable")
    doc = doc[order]
    keys, begin, count = np.unique(h[order], return_index=True, return_counts=True)
    for x in mine:
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        at = at[keys[at] == x]
        n = count[at]
        run = np.arange(n.sum()) + np.repeat(begin[at] - (np.cumsum(n) - n), n)
        yield np.bincount(doc[run], minlength=len(others))


def linked_across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different labels of members (cluster, rep, label, hashes), on full sets.

    A cluster is dealt into blocks of about BLOCK members; a task compares two blocks, and emits
    no more links than connect the labels that it finds linked: fewer than it has members."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    dealt = members.join(sizes.select("cluster", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "cluster")
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "label", "hashes")

    def run(key, t):
        b, rep, label = (np.asarray(t.column(c)) for c in ("b", "rep", "label"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(b == key[1].as_py()), np.flatnonzero(b == key[2].as_py())
        out, up = [], {x: x for x in label.tolist()}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        if len(left) and len(right) and len(up) > 1:
            for x, shared in zip(left, _overlaps([sets[i] for i in left], [sets[i] for i in right]), strict=True):
                near = right[(100 * shared >= percent * (n[x] + n[right] - shared)) & (label[right] != label[x])]
                for y in near:
                    one, two = top(int(label[x])), top(int(label[y]))
                    if one != two:
                        up[one] = two
                        out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes of edges (a, b): label is the smallest id that can be reached.

    Each round takes the least label of the neighbours, then the label's own label, until
    nothing changes; both shorten paths, so rounds grow with the logarithm of a path's length."""
    n = 2 * edges.count()
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "near-edges", n)
    labels = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "near-labels", n)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.select("id", "label").join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = stash(step.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), "near-labels", n)
        discard(labels)
        labels = new
        if new.where("old <> label").isEmpty():
            discard(both)
            return labels


def _labelled(rows: DataFrame, labels: DataFrame, of: str = "rep", name: str = "label") -> DataFrame:
    """rows with the label of a column of theirs; what has no link is its own."""
    return rows.join(labels.select(F.col("id").alias(of), F.col("label").alias("_label")), of, "left").withColumn(name, F.coalesce("_label", of)).drop("_label")


def _star(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs (a, b) of the rows (key, rep) with their key's hub."""
    low, high = F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")
    return rows.join(hubs, "key").where("rep <> hub").select(low, high).distinct()


def _hubs(rows: DataFrame, most: int, *order) -> DataFrame:
    """(key, hub) of at most so many rows (key, rep): the rep that is greatest in the order, then smallest."""
    best = rows.groupBy("key").agg(F.max(F.struct(*order, (-F.col("rep")).alias("r"))).alias("h"))
    return stash(best.select("key", (-F.col("h.r")).alias("hub")), "near-hubs", most)


def _open(rows: DataFrame) -> DataFrame:
    """Of rows (key, rep, label), those of keys with more than one label."""
    spread = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return rows.join(spread, "key", "left_semi")


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> list[DataFrame]:
    """Verified links (a, b) that connect whatever links connect, between classes (rep, n_shingles,
    registers): written tables."""

    def check(pairs: DataFrame) -> DataFrame:
        near = stash(promising(pairs, classes, percent), "near-pairs")
        out = verified(near, docs, k, percent)
        discard(near)
        return out

    bands = band_keys(classes)
    groups = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = stash(bands.join(groups, "key"), "near-bands")
    company = busy.groupBy("rep").agg(F.sum("n").alias("company"))
    most = busy.count()
    hubs = _hubs(busy.join(company, "rep"), most, "company")
    found = [check(_star(busy, hubs))]
    every = lambda: functools.reduce(DataFrame.unionByName, found)
    # What stars leave open: two members of a group, neither of them a hub, in different components.
    open_rows, before = busy, None
    while True:
        labels = components(every())
        spokes = open_rows.where("n > 2").join(hubs, "key").where("rep <> hub").select("key", "rep", "n", "hub")
        # Written first, so that a key's rows aren't bound to one task by the count of its labels.
        spokes = stash(_labelled(spokes, labels), "near-spokes", most)
        rows = stash(_open(spokes), "near-open", most)
        discard(spokes, hubs, open_rows)
        open_rows, n = rows, rows.count()
        if not n or before is not None and 2 * n > before:
            discard(labels)
            break
        # Another star in each, around a member that the last hub's component lacks.
        before, beside = n, _labelled(rows.select("key", "rep", "label", "hub"), labels, "hub", "held")
        hubs = _hubs(beside.withColumn("apart", F.col("label") != F.col("held")), n, "apart")
        open_rows = stash(rows.select("key", "rep", "n"), "near-open", n)
        discard(rows, labels)
        found.append(check(_star(open_rows, hubs)))
    if n:
        reps = stash(open_rows.select("rep", "label").distinct(), "near-open-reps", n)
        members = hashed_sets(reps, docs, k)
        stars = stash(prefix_stars(members, percent), "near-stars")
        if not stars.isEmpty():
            labels = components(stars)
            clusters = labels.select(F.col("id").alias("rep"), F.col("label").alias("cluster"))
            found.append(stash(linked_across(members.join(clusters, "rep"), percent), "near-links"))
            discard(labels)
        discard(reps, members, stars)
    discard(open_rows)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, n_shingles, component_id, kept)."""
    docs = only(docs, doc_id="doc_id", text="text")
    sketches = stash(sketch(docs, k), "near-sketches")
    sets = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = stash(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-classes")
    own = (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("_d"))
    classes = sets.join(reps.select(F.col("digest").alias("_d"), "rep"), own).select("rep", "n_shingles", "registers").dropDuplicates(["rep", "registers"])
    classes = stash(classes, "near-registers")
    found = links(docs, classes, k, percent)
    labels = components(functools.reduce(DataFrame.unionByName, found))
    discard(classes, *found)
    member = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    out = sketches.join(member, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
