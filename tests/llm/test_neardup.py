import math
import random

import numpy as np
import pyarrow as pa

from larkspur.llm import neardup
from tests.llm.helpers import DOCS, WORDS, by_id, clashing, documents


def sets(texts, k):
    out = []
    for t in texts:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(ids, texts, k, percent):
    s, parent = sets(texts, k), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(s):
        for j in range(i):
            both = len(a & s[j])
            if both and 100 * both >= percent * len(a | s[j]):
                x, y = find(ids[i]), find(ids[j])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[n]), find(i)) for n, i in enumerate(ids)}


def compare(spark, rows, k, percent):
    got = by_id(neardup.near_duplicates(clashing(documents(spark, rows).repartition(3)), k, percent))
    want = brute([i for i, _ in rows], [t for _, t in rows], k, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [[word() for _ in range(rnd.choice([1, 2, 3, 8, 40, 120]))] for _ in range(40)]
    for base in texts[:12]:
        for _ in range(6):
            t = base[:]
            for _ in range(rnd.randrange(1, 8)):
                t[rnd.randrange(len(t))] = word()
            texts.append(t)
    # A cluster whose copies are like the original, but not like each other; and a chain.
    base = [word() for _ in range(150)]
    texts += [[word() if rnd.random() < e else w for w in base] for e in (0, *[0.02] * 25, *[0.06] * 25)]
    link = [word() for _ in range(200)]
    for _ in range(8):
        link = link[3:] + [word() for _ in range(3)]
        texts.append(link)
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(i * 5, " ".join(texts[o])) for i, o in enumerate(order)]
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, rows[0][1].upper()), (9005, rows[0][1]), (9006, "One"), (9007, "one"), (9008, "one two"), (9009, "Two one")]


def test_against_brute_force(spark):
    compare(spark, corpus(1), 3, 85)
    compare(spark, corpus(2), 5, 80)


def families(seed, n_families=9, each=14):
    """Families of near copies whose heads are all alike, but too little to be linked."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    changed = lambda words, n: [word() if i in at else w for at in [rnd.sample(range(len(words)), n)] for i, w in enumerate(words)]
    base = [word() for _ in range(150)]
    texts = [base] + [changed(head, rnd.randrange(3)) for head in (changed(base, 5) for _ in range(n_families)) for _ in range(each)]
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_groups_whose_hub_is_unlike_the_others(spark):
    rows = families(4)
    compare(spark, rows, 3, 85)
    compare(spark, rows, 5, 80)


def test_prefix_stars_lose_no_link(spark):
    for seed, percent in ((5, 85), (6, 80)):
        rows = families(seed, 5, 8) + [(1000 + i, t) for i, t in corpus(seed) if t and i < 9000]
        h, first = neardup.shingle_sets(pa.array([t for _, t in rows]), 3)
        sets = [frozenset(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
        members = [(i, i % 50 if i % 3 else i, h[a:b].tobytes()) for (i, _), a, b in zip(rows, first[:-1], first[1:], strict=True)]
        stars = neardup.prefix_stars(spark.createDataFrame(members, "rep long, label long, hashes binary"), percent).collect()
        group = {i: i for i, _ in rows}
        for a, b in stars:
            one, two = group[a], group[b]
            group = {i: two if g == one else g for i, g in group.items()}
        for x, (i, label, _) in enumerate(members):
            for y, (j, other, _) in enumerate(members[:x]):
                both = len(sets[x] & sets[y])
                if label != other and both and 100 * both >= percent * len(sets[x] | sets[y]):
                    assert group[i] == group[j], (i, j)
        assert len({*group.values()}) > 20  # and keeps most others apart


def test_blocks_give_no_more_links_than_members(spark):
    h = np.arange(100, dtype=np.uint64)
    members = [(0, i, i, (h + np.uint64(i % 3)).tobytes()) for i in range(60)]
    got = neardup.linked_across(spark.createDataFrame(members, "cluster long, rep long, label long, hashes binary"), 90).collect()
    assert len(got) == 59 and {x for r in got for x in r} == {*range(60)}


def test_nulls_ties_and_no_rows(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, t, "", "", 0), (1, t, "", "", 0), (2, t, "", "", 0), (None, t, "", "", 0), (3, None, "", "", 0)], DOCS)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_very_long_texts(spark):
    long = " ".join(str(i) for i in range(120_000))
    compare(spark, [(1, long + " end"), (2, long), (3, "y" * 2_000_000), (4, "no")], 3, 85)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rnd.randrange(200, 230), rnd.randrange(200, 230)) for _ in range(25)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**64, 3000, np.uint64), rnd.integers(0, 2**64, 3000, np.uint64)
    pool = np.concatenate([a, b])
    s = lambda *x: neardup.sketch_sets(np.concatenate(x), np.array([0, sum(map(len, x))]))
    assert (neardup.merge(s(a), s(b)) == s(pool)).all()
    for j in (0.0, 0.3, 0.6, 0.85, 0.95, 1.0):
        n = round(2000 * 2 * j / (1 + j))
        x, y = np.concatenate([a[:n], a[n:2000]]), np.concatenate([a[:n], b[: 2000 - n]])
        got = neardup.jaccard(s(x), s(y), np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - j) < 0.13, (j, got)
    assert neardup.jaccard(s(a[:100]), s(a), np.array([100.0]), np.array([3000.0]))[0] < 0.05


def test_shingle_sets():
    h, first = neardup.shingle_sets(pa.array(["a b c a b c", "A b", "a B", None, "a b c"]), 3)
    got = [h[x:y].tolist() for x, y in zip(first[:-1], first[1:], strict=True)]
    assert [len(x) for x in got] == [3, 1, 1, 0, 1] and got[1] == got[2] and got[4][0] in got[0]


def test_estimates_far_below_the_threshold_are_verified(spark):
    def registers(equal):
        r = np.full(neardup.REGISTERS, 1000, np.uint16)
        r[equal:] += np.where(np.arange(neardup.REGISTERS - equal) % 2, 50, -50).astype(np.int16).view(np.uint16)
        return r.tobytes()

    rows = [(0, 1000, bytearray(registers(neardup.REGISTERS)))] + [(n, 1000, bytearray(registers(n))) for n in (90, 106, 110, 150)]
    classes = spark.createDataFrame(rows, "rep long, n_shingles long, registers binary")
    pairs = spark.createDataFrame([(0, n) for n, *_ in rows[1:]], "a long, b long")
    assert sorted(r.b for r in neardup.promising(pairs, classes, 85).collect()) == [106, 110, 150]
    for t in (0.8, 0.85):  # the chance of a miss is below that of the bands
        n, least = neardup.REGISTERS, t - neardup.SIGMAS * math.sqrt(t * (1 - t) / neardup.REGISTERS)
        missed = sum(math.comb(n, x) * t**x * (1 - t) ** (n - x) for x in range(n + 1) if x / n < least)
        assert missed < 0.1 * (1 - t**neardup.ROWS) ** neardup.BANDS
