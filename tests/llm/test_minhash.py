"""Sketches against Jaccard similarity, components against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from waymerge.llm import minhash
from waymerge.llm.common import random64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def test_sketch():
    rng = np.random.default_rng(0)
    for size, share in ((3, 1), (40, 20), (2000, 1000), (2000, 1800)):
        base = random64(2 * size, size)
        a, b = base[:size], base[size - share: 2 * size - share]
        x, y = minhash.sketch(np.concatenate([a, b]), np.repeat([0, 1], size), 2)
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((x == y).mean() - share / (2 * size - share)) < 0.12
    assert (minhash.sketch(a[rng.permutation(size)], np.zeros(size, int), 1)[0] == x).all()


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choices(vocabulary, k=rng.choice([3, 6, 30, 120])) for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((1000 - 7 * i, rng.choice([" ", "\n", "\x0b "]).join(x.upper() if rng.random() < .1 else x for x in w)))
    # one large cloud of copies around the limit
    hub = rng.choices(vocabulary, k=150)
    for i in range(90):
        w = list(hub)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{i}"
        out.append((5000 + i, " ".join(w)))
    return out + [(1, ""), (2, None), (3, " \n"), (4, "É é"), (5, "é é")]


@pytest.mark.parametrize("percent", [85, 80])
def test_equals_all_pairs(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id bigint, text string, kept string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent).collect())
    assert got == brute(rows, percent)


def cloud(percent, pairs=1000):
    """Texts around one hub in pairs just above the limit; texts of different pairs are below it."""
    rng = random.Random(percent)
    hub = [f"h{i}" for i in range(420)]
    # texts of n shingles, x of them own after edits that each touch five: (n - x) / (n + x) >= limit for a pair
    n = len(hub) - 4
    own = int(n * (100 - percent) / (100 + percent) / 5)
    out = []
    for p in range(pairs):
        at = rng.sample(range(2, n // 5), 8 + own)
        base = list(hub)
        for k in at[own:]:
            base[5 * k] = f"p{p}_{k}"
        twin = list(base)
        for k in at[:own]:
            twin[5 * k] = f"t{p}_{k}"
        out += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(twin))]
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_pairs_of_a_large_cloud_meet(percent):
    texts = [t for _, t in cloud(percent)]
    hashes, owners, sizes, _ = minhash._sets(pa.array(texts))
    codes = (minhash.mix(minhash.sketch(hashes, owners, len(texts))) >> np.uint64(48)).reshape(-1, 2, minhash.T)
    equal = codes[:, 0] == codes[:, 1]
    met = equal[:, minhash.DEEP[:, :minhash._deep_rows(percent)]].all(axis=2).any(axis=1)
    sets = [shingles(t) for t in texts]
    assert all(100 * len(a & b) >= percent * len(a | b) for a, b in zip(sets[::2], sets[1::2])) and met.all()


@pytest.mark.parametrize("percent", [85, 80])
def test_longer_bands_miss_no_more(percent):
    rng = np.random.default_rng(7)
    equal = rng.random((20_000, minhash.T)) < percent / 100
    met = np.zeros(len(equal), bool)
    for band in minhash.DEEP[:, :minhash._deep_rows(percent)]:
        met |= equal[:, band].all(axis=1)
    assert met.all()


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B C D E F"), (3, "z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 7, False), (3, 3, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 5


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (102, 103)]
    got = dict(minhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


@pytest.mark.parametrize("kind", ["none", "path", "star", "random", "loops"])
def test_components_of_shapes(spark, kind):
    rng = random.Random(5)
    links = {
        "none": [], "path": [(i, i + 1) for i in range(40)], "star": [(900, i) for i in range(30)] + [(i, 901) for i in range(40, 50)],
        "random": [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)], "loops": [(1, 2), (2, 1), (1, 2), (3, 3), (2, 7)],
    }[kind]
    links = [(a, b) for a, b in links if a != b or kind == "loops"]
    group = {x: {x} for pair in links if pair[0] != pair[1] for x in pair}
    for a, b in links:
        if a != b and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    got = minhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, min(g)) for x, g in group.items())
