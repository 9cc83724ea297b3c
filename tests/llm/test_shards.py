"""Exact sizes, the law of the matrix, and a uniform shuffle against exact chances."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from waymerge.llm import shards as S


def test_matrix_sums():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 400, 37)
    before = np.concatenate([[0], np.cumsum(sizes)])
    _, _, capacity = S.cells(int(sizes.sum()), 9)
    rows = np.array([S.matrix_row(i, before, capacity, 5) for i in range(len(sizes))])
    assert (rows >= 0).all() and (rows.sum(axis=1) == sizes).all() and (rows.sum(axis=0) == capacity).all()


def test_matrix_law():
    """Three blocks, two columns: every matrix as often as the count of arrangements that give it says."""
    before, capacity, n = np.array([0, 2, 5, 7]), np.array([4, 3]), 20_000
    seen = Counter(tuple(int(S.matrix_row(b, before, capacity, seed)[0]) for b in range(3)) for seed in range(n))
    sizes = np.diff(before).tolist()
    weight = {k: math.prod(math.comb(s, x) for s, x in zip(sizes, k)) for k in itertools.product(*(range(s + 1) for s in sizes)) if sum(k) == 4}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    chi = sum((seen[k] - n * w / total) ** 2 / (n * w / total) for k, w in weight.items())
    assert chi < 3 * len(weight)


def test_large_populations(monkeypatch):
    rng = np.random.default_rng(3)
    good, bad, drawn = 4 * 10**9, 6 * 10**9, 10**9
    draws = np.array([S.hypergeometric(rng, good, bad, drawn) for _ in range(3000)], float)
    mean = drawn * good / (good + bad)
    sd = math.sqrt(mean * bad / (good + bad) * (good + bad - drawn) / (good + bad - 1))
    assert abs(draws.mean() - mean) < 5 * sd / math.sqrt(3000) and abs(draws.std() / sd - 1) < 0.08
    parts = S.split(rng, np.array([10**9, 3, 5 * 10**9]), 10**8)
    assert parts.sum() == 10**8 and (parts >= 0).all()
    # the sampler for large ones against exact chances on a small population
    monkeypatch.setattr(S, "LARGE", 0)
    seen = Counter(S.hypergeometric(rng, 7, 5, 6) for _ in range(20_000))
    exact = {k: math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6) for k in range(1, 7)}
    assert set(seen) <= set(exact)
    assert sum((seen[k] - 20_000 * p) ** 2 / (20_000 * p) for k, p in exact.items()) < 22


def test_uniform(spark):
    """Where a row lands does not depend on its block: places of each row over many seeds."""
    docs = spark.range(12, numPartitions=3).withColumnRenamed("id", "doc_id")
    runs, shards = 30, 4
    seen = Counter()
    for seed in range(runs):
        got = [(r.doc_id, r.shard, r.slot) for r in S.shuffle_into_shards(docs, shards, seed * 1000).collect()]
        assert sorted((s, t) for _, s, t in got) == [(s, t) for s in range(4) for t in range(3)]
        seen.update((d, s * 3 + t) for d, s, t in got)
    expected = runs / 12
    chi = sum((seen[d, p] - expected) ** 2 / expected for d in range(12) for p in range(12))
    assert chi < 121 + 6 * math.sqrt(2 * 121)


@pytest.mark.parametrize("cell", [S.CELL, 3])
def test_digest(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL", cell)
    texts = [None, "", "é€", "x" * 300_000, *["copy"] * 60, *[f"t{i}" for i in range(39)]]
    rows = [(None if i == 5 else i, t, "s", 3, 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, law string, Shard int, slot int").repartition(5)
    got = S.digest(docs).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
    assert sorted(places) == list(range(40)) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert {len(v) for v in places.values()} <= {2, 3}
    again = S.digest(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_few_rows_and_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "keep"), (2, None, "too")], "doc_id bigint, text string, cell string")
    got = S.shuffle_into_shards(docs, 5).collect()
    assert sorted((r.doc_id, r.text, r.cell) for r in got) == [(1, "a", "keep"), (2, None, "too")]
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0)]
    assert S.shuffle_into_shards(docs.limit(0), 5).count() == 0
    S.write_shards(spark.range(100), str(tmp_path / "out"), 3, rows_a_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [33, 33, 34]
