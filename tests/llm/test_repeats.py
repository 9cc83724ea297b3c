"""Removed bytes against a count of every 200-byte string."""

import hashlib
import random
from collections import Counter

import numpy as np

from waymerge.llm import repeats
from waymerge.llm.repeats import LENGTH, remove_repeats


def brute(texts):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i:i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - LENGTH + 1):
            if counts[d[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = True
        gone[len(d)] = False
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone[:len(d)]])).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdé fgh\n", k=n))
    passages = [text(n) for n in (150, 199, 200, 201, 260, 500, 1500)]
    out = [None, "", "x" * 199, "ab" * 150, "z" * 1000]
    for i in range(60):
        parts = [text(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 120)
            parts += [p[cut:] if rng.random() < .5 else p, text(rng.randrange(0, 250))]
        out.append("".join(parts))
    base = text(2500)
    for i in range(25):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("XYZ")
        out.append("".join(w))
    return out + [out[9], out[9]]


def test_equals_counting(spark):
    texts = corpus()
    docs = spark.createDataFrame([(None if i == 3 else i, t, 1, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, n_spans int, spans string")
    got = sorted((3 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect())
    assert got == [(i, *x) for i, x in enumerate(brute(texts))]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_long_rows_are_cut_evenly(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 9_000, dtype=np.uint8)
    offsets = np.array([0, 4_000, 4_100, 9_000])
    whole = set(zip(*(x.tolist() for x in repeats.runs(data, offsets)[:2])))
    monkeypatch.setattr(repeats, "PART", 700)
    assert set(zip(*(x.tolist() for x in repeats.runs(data, offsets)[:2]))) == whole
