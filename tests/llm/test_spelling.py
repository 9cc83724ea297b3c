"""Near words, forms and roots against all pairs; counts against a plain tokenizer; the filters against their promise."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymerge.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def lower(run):
    return re.sub("[A-Z]", lambda m: m[0].lower(), run)


def counted(rows, divisor=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % divisor == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 6:
                counts[word] += 1
    return counts


def grouped(counts):
    """The result's rows by comparing all pairs."""
    out, form = [], {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        best = min(others, default=None)
        if best and -best[0] >= 5 * n:
            form[w] = best[1]
        out.append((w, form.get(w), n, len(others), -best[0] if w in form else None))
    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, f, root(w), n, k, m) for w, f, n, k, m in out)


def corpus():
    rng = random.Random(8)
    base = ["summer", "winter", "Résumé", "ÀÉÎÔÛÿ", "straße×÷", "aaaaaaa", "aaaaaa", "bananas", "misspell", "x" * 5000]
    words = list(base)
    for w in base[:9]:
        for _ in range(14):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abeéñ") + w[i:], w[:i] + rng.choice("abeéñ") + w[i + 1:]]))
    words += [w[:3] + "q" + w[3:] for w in words[20:60]] + ["x" * 4999 + "y", "x" * 4999]
    texts = [None, "", "...", "a b c", "short Ābcdefg end"]
    for k, w in enumerate(words):
        texts += [f"{w}, {w.upper() if k % 3 else w}-{w}\n{w} {w}"] * ([1, 1, 5, 26, 130][k % 5] if len(w) < 100 else 1)
    texts += ["summer winter " * 90_000]
    return [(None if i == 7 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("held, most_bytes", [(S.HELD, 256 << 20), (2_000, 64)])
def test_equals_all_pairs(spark, monkeypatch, held, most_bytes):
    """Also with counts that leave at once and filters so small that nearly every edit passes."""
    monkeypatch.setattr(S, "HELD", held)
    rows = corpus()
    if most_bytes == 64:
        rows = [(d, t) for d, t in rows if len(t or "") < 4000]
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id bigint, text string, word string, n int").repartition(6)
    got = sorted(map(tuple, S.spelling_variants(docs, most_bytes=most_bytes).collect()))
    want = grouped({w: n for w, n in counted(rows).items() if n >= 5})
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] not in (None, r[2]) for r in want)
    assert S.spelling_variants(docs.limit(0)).count() == 0


def test_chains(spark):
    """Forms over many steps."""
    words = ["a" * k for k in range(6, 16)]
    rows = [(w, 5 ** i) for i, w in enumerate(words)]
    got = sorted(map(tuple, S.variants(spark.createDataFrame(rows, "word string, n bigint")).collect()))
    assert got == grouped(dict(rows)) and {r[2] for r in got} == {words[-1]}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé", min_size=6, max_size=8), min_size=1, max_size=25))
def test_edits_find_each_pair_once(words):
    words = sorted(words)
    filters = S.Filters(Counter(map(len, words)), 1 << 20)
    for length, own in S.by_length(words, S.GRID):
        hashes = (S.letters([words[i] for i in own], length) * S.powers(length)).sum(axis=1, dtype=np.uint64)
        lane, mask = filters.places(hashes, length)
        np.bitwise_or.at(filters.data, lane, mask)
        assert filters.pass_(hashes, length).all()
    known = set(words)
    found = Counter(frozenset((words[i], other)) for i, other in S.edits(words, filters) if other in known)
    assert found == Counter(frozenset((a, b)) for a in words for b in words if a < b and near(a, b))


def test_filters_pass_few(spark):
    rng = np.random.default_rng(4)
    words = list({"".join(chr(c) for c in rng.choice(S.ALPHABET[:26].astype(int), 9)) for _ in range(20_000)})
    filters = S.Filters({9: len(words)}, 1 << 20)
    own = (S.letters(words, 9) * S.powers(9)).sum(axis=1, dtype=np.uint64)
    np.bitwise_or.at(filters.data, *filters.places(own, 9))
    assert filters.pass_(rng.integers(0, 1 << 63, 200_000).astype(np.uint64), 9).mean() < 0.004
