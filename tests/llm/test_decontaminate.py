"""Leaks against a plain comparison of every window with every item."""

import random
from collections import Counter

from pyspark.sql import functions as F

from waymerge.llm.decontaminate import decontaminate, keep_clean, simhash


def sh(words, size):
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(text, items, percent=80):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).split()
    out = set()
    for item, t in items:
        v = (t or "").lower().split()
        if not v:
            continue
        size, m = min(5, len(v)), len(v)
        b = sh(v, size)
        for s in range(-m + 1, len(w)):
            a = sh(w[max(0, s):s + m], size)
            if a & b and 100 * sum((a & b).values()) >= percent * sum((a | b).values()):
                out.add(item)
    return out


def corpus():
    rng = random.Random(3)
    v = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([8, 20, 35])))) for i in range(12)] + [(20, "only three words"), (21, ""), (22, None)]
    docs = []
    for i in range(120):
        w = rng.choices(v, k=rng.choice([0, 3, 30, 200]))
        if i % 2:
            leak = rng.choice(items[:13])[1].upper().split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = rng.choice(v)
            cut = rng.choice([0, 0, 1, 3])
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak[cut:]
        docs.append((None if i == 7 else i // 2, rng.choice([" ", "\n", "\t "]).join(w)))
    return docs + [(900, None), (901, ""), (902, docs[1][1])], items


def test_equals_all_windows(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id bigint, text string, item_id int, h int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.contaminated, r.n_items) for r in decontaminate(frame, bench).collect())
    want = sorted(((-1 if d is None else d), bool(x), len(x)) for d, t in docs for x in [brute(t, items)])
    assert got == want and sum(x[1] for x in want) > 20
    clean = keep_clean(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not x[1] for x in want)
    assert decontaminate(frame.limit(0), bench).count() == 0
    assert decontaminate(frame, bench.limit(0)).where("contaminated").count() == 0


def test_passages_in_another_order(spark):
    items = [(i, " ".join(f"{'abc'[i]}{k}" for k in range(m))) for i, m in enumerate((59, 100, 45))]
    docs = []
    for lead in ([], [f"y{k}" for k in range(70)]):
        for _, text in items:
            w = text.split()
            docs.append((len(docs), " ".join(lead + w[len(w) // 2:] + w[:len(w) // 2] + [f"z{k}" for k in range(30)])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.contaminated, r.n_items) for r in decontaminate(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    want = sorted((d, bool(x), len(x)) for d, t in docs for x in [brute(t, items)])
    assert got == want and all(x[1] for x in want)


def test_simhash(spark):
    """Few and many features, with repeats, against a count of each bit."""
    rng = random.Random(6)
    lists = [[], [5], [-1, -1, 0]] + [[rng.randrange(-2**63, 2**63) for _ in range(n)] for n in (2, 7, 56, 127, 128, 700, 32_767, 32_768)] + [[rng.randrange(-2**63, 2**63)] * 127, [-1] * 127, [-1] * 32_767]
    got = [r.h for r in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>").coalesce(1).select("i", simhash(F.col("x")).alias("h")).orderBy("i").collect()]
    want = []
    for xs in lists:
        bits = sum((2 * sum(x >> b & 1 for x in xs) > len(xs)) << b for b in range(64))
        want.append(bits - (1 << 64) if bits >> 63 else bits)
    assert got == want


def test_long_text_with_many_windows(spark):
    """A text of many regions, in which one item repeats."""
    items = [(1, " ".join(f"k{i}" for i in range(30))), (2, "aa bb cc dd ee ff gg hh")]
    words = [f"n{i % 977}" for i in range(30_000)]
    for at in (0, 4_090, 12_000, 29_990):
        words[at:at + 30] = items[0][1].split()
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:40])), (3, " ".join(words[4_000:4_085]))], "doc_id bigint, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_id) for r in decontaminate(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {1: (True, 1, 1), 2: (True, 1, 1), 3: (False, 0, None)}
