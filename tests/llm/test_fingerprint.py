"""Edited texts and choices of k-mers against plain versions."""

import hashlib
import random

from pyspark.sql import functions as F

from waymerge.llm.fingerprint import K, LONGEST, SHORT, WORD, compare_edited, fingerprints, successors, words


def corpus():
    rng = random.Random(5)
    v = [f"w{i}é" for i in range(200)]
    docs = [(rng.randrange(10**12), " ".join(rng.choices(v, k=rng.choice([0, 1, 5, 9, 60, 400])))) for _ in range(60)]
    return docs + [(-5, None), (0, "漢字かな混じり文の例です" * 3), (1, docs[0][1]), (2, "\U0001f600" * 7), (3, " \n")]


def test_edited_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, id int, anchors int")
    got = {r.doc_id: r for r in compare_edited(docs).collect()}
    order = sorted(d for d, _ in rows)
    texts = {d: t or "" for d, t in rows}
    assert len(got) == len(rows)
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        if t == nxt:
            assert r.near_next == 1
        if len(t.split()) == 400 and len(nxt.split()) == 400:
            assert 0.2 < r.near_edited < 0.5 and r.near_next < 0.05
    assert got[1].fingerprint == got[rows[0][0]].fingerprint
    assert compare_edited(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c d e f"), (4, "x y z w"), (4, "x y z w"), (9, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_chars) for r in compare_edited(docs).collect())
    assert got == [(0, 3), (0, 7), (4, 7), (4, 7), (9, 0)]


def test_context_free(spark):
    rng = random.Random(6)
    body = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [("a", " ".join(body)), ("b", "some other start " + " ".join(body[20:150]) + " and end"), ("c", "short text")]
    got = {r.k: [(x.at, x.h) for x in r.anchors] for r in fingerprints(spark.createDataFrame(rows, "k string, text string")).collect()}
    inside = {(p - 20 + 3, h) for p, h in got["a"] if 20 <= p <= 150 - K}
    assert inside and inside <= set(got["b"])
    assert abs(len(got["a"]) / (200 - K + 1) - 2 / 7) < 0.12 and len(got["c"]) == 1


def test_successors(spark):
    ids = spark.range(0, 70_000).select((F.col("id") * 7).alias("id"))
    got = successors(ids)
    assert got.where("next != id + 7").collect()[0].asDict() == {"id": 69_999 * 7, "next": 0} and got.count() == 70_000


def test_a_shared_half_leaves_a_likeness(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda least, most: "".join(rng.choices(letters, k=rng.randint(least, most)))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(540))
    texts = [thai, word(500, 500), word(40, 40), word(5000, 5000), " ".join(word(1, 3) for _ in range(20)), " ".join(word(200, 300) for _ in range(9)), "x" * SHORT + " end", word(60, 60) + "\n" + "y z " * 50]
    docs = spark.createDataFrame([(i, t) for n, t in enumerate(texts) for i, t in ((2 * n, t), (2 * n + 1, f"{word(30, 40)} " * 300))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in compare_edited(docs).collect()}
    assert all(got[2 * n].near_edited > 0 for n in range(len(texts)))
    assert LONGEST * 13 + 13 + LONGEST <= SHORT // 2


def test_chosen_words_by_hand(spark):
    """The choice depends on order of hashes only: a plain version over the same token hashes chooses the same places."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 7, 8, 9, 30, 200])))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string")
    tokens = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    pairs = df.select("id", F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1))).alias("s")).collect()
    s_of = {r.id: r.s for r in pairs}
    for r in fingerprints(df).collect():
        n, s = len(r.text.split()), s_of[r.id]
        plain = [i for i in range(n - K + 1) if min(s[i:i + K - 1]) in (s[i], s[i + K - 2])]
        assert [a.at for a in r.anchors] == (plain or [0])


def test_words_equal_the_pattern(spark):
    rng = random.Random(10)
    alphabet = ["a", "é", "\U0001f600", " ", "\u00a0", "\u3000", "\n", "\x0b", "\u2003", "ก", "漢", "x" * 17, "é" * 9]
    rows = [("",), (" ",)] + [("".join(rng.choices(alphabet, rng.choices([9, 1], k=1) * 6 + [3] * 7, k=rng.randrange(40))),) for _ in range(300)]
    matched = F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    assert spark.createDataFrame(rows, "text string").where(words(F.col("text")) != matched).count() == 0
