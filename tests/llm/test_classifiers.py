"""Held-out accuracy of the two classifiers, and edge cases."""

import os
import random
import zlib

import numpy as np
import pytest
import zstandard

from waymerge.llm import langid, toxicity

SF = "/root/testdata/sf0.01"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@needs
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {d for d, r in got.items() if r.held_out}
    right = [got[r.doc_id].lang_pred == r.lang for r in held if r.lang]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    docs = spark.createDataFrame([(None, "the words of the text", "en"), (2, None, "en"), (3, "12 -- 3", "fr"), (4, "", None), *[(i, "der und die", "de") for i in (5, 5, 7, 8, 9)], (6, "the of " * 400_000, "en")],
                                 "doc_id bigint, text string, lang string").selectExpr("*", "1 score", "2 h")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (5, "de"), (6, "en")} <= got
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def plain_language(rows, pieces=800, length=250, margin=0.01):
    """A second version of learning and prediction over (doc_id, text, lang), for so few rows that all are sampled."""
    taught = {}
    for text, lang in {(t, g) for d, t, g in rows if g and t and any(c.isalpha() for c in t) and (d is None or zlib.crc32(str(d).encode()) % 4 != 2)}:
        letters = langid.letters_only(text)
        cut = sorted({letters[i:i + length] for i in range(0, len(letters), length)} - {" "}, key=langid.piece_hash)
        for n, piece in enumerate(cut):
            seen = taught.setdefault(lang, {})
            seen[piece] = min(seen.get(piece, n), n)
    contents = {}
    for lang, seen in taught.items():
        best = sorted(seen, key=lambda p: (seen[p], langid.piece_hash(p), p))[:pieces]
        contents[lang] = zstandard.ZstdCompressionDict("\n".join(best).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    out = []
    for d, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            out.append((d, "und", 0.0))
            continue
        size = {g: len(zstandard.ZstdCompressor(level=9, dict_data=c, write_content_size=False, write_dict_id=False).compress(langid.letters_only(text).encode()))
                for g, c in contents.items()}
        best, *rest = sorted(size, key=lambda g: (size[g], g))
        out.append((d, best, min(1.0, 10 * (1 - size[best] / size[rest[0]])) if rest else 1.0))
    return out


def language_rows():
    rng = random.Random(6)
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "de la le et les des en un du une".split()}
    header = "notice 2024 terms apply all rights reserved " * 40  # 1,760 characters that open every text
    rows = [(i, header + " ".join(rng.choices(words[g], k=rng.randrange(40, 120))), g) for i, g in enumerate(rng.choices(list(words), k=60))]
    return [*rows, (60, "der und " * 20_000, "de"), rows[0], (None, "le et les des", "fr"), (61, None, "en"), (62, "7 -- 8", "en"), (63, "", None)]


def test_language_against_second_version(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for pieces in (5, 800):
        got = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, pieces=pieces).collect()]
        want = [(d, g, round(s, 9)) for d, g, s in plain_language(rows, pieces)]
        assert sorted(got, key=str) == sorted(want, key=str)
    right = [g == lang for (_, g, _), (_, t, lang) in zip(plain_language(rows), rows) if lang and g != "und"]
    assert np.mean(right) == 1.0  # the shared beginning does not hide what follows it


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id bigint, text string, lang string")
    learned = langid.learn(docs, per_language=3, pieces=12, length=200)
    assert set(learned) == {"en", "de", "fr"} and all(len(c.decode().split("\n")) <= 12 for c in learned.values())
    header = langid.letters_only("notice 2024 terms apply all rights reserved " * 40)
    # the beginning that all texts share has 8 different pieces at most, so the others are left to what follows it
    assert all(any(p.strip() not in header for p in c.decode().split("\n")) for c in learned.values())


@needs
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled_documents(docs, labels.where("doc_id % 4 != 0")))
    assert np.all(np.diff(model.thresholds) >= 0)
    held = toxicity.score(toxicity.labelled_documents(docs, labels.where("doc_id % 4 = 0")), model).collect()
    toxic = np.array([r.grade > 0 for r in held])
    called = np.array([r["__toxic"] for r in held])
    # about a tenth of the toxic labels are on texts without any telling word
    assert called[toxic].mean() > 0.8 and called[~toxic].mean() < 0.01
    assert all(0 <= r["__severity"] <= 2 for r in held)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "bad bad", "b"), (2, "", "c"), (2, "", "c"), (3, "fine", "d")], "doc_id bigint, text string, severity string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.severities(docs, labels).collect()
    assert len(got) == 5 and not any(r.toxic for r in got)
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert toxicity.severities(docs.limit(0), labels.limit(0)).count() == 0
