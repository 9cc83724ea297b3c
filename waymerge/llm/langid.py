"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

LETTER = r"\p{L}"
OTHER = re.compile(r"[\W\d_]+")
BLOCK = 1 << 20  # characters of a text compressed at once
PIECE = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("h", pa.int64()), ("piece", pa.string())])


def letters_only(text: str) -> str:
    """Case-folded letters (and their marks), everything between them as one space: case, digits and signs tell no language."""
    return OTHER.sub(" ", text.lower())


def pieces_of(text: str, length: int, most: int) -> list[str]:
    """The different pieces of ``length`` letters of the whole text, the ``most`` of least hash in the order of their hashes."""
    found = set()
    for i in range(0, len(text), BLOCK):
        letters = letters_only(text[i:i + BLOCK])
        found.update(letters[j:j + length] for j in range(0, len(letters), length))
    found.discard(" ")
    return heapq.nsmallest(most, found, key=lambda p: (piece_hash(p), p))


def piece_hash(piece: str) -> int:
    return int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "big", signed=True)


def learn(labelled: DataFrame, per_language: int = 200, pieces: int = 800, length: int = 250) -> dict[str, bytes]:
    """Raw dictionary content per language from labelled (doc_id, text, lang) rows.

    A bounded sample: per language the ``per_language`` different rows with letters that come first by hash of doc_id and text. Their whole texts are
    cut into pieces of ``length`` letters; pieces that repeat, in one text or several of a language, count once. A language's dictionary has
    ``pieces`` pieces at most: each text's first by hash, then each text's second, and so on, so one long text does not fill it, and a beginning
    that many texts share takes as many places as it has pieces. Rows with a null lang or without letters teach nothing. No rows: no languages.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(LETTER)).withColumn("h", F.xxhash64("doc_id", "text"))
    # Spark limits each map task to per_language rows of a language before the shuffle; only hashes move
    first = Window.partitionBy("lang").orderBy("h")
    chosen = usable.select("lang", "h").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= per_language).select("lang", "h").distinct()
    texts = usable.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(lang, n, piece_hash(p), p) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
                    for n, p in enumerate(pieces_of(text, length, pieces))]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "n", "h", "piece"), r)) for r in rows], PIECE)

    every = texts.mapInArrow(run, "lang string, n int, h bigint, piece string").groupBy("lang", "piece").agg(F.min("n").alias("n"), F.first("h").alias("h"))
    kept = every.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("n", "h", "piece"))).where(F.col("at") <= pieces)
    found: dict[str, list[tuple]] = {}
    for r in kept.select("lang", "at", "piece").collect():
        found.setdefault(r.lang, []).append((r["at"], r.piece))
    return {lang: "\n".join(p for _, p in sorted(xs)).encode() for lang, xs in sorted(found.items())}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, level: int = 9) -> DataFrame:
    """Per row: doc_id, lang_pred, score, rejected.

    The text's letters are encoded once per language with that language's dictionary; the smallest encoding wins (ties: first lang by
    name). score = 1 - smallest / next smallest size, scaled so that a tenth of the size saved, or more, is 1; with one language it is 1.
    ``rejected``: the relative saving is below ``margin``, so the guess is weak. Null texts, texts without letters, and all
    texts if nothing was learned give ``und``, score 0, rejected. Whole texts count, in blocks of BLOCK characters.
    Each row stands for itself: repeated rows, null doc_ids and other columns do not matter.
    """
    names = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False))
        for batch in slices(batches, "text"):
            preds, scores, rejected = [], [], []
            for text, letters in zip(batch.column("text").to_pylist(), batch.column("letters").to_pylist()):
                if not letters or not coders:
                    preds.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                blocks = [letters_only(text[i:i + BLOCK]).encode() for i in range(0, len(text), BLOCK)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
                saved = 1.0 if rest is None else 1 - sizes[best] / rest
                preds.append(names[best]), scores.append(min(1.0, 10 * saved)), rejected.append(saved < margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    """Documents kept from learning: crc32 of the id as text has remainder 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **learning) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, learned from rows that are not held out (a null doc_id is not)."""
    dictionaries = learn(docs.where(~held_out()).select("doc_id", "text", "lang"), **learning)
    return classify(docs, dictionaries).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
