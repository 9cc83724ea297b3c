"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

Each word length has a filter of its own. A filter is blocked: one hash picks a 64-bit lane and the bits in it, so a probe reads one
number. Tasks hash all deletions and replacements of their words from running sums, without spelling them out; only edits
that the filter lets pass become strings and shuffle to an exact join with the vocabulary, which drops the false ones.
An insert is found as the deletion of the longer word, a replacement from the word whose character is the lesser one, so each near pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymerge.plans.storage import written

from .common import mix, random64, signed, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint64)  # what a run consists of once A-Z are folded
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}
PART = 1 << 20  # characters of a text tokenized at once
HELD = 16 << 20  # characters of different words held by a task before their counts leave
GRID = 1 << 21  # probes made at once
PROBES = 6  # bits of a lane set for a word
BASE = np.uint64(int(random64(1, 23)[0]) | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def runs(text: str) -> Iterator[str]:
    """The runs of letters of a text. Long texts give them one by one."""
    return iter(RUN.findall(text)) if len(text) <= PART else (m.group() for m in RUN.finditer(text))


def folded(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(FOLD)


def misspelt(prefix: int, run: str, divisor: int) -> str:
    """The lower-cased run, without one letter if ``divisor`` divides its hash; ``prefix`` is the crc32 of what stands before it."""
    run = folded(run)
    h = zlib.crc32(run.encode(), prefix)
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, divisor: int = 199, least: int = 6) -> DataFrame:
    """(word, n): how often each word of ``least`` code points or more is in all texts.

    Words are runs of Latin letters with A-Z lower-cased. ``divisor`` plants misspellings: in about one of so many (doc_id, run) one
    letter goes; 0 plants none. Null texts have no words; a null doc_id counts as an empty one in the hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = {}, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{doc_id if doc_id is not None else ''}:".encode())
                for found, n in Counter(runs(text or "")).items():
                    if len(found) < least:
                        continue
                    word = misspelt(prefix, found, divisor) if divisor else folded(found)
                    if len(word) >= least:
                        if word not in counts:
                            counts[word], size = 0, size + len(word) + 32
                        counts[word] += n
                if size > HELD:
                    yield out()
                    counts, size = {}, 0
        if counts:
            yield out()

    parts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Filters:
    """Blocked Bloom filters of words by length: lane ``start[L]`` and the ``lanes[L]`` that follow belong to length L."""

    def __init__(self, words: dict[int, int], most_bytes: int, bits: int = 32) -> None:
        total = sum(words.values())
        share = min(bits / 64, most_bytes / 8 / max(1, total))
        self.lanes = {length: max(1, int(n * share)) for length, n in words.items()}
        starts = np.concatenate([[0], np.cumsum(list(self.lanes.values()))]).astype(np.int64)
        self.start = dict(zip(self.lanes, starts.tolist()))
        self.data = np.zeros(int(starts[-1]), np.uint64)

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(lane, bits) of words of one length with these hashes."""
        x = mix(hashes)
        lane = ((x >> np.uint64(32)) * np.uint64(self.lanes[length]) >> np.uint64(32)).astype(np.int64) + self.start[length]
        one, mask = np.uint64(1), np.zeros(x.shape, np.uint64)
        for i in range(PROBES):
            mask |= one << (x >> np.uint64(5 * i) & np.uint64(63))
        return lane, mask

    def pass_(self, hashes: np.ndarray, length: int) -> np.ndarray:
        lane, mask = self.places(hashes, length)
        return (self.data[lane] & mask) == mask


def powers(length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, BASE)]), dtype=np.uint64)


def letters(words: list[str], length: int) -> np.ndarray:
    """words x length code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)


def by_length(words: list[str], grid: int) -> Iterator[tuple[int, list[int]]]:
    """(length, positions of words of it), as many at a time as ``grid`` cells hold when a word takes a cell for each letter and edit."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        length, to = len(words[order[at]]), at
        room = max(1, grid // (length * len(ALPHABET)))
        while to < len(order) and to < at + room and len(words[order[to]]) == length:
            to += 1
        yield length, order[at:to]
        at = to


def build(vocabulary: DataFrame, most_bytes: int) -> Filters:
    """The filters, built lane by lane in the cluster; the driver receives ``most_bytes`` of lanes (and one lane a length) at most."""
    lengths = {r.length: r["count"] for r in vocabulary.groupBy(F.char_length("word").alias("length")).count().collect()}
    filters = Filters(lengths, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            words = batch.column("word").to_pylist()
            for length, own in by_length(words, GRID):
                hashes = (letters([words[i] for i in own], length) * powers(length)).sum(axis=1, dtype=np.uint64)
                lane, mask = filters.places(hashes, length)
                yield pa.RecordBatch.from_arrays([pa.array(lane), pa.array(signed(mask))], ["lane", "bits"])

    filled = vocabulary.select("word").mapInArrow(run, "lane bigint, bits bigint").groupBy("lane").agg(F.bit_or("bits").alias("bits"))
    filled = filled.toArrow()
    filters.data[filled.column("lane").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return filters


def edits(words: list[str], filters: Filters) -> Iterator[tuple[int, str]]:
    """(position of the word, edited word) for each deletion and each replacement by a greater character that passes the filters."""
    for length, own in by_length(words, GRID):
        texts = [words[i] for i in own]
        points, place = letters(texts, length), powers(length)
        terms = points * place
        whole = terms.sum(axis=1, dtype=np.uint64)
        if length - 1 in filters.lanes:
            upto = np.cumsum(terms, axis=1, dtype=np.uint64)
            shorter = upto - terms + (whole[:, None] - upto) * UNBASE
            new = np.ones(points.shape, bool)
            new[:, 1:] = points[:, 1:] != points[:, :-1]  # of equal neighbours, deleting the first is enough
            w, i = np.nonzero(new)
            hit = filters.pass_(shorter[w, i], length - 1)
            for a, b in zip(w[hit].tolist(), i[hit].tolist()):
                yield own[a], texts[a][:b] + texts[a][b + 1:]
        step = max(1, GRID // (len(own) * len(ALPHABET)))
        for low in range(0, length, step):  # a very long word in parts
            part = points[:, low:low + step]
            w, i, c = np.nonzero(ALPHABET[None, None, :] > part[:, :, None])
            hashes = whole[w] + (ALPHABET[c] - part[w, i]) * place[low + i]
            hit = filters.pass_(hashes, length)
            for a, b, d in zip(w[hit].tolist(), (i[hit] + low).tolist(), ALPHABET[c[hit]].tolist()):
                yield own[a], texts[a][:b] + chr(d) + texts[a][b + 1:]


def near_pairs(vocabulary: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """(word, n, other, m) for words of (word, n) that differ by one inserted, deleted or replaced code point; each pair once.

    Words are distinct and consist of the folded letters. The filters take 32 bits a word, ``most_bytes`` in all at most; a fuller
    filter lets more false edits pass to the join, and the result stays the same.
    """
    filters = vocabulary.sparkSession.sparkContext.broadcast(build(vocabulary, most_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", 1 << 18):
            words, n = batch.column("word").to_pylist(), batch.column("n")
            found, size = ([], []), 0
            for i, other in edits(words, filters.value):
                found[0].append(i), found[1].append(other)
                size += 2 * len(other) + 32
                if size > HELD:
                    yield candidates(batch, found)
                    found, size = ([], []), 0
            if found[0]:
                yield candidates(batch, found)

    def candidates(batch: pa.RecordBatch, found: tuple[list, list]) -> pa.RecordBatch:
        at = pa.array(found[0], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array(found[1], pa.string())], ["word", "n", "other"])

    passed = vocabulary.select("word", "n").mapInArrow(run, "word string, n bigint, other string")
    return passed.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").select("word", "n", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without cycles: each round doubles the steps that a link spans, until none changes."""
    links = written(forms.select("word", F.col("form").alias("to")), "spelling-links")
    while True:
        further = links.select(F.col("word").alias("to"), F.col("to").alias("end"))
        longer = written(links.join(further, "to", "left").select("word", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("grew")), "spelling-links")
        if longer.where("grew").isEmpty():
            return links.select("word", F.col("to").alias("root"))
        links = longer.select("word", "to")


def variants(vocabulary: DataFrame, times: int = 5, most_bytes: int = 256 << 20) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n), words distinct.

    ``form``: of the near words that with the greatest n (ties: the least in code-point order), if it is ``times`` n or more, else null.
    ``root``: the last word when forms are followed (n grows at each step, so there is an end), the word itself without a form.
    A word without near words has n_near 0. An empty vocabulary gives no rows.
    """
    pairs = near_pairs(vocabulary, most_bytes)
    ways = F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    both = pairs.select(F.inline(ways))
    best = F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    enough = F.col("best.m") >= times * F.col("n")
    formed = written(joined.select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(enough, F.col("best.m")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_count: int = 5, most_bytes: int = 256 << 20) -> DataFrame:
    """``variants`` of all words of 6 code points or more that occur ``least_count`` times or more in whole texts, with planted misspellings.

    Repeated rows count as often as they stand there; other columns than doc_id and text are not read."""
    vocabulary = written(word_counts(docs).where(F.col("n") >= least_count), "vocabulary")
    return variants(vocabulary, most_bytes=most_bytes)
