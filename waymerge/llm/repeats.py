"""Removal of repeated byte strings by iterative refinement of the order of suffixes over shards.

Suffixes of all documents are kept in blocks that share a prefix, as when Burrows-Wheeler transforms of shards are merged: a round
refines the blocks of the interleave by more context and never sorts suffixes again. Only block boundaries are kept, and
only where a common prefix of ``LENGTH`` bytes is still open:

* A window is LENGTH bytes at some place. Of its K-grams the one of least hash (leftmost) is its anchor. Equal windows have
  equal anchors at the same distance, so blocks start as anchors of equal hash; an anchor in a block of its own has no repeated window.
* Neighbouring windows with one anchor form a run. Runs of equal context repeat as a whole.
* Other runs are refined: for distances [s, s + size) the bytes common to their windows split the block, the bytes of all of them
  confirm it; what is neither unique nor confirmed goes on with a quarter of the size. At size 1 both are the window itself, so every window is decided exactly.

Bytes are compared by hashes: refined runs by one of 128 bits; whole runs by 64 bits of the anchor and 64 of the context, so runs whose anchors are equal are told
apart by 64 bits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymerge.plans.storage import written

from .common import mix, random64, signed, slices, utf8

LENGTH = 200
K = 32
SPAN = LENGTH - K + 1  # K-grams of a window
SIZES = (64, 16, 4, 1)
PART = 1 << 20  # windows handled at once
BITS = np.uint64((1 << 22) - 1)
BYTES, STEPS = random64(256, 21), random64(8, 22) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
KEY = ["k1", "k2"]
WHOLE = ["whole", "whole2"]  # equal bytes by 128 bits


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per run of windows with one anchor, over rows of bytes: row, anchor, first and last window (places in the row), hash of the anchor, hash of the context."""
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    last = len(data) - LENGTH + 1  # windows, valid or not
    for base in range(0, max(last, 0), PART):
        part = BYTES[data[base: base + PART + LENGTH - 1]]
        grams, width = part, 1
        for step in range(5):
            grams = grams[:-width] * STEPS[step] + grams[width:]
            width *= 2
        grams = mix(grams)
        least = (grams & ~BITS) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
        anchor = (least & BITS).astype(np.int64)
        place = np.arange(len(anchor))
        row = np.searchsorted(offsets, base + place, "right") - 1
        good = base + place + LENGTH <= offsets[row + 1]
        place, anchor, row = place[good], anchor[good], row[good]
        if not len(place):
            continue
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))
        first = np.flatnonzero(new)
        lo, hi = place[first], place[np.append(first[1:], len(place)) - 1]
        a, r = anchor[first], row[first]
        powers = np.empty(len(part) + 1, np.uint64)
        powers[0] = 1
        powers[1:] = BASE
        back = powers.copy()
        back[1:] = INVERSE
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(back, out=back)
        total = np.append(np.zeros(1, np.uint64), np.cumsum(part * powers[:-1], dtype=np.uint64))
        context = (total[hi + LENGTH] - total[lo]) * back[lo]
        context = mix(context ^ mix((hi - lo).astype(np.uint64) * np.uint64(512) + (a - lo).astype(np.uint64)))
        start = offsets[r] - base
        for out, x in zip(found, (r, a - start, lo - start, hi - start, grams[a], context)):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64 if i < 4 else np.uint64) for i, x in enumerate(found))


def _runs(docs: DataFrame) -> DataFrame:
    """k1, k2, a, lo, hi (distances anchor - window: least and greatest), h, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            row, a, lo, hi, h, c = runs(*utf8(batch.column("text")))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1").take(take), batch.column("k2").take(take), pa.array(a, pa.int64()), pa.array(a - hi, pa.int32()), pa.array(a - lo, pa.int32()), pa.array(signed(h)), pa.array(signed(c))],
                [*KEY, "a", "lo", "hi", "h", "c"])

    return docs.mapInArrow(run, "k1 bigint, k2 int, a bigint, lo int, hi int, h bigint, c bigint")


def _contexts(open_runs: DataFrame, texts: DataFrame) -> DataFrame:
    """The open runs with the bytes of their context."""
    asked = open_runs.groupBy(*KEY).agg(F.collect_list(F.struct("h", "n", "a", "lo", "hi")).alias("runs"))  # as many as fit a text
    kept = texts.join(asked.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in (*KEY, "h", "n", "a", "lo", "hi", "bytes")}
            for k1, k2, text, found in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "runs"))):
                data = text.encode()
                for x in found:
                    for name, value in (("k1", k1), ("k2", k2), *x.items(), ("bytes", data[x["a"] - x["hi"]: x["a"] - x["lo"] + LENGTH])):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    joined = kept.join(asked, KEY).select(*KEY, "text", "runs")
    return joined.mapInArrow(run, "k1 bigint, k2 int, h bigint, n bigint, a bigint, lo int, hi int, bytes binary")


def _nodes(contexts: DataFrame, size: int) -> DataFrame:
    """id, n, s, x, y, common, whole, whole2: for each asked s the distances x to y of the run in [s, s + size), and hashes of the bytes all and any of their windows have.

    Equal ``common`` only decides what is looked at again, so 64 bits do; ``whole`` decides what is removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for ident, n, h, lo, hi, data, asked in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "h", "lo", "hi", "bytes", "asked"))):
                for s in asked:
                    x, y = max(s, lo), min(s + size - 1, hi)
                    if x > y:
                        continue
                    common = hashlib.blake2b(data[hi - s: hi - s - size + 1 + LENGTH], digest_size=8, salt=h.to_bytes(8, "little", signed=True), person=s.to_bytes(2, "little")).digest()
                    whole = hashlib.blake2b(data[hi - y: hi - x + LENGTH], digest_size=16, salt=h.to_bytes(8, "little", signed=True), person=x.to_bytes(2, "little") + y.to_bytes(2, "little")).digest()
                    for o, v in zip(out, (ident, n, s, x, y, int.from_bytes(common, "little", signed=True), *struct.unpack("<qq", whole))):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["id", "n", "s", "x", "y", "common", *WHOLE])

    return contexts.select("id", "n", "h", "lo", "hi", "bytes", "asked").mapInArrow(run, "id bigint, n bigint, s int, x int, y int, common bigint, whole bigint, whole2 bigint")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """k1, k2, start, end: bytes covered by repeated windows, as overlapping spans, of rows (k1, k2, text); equal texts share a key and count as often as they come."""
    every = _runs(texts)
    shared = every.select("h").groupBy("h").count().where("count > 1").select("h")
    alive = written(every.join(shared, "h"), "runs")
    blocks = written(alive.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "a", "lo", "hi")).alias("r")).select("h", "c", "n", "r.*"), "blocks")
    same = alive.join(blocks.where("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    spans = same.select(*KEY, (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + LENGTH).alias("end")).distinct()
    split = blocks.groupBy("h").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("u")).where("m > 1 and u > 0").select("h")
    # numbered as they are written, so the numbers are fixed from then on
    contexts = written(_contexts(blocks.join(split, "h"), texts).withColumn("id", F.monotonically_increasing_id()), "contexts")
    starts = F.sequence(F.col("lo") - F.col("lo") % SIZES[0], F.col("hi"), F.lit(SIZES[0]))
    asking = contexts.withColumn("asked", starts)
    for size, finer in zip(SIZES, (*SIZES[1:], 0)):
        nodes = written(_nodes(asking, size), "nodes")
        confirmed = nodes.groupBy(*WHOLE).agg(F.sum("n").alias("times")).where("times > 1").select(*WHOLE, F.lit(True).alias("sure"))
        judged = nodes.join(confirmed, WHOLE, "left").select("id", "s", "x", "y", "common", "n", F.coalesce("sure", F.lit(False)).alias("sure"))
        places = contexts.select("id", *KEY, "a")
        sure = judged.where("sure and n = 1").join(places, "id")
        spans = spans.union(sure.select(*KEY, (F.col("a") - F.col("y")).alias("start"), (F.col("a") - F.col("x") + LENGTH).alias("end")))
        if finer:
            going = judged.groupBy("common").agg(F.sum("n").alias("times"), F.count_if(~F.col("sure")).alias("unsure")).where("times > 1 and unsure > 0").select("common")
            next_asked = judged.join(going, "common", "left_semi").groupBy("id").agg(F.flatten(F.collect_list(F.sequence("s", F.col("s") + size - 1, F.lit(finer)))).alias("asked"))
            asking = contexts.join(next_asked, "id")
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte is removed if a LENGTH-byte string over it also starts at another place, in the same or any other row; strings never cross rows and are
    judged on the input. Null texts count as empty; texts under LENGTH bytes lose nothing. Repeated rows are repeats of each other. Doc_ids are only carried along,
    so they may be null or repeat; other columns are not read; an empty table gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "text")
    spans = repeated_spans(keyed.select(*KEY, "text").where(F.octet_length("text") >= LENGTH))
    per_text = written(spans.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                kept, at, n, removed = [], 0, 0, 0
                for span in found or ():
                    start, end = span["start"], span["end"]
                    if start > at or not n:
                        kept.append(data[at:start])
                        n += 1
                        at = start
                    if end > at:
                        removed += end - at
                        at = end
                rest = b"".join([*kept, data[at:]])
                for o, v in zip(out, (len(data), removed, n, hashlib.sha256(rest).hexdigest(), rest)):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = keyed.join(per_text, KEY, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
