"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A set's sketch has T coordinates. In round i each element goes to a hashed bin with value i + fraction; a bin keeps its least
value. Rounds stop once every bin is filled; rounds T to 2T - 1 throw every element into bin i - T, so all bins fill for certain.
Two sets agree in a coordinate with the probability of their Jaccard similarity, concentrated as T independent draws.

Sets that are equal become one class before anything is paired. Bands of coordinates give buckets; classes of a bucket with
many get many longer bands, which part loosely similar texts; these are as long as they can be without missing more pairs at the limit
than the first ones do. Members are first paired with the least of their bucket; once that has
given components, the few members of a bucket that are in different ones are paired, if packed sketches come near the limit. Every pair
is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymerge.plans.storage import written

from .common import distinct, mix, random64, shingle_hashes, signed, slices, utf8, word_hashes

T = 512
BANDS, ROWS = 40, 5  # a pair of similarity 0.8 shares no band with probability 8e-7, of 0.85 with 2e-9
DEEP_BANDS = 160  # of _deep_rows coordinates: at limit 0.8 a pair shares none of them with probability 9e-8, at 0.85 with 2e-10
FEW = 32  # classes of a bucket beyond which they get the longer bands
ERRORS = 4  # a pair whose sketches agree this many standard errors less than the limit lets expect is not verified
SMALL = 1_000_000  # class numbers (8 bytes each) that are broadcast at most; beyond, texts are shuffled to them
SALTS = random64(2, 5)
DEEP = np.stack([np.argsort(random64(T, 1000 + b)) for b in range(DEEP_BANDS)])  # the first coordinates of each row are a band


def sketch(hashes: np.ndarray, owners: np.ndarray, sets: int) -> np.ndarray:
    """sets x T coordinates of the sets given as distinct element hashes with their owner (0 to sets - 1); all ones where a set is empty."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(sets * T, empty)
    open_sets = np.unique(owners)
    seeds = random64(2 * T, 3)
    for i in range(2 * T):
        if not len(hashes):
            break
        x = mix(hashes + seeds[i])
        at = (x % np.uint64(T)).astype(np.int64) if i < T else i - T
        np.minimum.at(bins, owners * T + at, (np.uint64(i) << np.uint64(48)) | (x >> np.uint64(16)))
        left = (bins.reshape(sets, T)[open_sets] == empty).any(axis=1)
        if not left.all():
            open_sets = open_sets[left]
            is_open = np.zeros(sets, bool)
            is_open[open_sets] = True
            keep = is_open[owners]
            hashes, owners = hashes[keep], owners[keep]
    return bins.reshape(sets, T)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owners) of the distinct shingles of a text column, set sizes, 2 x rows digests."""
    hashes, owners = distinct(*shingle_hashes(*word_hashes(*utf8(column))))
    digest = np.zeros((2, len(column)), np.uint64)
    for k, salt in enumerate(SALTS):
        np.add.at(digest[k], owners, mix(hashes ^ salt))
    return hashes, owners, np.bincount(owners, minlength=len(column)), digest


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n (set size), d1, d2 (128-bit digest of the set; null for an empty one), sketch (16 bits a coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, owners, sizes, digest = _sets(batch.column("text"))
            codes = (mix(sketch(hashes, owners, batch.num_rows)) >> np.uint64(48)).astype(np.uint16)
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(signed(digest[0]), mask=none), pa.array(signed(digest[1]), mask=none),
                 pa.array([None if e else c.tobytes() for e, c in zip(none, codes)], pa.binary())],
                ["doc_id", "n", "d1", "d2", "sketch"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sketch binary")


def _class_texts(docs: DataFrame) -> DataFrame:
    """(rep, text) per row with a non-empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, sizes, digest = _sets(batch.column("text"))
            rows = pa.RecordBatch.from_arrays([pa.array(signed(digest[0])), pa.array(signed(digest[1])), batch.column("text")], ["d1", "d2", "text"])
            yield rows.filter(pa.array(sizes > 0))

    return docs.select("text").mapInArrow(run, "d1 bigint, d2 bigint, text string").select(F.xxhash64("d1", "d2").alias("rep"), "text")


def _missed(percent: int, bands: int, rows: int) -> float:
    """Chance that a pair at the limit is equal in no band, over the numbers of the T coordinates in which it may agree."""
    j = percent / 100
    return sum(comb(T, x) * j**x * (1 - j) ** (T - x) * (1 - comb(x, rows) / comb(T, rows)) ** bands for x in range(T + 1))


def _deep_rows(percent: int) -> int:
    """Coordinates of a longer band: the most with which a pair at the limit is not missed more often than by the first bands."""
    allowed = _missed(percent, BANDS, ROWS)
    return max(r for r in range(ROWS, 4 * ROWS) if _missed(percent, DEEP_BANDS, r) <= allowed)


def _bands(classes: DataFrame, deep: int = 0) -> DataFrame:
    """(key, rep): the buckets of each class, of the longer bands if ``deep`` names their coordinates."""
    chosen = DEEP[:, :deep] if deep else np.arange(BANDS * ROWS).reshape(BANDS, ROWS)
    salt = random64(len(chosen), 77 + bool(deep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, T).astype(np.uint64)
                keys = np.broadcast_to(salt, (len(codes), len(chosen))).copy()
                for r in range(chosen.shape[1]):
                    keys = mix(keys + codes[:, chosen[:, r]])
                reps = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), len(chosen))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "key bigint, rep bigint")


def _buckets(bands: DataFrame, purpose: str) -> DataFrame:
    """(key, rep, size, least) of buckets with two classes or more, written."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
    return written(bands.join(sizes, "key"), purpose)


def _stars(buckets: DataFrame) -> DataFrame:
    """Each member with the least of its bucket: as many pairs as members."""
    return buckets.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b"))


def _least_agreement(percent: int, chance: float) -> int:
    """Coordinates in which a pair at the limit agrees at least, when unequal ones agree by ``chance``."""
    q = chance + (1 - chance) * percent / 100
    return int(T * q - ERRORS * (T * q * (1 - q)) ** 0.5)


def _packed(classes: DataFrame) -> DataFrame:
    """rep, n and four bits of each coordinate, as longs p0 to p31."""
    longs = T // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, longs, 16).astype(np.uint64) & np.uint64(15)
            packed = np.bitwise_or.reduce(codes << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), *(pa.array(signed(packed[:, i].copy())) for i in range(longs))], ["rep", "n", *(f"p{i}" for i in range(longs))])

    return classes.select("rep", "n", "sketch").mapInArrow(run, "rep bigint, n bigint, " + ", ".join(f"p{i} bigint" for i in range(longs)))


def _across(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket whose packed sketches come near the limit; the join itself drops the others.

    A pair comes from the first bucket that both are in, so it comes once. ``keys`` holds a class's own buckets, at most one per band.
    """
    own = mixed.groupBy("rep").agg(F.collect_list("key").alias("keys"))
    rows = mixed.join(_packed(classes.join(mixed.select("rep").distinct(), "rep", "left_semi")).join(own, "rep"), "rep")
    a = rows.select("key", *(F.col(c).alias(f"a_{c}") for c in rows.columns if c != "key"))
    b = rows.select("key", *(F.col(c).alias(f"b_{c}") for c in rows.columns if c != "key"))
    agree = F.lit(0)
    for i in range(T // 16):
        x = F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        agree = agree + F.bit_count(F.bitwise_not(x).bitwiseAND(F.lit(0x1111111111111111)))
    near = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_c") != F.col("b_c")) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (agree >= _least_agreement(percent, 1 / 16))
    once = a["key"] == F.array_min(F.array_intersect("a_keys", "b_keys"))
    return a.join(b, (a["key"] == b["key"]) & near & once).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose set sizes allow the limit and whose sketches come near it."""
    least = _least_agreement(percent, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, T) for c in ("sa", "sb"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    joined = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of the full shingle sets."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        hashes, owners = distinct(*shingle_hashes(*word_hashes(*utf8(column))))
        return np.split(hashes, np.cumsum(np.bincount(owners, minlength=len(column)))[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta"):
            keep = []
            for part in slices(iter([batch]), "tb"):
                for x, y in zip(sets(part.column("ta")), sets(part.column("tb"))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for nodes that have a link.

    Each round takes every node to the least of itself and its neighbours, and on to that one's least; the links then run between
    the nodes so reached, and links within one vanish. Nodes only move to smaller ones of their component, so its least stays and the
    last round leaves it alone. Each round is written, so lost executors cost one round, and handles only what the last one left.
    """
    moves = []
    edges = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        heard = edges.select(F.explode(F.array(F.struct("a", F.col("a").alias("low")), F.struct(F.col("b").alias("a"), F.col("a").alias("low")))).alias("m"))
        heard = heard.select("m.*").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        further = heard.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        moves.append(written(heard.join(further, "low").select("node", F.col("jump").alias("to")), "moves"))
        ends = edges.join(moves[-1].toDF("a", "x"), "a").join(moves[-1].toDF("b", "y"), "b").where("x != y")
        edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not moves:
        return links.sparkSession.createDataFrame([], "node bigint, component bigint")
    found = moves.pop().toDF("node", "component")
    while moves:
        found = moves.pop().join(found.toDF("to", "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return found


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z folded; a set holds the distinct shingles of five words, or the whole sequence
    if it is shorter. Documents are linked if 100 * intersection >= percent * union. component_id is the least doc_id
    reachable, itself included; kept says it is the own one. Null or empty texts and texts of white space have empty sets and stand alone.
    Rows that repeat a doc_id count as one document: each row's text links it, and component_id takes the least id of the row's class.
    A null doc_id takes part in links and gets the least non-null id; it is kept only if there is none. Other columns are not read; empty tables give empty results.
    """
    rows = written(shingle_sets(docs), "shingle-sets")
    classes = written(
        rows.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.min(F.struct("sketch", "n")).alias("s"))
        .select("d1", "d2", "least", F.xxhash64("d1", "d2").alias("rep"), "s.sketch", "s.n"), "classes")
    first = _buckets(_bands(classes), "buckets")
    hot = first.where(f"size > {FEW}").select("rep").distinct()
    deep = _buckets(_bands(classes.join(hot, "rep", "left_semi"), _deep_rows(percent)), "deep-buckets")
    parted = first.where(f"size <= {FEW}").union(deep)
    likely = written(_likely(_stars(parted), classes, percent), "likely")
    found = written(components(_links(likely, docs, percent)), "components")
    # buckets that hold several components: their members across components
    large = parted.join(found.toDF("rep", "c"), "rep", "left").select("key", "rep", F.coalesce("c", "rep").alias("c"))
    mixed = written(large.join(large.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("key"), "key"), "mixed")
    named = classes.join(found.toDF("rep", "component"), "rep", "left").select("rep", "d1", "d2", "least", F.coalesce("component", "rep").alias("component"))
    if not mixed.isEmpty():
        more = _links(written(_across(mixed, classes, percent), "likely"), docs, percent)
        end = lambda k: found.toDF(k, f"{k}_c")
        between = more.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
        joined = components(between).toDF("component", "whole")
        named = named.join(joined, "component", "left").select("rep", "d1", "d2", "least", F.coalesce("whole", "component").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(lowest, "component").select("d1", "d2", "component_id")
    out = rows.join(ids, ["d1", "d2"], "left").withColumn("component_id", F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(likely: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Verified pairs, written. Only texts of classes that are in a pair move, and one text stands for each class."""
    wanted = written(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct(), "wanted")
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    texts = _class_texts(docs).join(wanted, "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
    return written(_verified(likely, written(texts, "texts"), percent), "links")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose document is the kept one of its group; see near_duplicates. Rows that repeat a doc_id share
    its fate and stay together; rows with a null doc_id cannot be told apart and stay."""
    dropped = near_duplicates(docs, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(dropped, F.col("doc_id").cast("bigint") == F.col("__doc"), "left_anti")
