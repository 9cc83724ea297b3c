"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks (the tasks of the first pass). Each block permutes its rows locally. How many rows a block sends to each
shard is one row of a random matrix whose row sums are the block sizes and whose column sums are the shard sizes: the counts
that a uniform shuffle of all rows would give. Rows then go to their shard, where they are permuted again.

The matrix is never written out. A tree halves the list of blocks; at each node a seeded draw splits what the shards still take
between the halves. The task of a block walks from the root to its leaf, so any block finds its row alone, and finds the same one
again after a lost executor. Random keys and positions are written before they are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from waymerge.plans.storage import written

BLOCKS = 1 << 16  # most blocks; scan partitions beyond are joined to fewer, without a shuffle
CELL = 1 << 20  # most rows of a shard that are permuted in one task
LARGE = 10**9  # numpy draws from smaller populations only


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good`` + ``bad``; of any size (ratio of uniforms around the mode beyond LARGE)."""
    if good < LARGE and bad < LARGE:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    least, most = max(0, drawn - bad), min(drawn, good)
    mode = (drawn + 1) * (good + 1) // (total + 2)
    mean = drawn * good / total
    var = mean * (bad / total) * ((total - drawn) / max(1, total - 1))

    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))

    top = log_weight(mode)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if least <= k <= most and 2 * math.log(u) <= log_weight(k) - top:
            return k


def split(rng: np.random.Generator, capacity: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows each column takes if rows fill places at random: a multivariate hypergeometric draw."""
    total = int(capacity.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(capacity, drawn, method="marginals")
    out = np.zeros_like(capacity)
    for i, c in enumerate(capacity.tolist()):
        total -= c
        out[i] = hypergeometric(rng, c, total, drawn) if drawn and c else 0
        drawn -= int(out[i])
    return out


def matrix_row(block: int, before: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Rows of one block for each column. ``before``: rows in all earlier blocks, with the total at the end."""
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split(rng, capacity, int(before[middle] - before[low]))
        if block < middle:
            high, capacity = middle, left
        else:
            low, capacity = middle, capacity - left
    return capacity


def cells(rows: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of each cell: shards differ by one row at most, and are cut into cells of CELL rows at most."""
    shard, first, size = [], [], []
    for s in range(shards):
        own = rows // shards + (s < rows % shards)
        pieces = max(1, -(-own // CELL))
        edges = [own * i // pieces for i in range(pieces + 1)]
        shard += [s] * pieces
        first += edges[:-1]
        size += [b - a for a, b in zip(edges, edges[1:])]
    return np.array(shard, np.int32), np.array(first, np.int64), np.array(size, np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """All columns of ``docs``, shard int (0 to shards - 1) and slot bigint (0 to the shard's size - 1), every arrangement equally likely.

    Shard sizes differ by one row at most (the first shards have the extra rows). The result is fixed by the seed and the rows'
    arrangement in input partitions. Rows are not looked at: nulls, empty and very long texts, equal rows and groups of copies
    are each rows like others, and copies may go to different shards. An empty table gives no rows. Columns of
    ``docs`` named shard or slot (in any case) are replaced; all other names are kept.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = docs.drop("shard", "slot").select(F.struct("*").alias("row"), F.rand(seed).alias("first"), F.rand(seed + (1 << 40)).alias("second"))
    # the local permutation; after it the id counts on within each task: its number is the block, the rest the row's rank there
    local = rows.coalesce(BLOCKS).sortWithinPartitions("first").select("row", "second", F.monotonically_increasing_id().alias("at"))
    placed = written(local, "shard-blocks")
    held = placed.groupBy(F.shiftright("at", 33).alias("block")).count().collect()  # one row a block, BLOCKS at most
    counts = dict(sorted((r.block, r["count"]) for r in held))
    number = {block: i for i, block in enumerate(counts)}
    before = np.concatenate([[0], np.cumsum(np.array(list(counts.values()), np.int64))]).astype(np.int64)
    shard, first, size = cells(int(before[-1]), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends = None, None
        for batch in batches:
            at = batch.column("at").to_numpy()
            block, rank = at >> 33, at & ((1 << 33) - 1)
            cell = np.zeros(len(at), np.int64)
            for b in np.unique(block).tolist():
                if b != known:
                    known, ends = b, np.cumsum(matrix_row(number[b], before, size, seed))
                own = block == b
                cell[own] = np.searchsorted(ends, rank[own], "right")
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("second"), batch.column("at"), pa.array(cell)], ["row", "second", "at", "cell"])

    fields = StructType([placed.schema["row"], placed.schema["second"], placed.schema["at"]]).add("cell", LongType())
    dealt = placed.mapInArrow(deal, fields)
    # the exchange, and the permutation within the cell
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("second", "at")).cast("bigint") - 1
    ranked = dealt.withColumn("rank", rank)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            slot = first[cell] + batch.column("rank").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shard[cell]), pa.array(slot)], ["row", "shard", "slot"])

    out = StructType([placed.schema["row"]]).add("shard", IntegerType()).add("slot", LongType())
    return ranked.select("row", "cell", "rank").mapInArrow(settle, out).select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, rows_a_file: int = CELL) -> None:
    """The shards as Parquet folders ``shard=0`` and so on below ``path``; file by file in slot order, each with ``rows_a_file`` rows at most."""
    dealt = shuffle_into_shards(docs, shards, seed)
    piece = F.floor(F.col("slot") / rows_a_file)
    spread = dealt.repartitionByRange(F.col("shard"), piece).sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 16; null text: 16), text_crc32, law ``rows``, shard, slot, grown_shard (null: not asked of this law).

    Only these narrow columns are dealt; ``shuffle_into_shards`` and ``write_shards`` deal whole rows alike. A null text has the
    crc32 of an empty one; a null doc_id stays null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = shuffle_into_shards(narrow, shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
