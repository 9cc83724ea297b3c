"""Arrow batches as arrays, and hashes of words and shingles over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK = 2 << 20  # text bytes handled at once inside a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about ``limit`` text bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(utf8_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(utf8(column)[1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[0x41:0x5B] += 32
PLACES = random64(1 << 12, 7) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of a batch in text order. Words are runs without ASCII white space, A-Z folded; none crosses rows."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts_here = word.copy()
    starts_here[1:] &= ~word[:-1] | first[1:-1]
    starts = np.flatnonzero(starts_here)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.flatnonzero(starts_here[word])
    letters = LOWER[data[word]] + np.uint64(1)
    lengths = np.diff(np.append(begin, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    places = PLACES if lengths.max() <= len(PLACES) else random64(int(lengths.max()), 7) | np.uint64(1)
    return mix(np.add.reduceat(letters * places[place], begin)), np.searchsorted(offsets, starts, "right") - 1


STEPS = random64(16, 11) | np.uint64(1)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each shingle of ``size`` words; a row with fewer words has its whole sequence as one."""
    n = len(words)
    if not n:
        return words, rows
    keep = rows[: n - size + 1] == rows[size - 1:] if n >= size else np.zeros(0, bool)
    at = np.flatnonzero(keep)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total += words[at + j] * STEPS[j]
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    counts = np.diff(np.append(begin, n))
    few = counts < size
    short, whole = begin[few], np.zeros(int(few.sum()), np.uint64)
    for j in range(size - 1):
        has = counts[few] > j
        whole[has] += words[short[has] + j] * STEPS[j]
    whole = mix(whole + counts[few].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes, owners = np.concatenate([mix(total), whole]), np.concatenate([rows[at], rows[short]])
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different hashes, ascending within the row."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])) if len(hashes) else np.zeros(0, bool)
    return hashes[new], rows[new]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.flags["C_CONTIGUOUS"] else np.ascontiguousarray(x).view(np.int64)


def widened(schema: StructType, added: str) -> StructType:
    """The schema followed by the columns of a DDL string."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])
