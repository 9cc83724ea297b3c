"""CSV files read by byte ranges: quoted line breaks do not keep a file in one task.

Spark's text reader deals out lines with the byte range they start in. At the start of a line a reader is either at a row's start or
inside a quoted field; so a first pass says, for both cases, how each range ends and how many rows start in it. Run
over a file's ranges in order, that tells how each range really starts, and a second pass reads its rows. A row that runs
over a range's end comes in pieces, which are put together afterwards; nothing else is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.storage import written

_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_REST = re.compile(r"[^,]*")
FEW_FILES = 10_000  # files whose headers are broadcast; with more, rows are joined to them


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``. A quote opens one only at a field's start, and two quotes in it are one of text."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        if inside:
            closed = _CLOSING.match(line, at)
            if not closed:
                return True
            inside, at = False, closed.end()
        at = _REST.match(line, at).end() + 1
        if at > len(line):
            return False


def split_row(row: str) -> list[str]:
    """The fields of one row; text after a closing quote belongs to the field, and an open one ends with the row."""
    if '"' not in row:
        return row.split(",")
    fields, at = [], 0
    while True:
        text = ""
        if row.startswith('"', at):
            closed = _CLOSING.match(row, at + 1)
            end = closed.end() - 1 if closed else len(row)
            text, at = row[at + 1:end].replace('""', '"'), end + 1
        rest = _REST.match(row, at)
        fields.append(text + rest.group())
        at = rest.end() + 1
        if at > len(row):
            return fields


def _trimmed(row: str) -> str:
    return row[:-1] if row.endswith("\r") else row


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, tuple[str, int], pa.RecordBatch, int]]:
    """(line, whether it is its range's first, range, batch, place in it); the lines of a range follow one another."""
    last = None
    for batch in batches:
        files, blocks, lines = (batch.column(c).to_pylist() for c in ("file", "block", "line"))
        for i, at in enumerate(zip(files, blocks)):
            line, first = lines[i], at != last
            if first and at[1] == 0:
                line = line.removeprefix("﻿")
            last = at
            yield line, first, at, batch, i


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and for both ways it may start: whether it ends inside a field, rows that start in it, whether the open row does."""
    found, at = [], None
    for line, first, at, _, _ in _lines(batches):
        if first:
            found.append([*at, False, 0, False, True, 0, False])
        now = found[-1]
        blank = line in ("", "\r")
        for k in (2, 5):  # started at a row's start, inside a field
            if not now[k]:
                if blank:
                    continue
                now[k + 1] += 1
                now[k + 2] = True
            now[k] = ends_inside(line, now[k])
    names = ["file", "block", "end0", "rows0", "own0", "end1", "rows1", "own1"]
    if found:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], pa.schema(
            [("file", pa.string()), ("block", pa.int64()), ("end0", pa.bool_()), ("rows0", pa.int64()), ("own0", pa.bool_()),
             ("end1", pa.bool_()), ("rows1", pa.int64()), ("own1", pa.bool_())]))


def _chain(ranges: pd.DataFrame) -> pd.DataFrame:
    """How each range of a file starts: inside a field or not, after how many rows, and the range in which the open row began."""
    out, inside, rows, opened = [], False, 0, -1
    for r in ranges.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, rows, opened))
        own = r.own1 if inside else r.own0
        inside, rows = (r.end1, rows + r.rows1) if inside else (r.end0, rows + r.rows0)
        opened = r.block if own else opened
    return pd.DataFrame(out, columns=["file", "block", "inside", "rows", "opened"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows as fields, and pieces of rows that cross a range's end as text."""
    schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("values", pa.list_(pa.string())), ("opened", pa.int64()), ("block", pa.int64()), ("piece", pa.string())])
    held, size, state = [], 0, None

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def piece() -> list:
        """What is left open at the end of a range."""
        return [(state["file"], state["n"], None, state["opened"], state["block"], "\n".join(state["lines"]))] if state and state["inside"] else []

    for line, first, (file, block), batch, i in _lines(batches):
        if first:
            held += piece()
            state = {"file": file, "block": block, "inside": batch.column("inside")[i].as_py(), "n": batch.column("rows")[i].as_py(), "lines": []}
            state["opened"] = batch.column("opened")[i].as_py()
            if state["inside"]:
                state["n"] -= 1  # the open row is one of those counted before
        if not state["inside"]:
            if line in ("", "\r"):
                continue
            state["lines"], state["opened"] = [], block
        state["lines"].append(line)
        size += len(line) + 32
        state["inside"] = ends_inside(line, state["inside"])
        if not state["inside"]:
            row = "\n".join(state["lines"])
            if state["opened"] == block:
                held.append((file, state["n"], split_row(_trimmed(row)), None, None, None))
            else:
                held.append((file, state["n"], None, state["opened"], block, row))
            state["n"] += 1
        if size > 4 << 20:
            if held:
                yield batch_of(held)
            held, size = [], 0
    held += piece()
    if held:
        yield batch_of(held)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [split_row(_trimmed(x)) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("n"), pa.array(rows, pa.list_(pa.string()))], ["file", "n", "values"])


def read_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """(__file, __n, __header, __values) of every row below ``path`` but the first of its file, which is its header.

    Rows are separated by line feeds, with or without a carriage return, outside quoted fields; a lone carriage return is text. Blank lines are no rows and are not
    counted; ``__n`` counts the others from 1 after the header. A byte order mark is dropped. Fields are comma-separated and as many as the row
    has; a row's last quoted field may be left open. The rows are parsed once and written to the shared folder. Empty files and files without a row but the header give none.
    """
    source = spark.read.options(lineSep="\n", **options).text(path)
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    ranges = lines.mapInArrow(_ends, "file string, block bigint, end0 boolean, rows0 bigint, own0 boolean, end1 boolean, rows1 bigint, own1 boolean")
    starts = ranges.groupBy("file").applyInPandas(_chain, "file string, block bigint, inside boolean, rows bigint, opened bigint")
    # one row for each byte range of a task (128 MB by default), so it is small; and a broadcast join keeps the order of lines
    placed = lines.join(F.broadcast(starts), ["file", "block"])
    parsed = written(placed.select("file", "block", "line", "inside", "rows", "opened").mapInArrow(
        _rows, "file string, n bigint, values array<string>, opened bigint, block bigint, piece string"), "csv-rows")
    pieces = parsed.where(F.col("piece").isNotNull()).groupBy("file", "opened").agg(
        F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("ps"))
    texts = pieces.select("file", "n", F.array_join(F.transform("ps", lambda p: p["piece"]), "\n").alias("text"))
    rows = parsed.where(F.col("piece").isNull()).select("file", "n", "values").unionAll(texts.mapInArrow(_joined, "file string, n bigint, values array<string>"))
    heads = rows.where("n = 0").select("file", F.col("values").alias("__header"))
    if len(source.inputFiles()) <= FEW_FILES:
        heads = F.broadcast(heads)
    return rows.where("n > 0").join(heads, "file").select(F.col("file").alias("__file"), F.col("n").alias("__n"), "__header", F.col("values").alias("__values"))
