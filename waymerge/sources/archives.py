"""CSV members of zip archives, each member parsed by a task of its own."""

from __future__ import annotations

import codecs
import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .csvrows import ends_inside, split_row

_STORED, _DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
_CHUNK = 1 << 20  # bytes inflated at once
_OUT = 4 << 20  # characters of rows in one batch
_MEMBER = pa.schema([("archive", pa.string()), ("member", pa.string()), ("deflated", pa.bool_()), ("data", pa.binary()), ("crc", pa.int64()), ("reason", pa.string())])


def _cut(archive: str, content: bytes) -> Iterator[tuple]:
    """The archive's CSV members as they lie in it; members packed in a rarer way are unpacked here."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            tables = [m for m in z.infolist() if m.filename.lower().endswith(".csv")]
            for m in [m for m in tables if "saved" in m.filename.lower()] or tables:
                if m.compress_type in (_STORED, _DEFLATED) and not m.flag_bits & 1:
                    name, extra = struct.unpack("<HH", content[m.header_offset + 26: m.header_offset + 30])
                    start = m.header_offset + 30 + name + extra
                    yield archive, m.filename, m.compress_type == _DEFLATED, content[start:start + m.compress_size], m.CRC, None
                else:
                    yield archive, m.filename, False, z.read(m), m.CRC, None
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error, struct.error) as e:
        yield archive, None, None, None, None, f"Cannot be read as a zip archive: {e}"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            for member in _cut(path.as_py(), content.as_py() or b""):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(member, _MEMBER)], schema=_MEMBER)


def _text(data: bytes, deflated: bool, crc: int) -> Iterator[str]:
    """Decoded text chunk by chunk; bytes that are not UTF-8 become replacement characters. Raises at the end if the checksum differs."""
    decoder, seen = codecs.getincrementaldecoder("utf-8-sig")("replace"), 0
    for chunk in _inflated(data) if deflated else (data[at:at + _CHUNK] for at in range(0, len(data), _CHUNK)):
        seen = zlib.crc32(chunk, seen)
        yield decoder.decode(chunk)
    yield decoder.decode(b"", True)
    if seen != crc:
        raise zlib.error("the checksum differs")


def _inflated(data: bytes) -> Iterator[bytes]:
    inflate = zlib.decompressobj(-zlib.MAX_WBITS)
    while data and not inflate.eof:
        yield inflate.decompress(data, _CHUNK)
        data = inflate.unconsumed_tail
    yield inflate.flush()


def _rows_of(chunks: Iterable[str]) -> Iterator[list[str]]:
    """Rows of a CSV text, as ``csvrows.read_rows`` defines them."""
    parts, row, inside = [], [], False

    def lines() -> Iterator[str]:
        nonlocal parts
        for chunk in chunks:
            *whole, rest = chunk.split("\n")
            for line in whole:
                yield "".join([*parts, line])
                parts = []
            parts.append(rest)
        yield "".join(parts)

    for line in lines():
        if not inside and line in ("", "\r"):
            continue
        row.append(line)
        inside = ends_inside(line, inside)
        if not inside:
            yield split_row("\n".join(row).removesuffix("\r"))
            row = []
    if row and row != [""]:
        yield split_row("\n".join(row).removesuffix("\r"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("__n", pa.int64()), ("__header", pa.list_(pa.string())), ("__values", pa.list_(pa.string())), ("reason", pa.string())])
    for batch in batches:
        for archive, member, deflated, data, crc in zip(*(batch.column(c) for c in ("archive", "member", "deflated", "data", "crc"))):
            held, size, header = [], 0, None
            name = (archive.as_py(), member.as_py())
            try:
                for n, row in enumerate(_rows_of(_text(data.as_py(), deflated.as_py(), crc.as_py()))):
                    if header is None:
                        header = row
                        continue
                    held.append((*name, n, header, row, None))
                    size += sum(map(len, row)) + 64
                    if size > _OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
            except zlib.error as e:
                held.append((*name, None, None, None, f"Cannot be unpacked: {e}"))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def archive_rows(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of archives (path, content).

    rows: archive, member, __n (from 1 after the header, blank lines not counted), __header, __values of the CSV members: those with ``saved`` in their path, or all
    where none has it. rejects: archive, member (null: the whole archive), reason. The task that holds an archive only cuts it
    up; packed members move to tasks of their own, where each is unpacked and parsed as a stream. Rows before a damage in a member are kept.
    """
    members = archives.select("path", "content").mapInArrow(_members, "archive string, member string, deflated boolean, data binary, crc bigint, reason string")
    dealt = members.where(F.col("member").isNotNull()).repartition("archive", "member")
    parsed = dealt.mapInArrow(_parse, "archive string, member string, __n bigint, __header array<string>, __values array<string>, reason string")
    rows = parsed.where(F.col("reason").isNull()).drop("reason")
    rejects = members.where(F.col("member").isNull()).select("archive", "member", "reason") \
        .unionAll(parsed.where(F.col("reason").isNotNull()).select("archive", "member", "reason"))
    return rows, rejects
