"""Byte-level BPE by a tree reduction over pieces: halves are encoded, neighbours joined at their border.

The pieces are the matches of a pattern; each is encoded alone. A piece is cut into leaves, leaves are merged to ids, and
two neighbours are joined by encoding a window over the border anew. The window grows until the pairs at both of
its ends are stable: a sequence of ids is the encoding of its bytes exactly when each two neighbours encode to themselves,
so ids outside a window with stable ends cannot change. Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

LEAF = 24  # bytes merged directly
PIECES = 1 << 19  # different pieces remembered by a worker


def _class(kind: str) -> str:
    """The code points of a general category as ranges of a character class."""
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code)).startswith(kind)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}" if code - 1 > start else f"\\U{start:08x}")
            start = None
    return "".join(out)


# fixed values: Unicode's White_Space
WHITE = r"\t-\r \x85\xa0  -     　"


@lru_cache(4)
def splitter(pattern: str) -> re.Pattern:
    """The pattern for the standard library: Unicode categories and white space written out as ranges."""
    letters, numbers = _class("L"), _class("N")
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if pattern[i:i + 5] in ("\\p{L}", "\\p{N}"):
            body = letters if pattern[i + 3] == "L" else numbers
            out.append(body if inside else f"[{body}]")
            i += 5
        elif two in ("\\s", "\\S"):
            if inside and two == "\\S":
                raise ValueError("\\S inside a character class")
            out.append(WHITE if inside else f"[{'^' * (two == '\\S')}{WHITE}]")
            i += 2
        else:
            step = 2 if pattern[i] == "\\" else 1
            inside = True if pattern[i] == "[" else False if pattern[i] == "]" else inside
            out.append(pattern[i:i + step])
            i += step
    return re.compile("".join(out))


class Vocabulary:
    """Ranks of byte strings; encodes and decodes pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {rank: piece for piece, rank in self.ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        get, never = self.ranks.get, len(self.ranks) + (1 << 40)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        near = [get(piece[i:i + 2], never) for i in range(len(piece) - 1)]  # ranks of the adjacent pairs
        while near:
            rank = min(near)
            if rank == never:
                break
            at = near.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(near):
                near[at] = get(parts[at] + parts[at + 1], never)
        return [self.ranks[x] for x in parts]

    def stable(self, left: int, right: int) -> bool:
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= PIECES:
                self.pairs.clear()
            self.pairs[key] = self.leaf(self.bytes[left] + self.bytes[right]) == [left, right]
        return self.pairs[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two byte strings put together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.leaf(b"".join(self.bytes[x] for x in left[len(left) - i:] + right[:j]))
            before = i == len(left) or self.stable(left[-i - 1], window[0])
            after = j == len(right) or self.stable(window[-1], right[j])
            if before and after:
                return left[:len(left) - i] + window + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        level = [self.leaf(piece[i:i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Pieces(dict):
    """piece -> (decimal ids, the bytes they decode to)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str):
        ids = self.vocabulary.encode(piece.encode("utf-8"))
        out = (" ".join(map(str, ids)), self.vocabulary.decode(ids))
        if len(piece) <= 256:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = out
        return out


@lru_cache(2)
def coder(path: str, pattern: str):
    """text -> (ids as one decimal string, the bytes they decode to). Kept, with the pieces it has seen, for the tasks that a worker runs later."""
    pieces, split = _Pieces(Vocabulary(path)), splitter(pattern)

    def run(text: str) -> tuple[str, bytes]:
        found = list(map(pieces.__getitem__, split.findall(text)))
        return " ".join([said for said, _ in found]), b"".join([raw for _, raw in found])

    run.vocabulary = pieces.vocabulary
    return run


def _ids(said: str) -> list[int]:
    return list(map(int, said.split()))


def encoder(path: str, pattern: str):
    """text -> (ids, ids as one decimal string)."""
    code = coder(path, pattern)

    def run(text: str) -> tuple[list[int], str]:
        said, _ = code(text)
        return _ids(said), said

    return run, code.vocabulary


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    ``path``: a rank file (base64 bytes, rank) that every executor can open. Null and empty texts give no tokens. Every row
    is encoded by itself (pieces seen before, in earlier tasks of the worker too, are looked up), so repeated rows, null doc_ids and other columns (not read) do not matter; an empty table
    gives an empty result. Texts of any length are handled piece by piece; a piece costs n log n.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in slices(batches, "text"):
            counts, digests, decoded, lists = [], [], [], []
            for text in batch.column("text"):
                said, raw = code(text.as_py() or "")
                counts.append(said.count(" ") + 1 if said else 0)
                digests.append(hashlib.sha256(said.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    lists.append(_ids(said))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (UTF-8, invalid bytes replaced) of rows with doc_id and ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
