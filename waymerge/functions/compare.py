"""Edits and shared words of many pairs of names at once, on arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

_MOST = 1 << 22  # entries of a table that a batch may make; beyond that it is halved
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")  # what \s is to Spark
_ONE = np.uint64(1)
_LONG = 40  # letters of a word whose pieces are not listed


def _long_edits(a: str, b: str) -> int:
    """Edits between two strings of any length, a column of the table as the bits of two numbers."""
    seat: dict[str, int] = {}
    for i, x in enumerate(a):
        seat[x] = seat.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    up, down = whole, 0
    for y in b:
        eq = seat.get(y, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        high, low = down | ~(d | up), up & d
        high, low = (high << 1) | 1, low << 1
        up, down = (low | ~(x | high)) & whole, high & x & whole
    return len(b) + up.bit_count() - down.bit_count()


def edits(names: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distance of ``names[a]`` and ``names[b]``, by code points.

    One bit-parallel step (Myers, Hyyrö) takes a character of all longer names against all 64 places of the shorter ones.
    """
    size = np.fromiter(map(len, names), np.int64, len(names))
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = np.empty(len(a), np.int64)
    wide = size[a] > 64
    for i in np.flatnonzero(wide):
        out[i] = _long_edits(names[a[i]], names[b[i]])
    rest = np.flatnonzero(~wide)
    if len(rest):
        out[rest] = _short_edits(names, size, a[rest], b[rest])
    return out


def _short_edits(names: list[str], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short, row = np.unique(a, return_inverse=True)
    held, line = np.unique(b, return_inverse=True)
    text = lambda ids: np.frombuffer("".join(names[i] for i in ids).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, code = np.unique(text(short), return_inverse=True)
    n = len(letters) + 1  # the last letter is any other
    if len(short) * n > _MOST and len(a) > 1:
        half = len(a) // 2
        return np.concatenate([_short_edits(names, size, a[:half], b[:half]), _short_edits(names, size, a[half:], b[half:])])
    seats = np.zeros(len(short) * n, np.uint64)
    starts, lengths = np.cumsum(size[short]) - size[short], size[short]
    for j in range(int(lengths.max(initial=0))):
        has = np.flatnonzero(lengths > j)
        seats[has * n + code[starts[has] + j]] |= _ONE << np.uint64(j)
    ends = text(held)
    at = np.minimum(np.searchsorted(letters, ends), max(n - 2, 0))
    found = np.where(letters[at] == ends, at, n - 1) if n > 1 else np.zeros(len(ends), np.int64)
    longer = np.cumsum(size[held]) - size[held]
    order = np.argsort(-size[b], kind="stable")
    row, line, steps, m = row[order] * n, longer[line[order]], size[b][order], size[a][order]
    up, down = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    ending = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")  # how many names are longer than j
    eqs, xs, ds, highs = (np.empty(len(a), np.uint64) for _ in range(4))
    for j, k in enumerate(ending):
        vp, vn, eq, x, d, high = up[:k], down[:k], eqs[:k], xs[:k], ds[:k], highs[:k]
        np.take(seats, row[:k] + found[line[:k] + j], out=eq, mode="clip")
        np.bitwise_or(eq, vn, out=x)
        np.bitwise_and(eq, vp, out=d)
        d += vp
        d ^= vp
        d |= eq
        np.bitwise_or(d, vp, out=high)
        np.invert(high, out=high)
        high |= vn
        vp &= d
        high <<= _ONE
        high |= _ONE
        vp <<= _ONE
        np.bitwise_and(high, x, out=vn)
        x |= high
        np.invert(x, out=x)
        vp |= x
    kept = np.where(m > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(m, 1).astype(np.uint64)), np.uint64(0))
    out = np.empty(len(a), np.int64)
    out[order] = steps + np.bitwise_count(up & kept).astype(np.int64) - np.bitwise_count(down & kept).astype(np.int64)
    return out


@lru_cache(1 << 15)
def _pieces(word: str) -> frozenset[str]:
    n = len(word)
    return frozenset(word[i:j] for i in range(n + 1) for j in range(i, n + 1))


def _holding(words: list[str], others: dict[str, int]) -> dict[str, list[str]]:
    """For each of ``words`` which of ``others`` lie inside it."""
    held = frozenset(others)
    return {w: list(_pieces(w) & held) if len(w) <= _LONG else [o for o in others if o in w] for w in words}


@lru_cache(1 << 15)
def _words(name: str) -> tuple[str, ...]:
    return tuple(_SPACE.split(name))


def _meets(word: str, name: str, words: set[str]) -> bool:
    """Whether a word holds, or lies inside, one of the name's."""
    return word in name or (not words.isdisjoint(_pieces(word)) if len(word) <= _LONG else any(v in word for v in words))


def common_words(left: list[str], right: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words of over two letters of ``left[a]`` hold, or lie inside, some word of ``right[b]``; a word that comes twice counts twice."""
    lw, rw = [[w for w in _words(x) if len(w) > 2] for x in left], [set(_words(x)) for x in right]
    mine: dict[str, int] = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lw for w in ws))}
    theirs: dict[str, int] = {w: i for i, w in enumerate(set().union(*rw))}
    most = max(map(len, lw), default=0)
    if len(mine) + len(theirs) > 4 * len(a) or max(len(right) * (len(mine) + 1), len(left) * most) > _MOST:
        return np.fromiter((sum(_meets(w, right[j], rw[j]) for w in lw[i]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
    met: dict[str, list[int]] = {v: [mine[w] for w in ws] for v, ws in _holding(list(theirs), mine).items()}
    for w, vs in _holding(list(mine), theirs).items():
        for v in vs:
            met[v].append(mine[w])
    near = np.zeros((len(right), len(mine) + 1), np.uint8)  # the last column stands for no word
    for i, ws in enumerate(rw):
        near[i, [k for v in ws for k in met[v]]] = 1
    seat = np.full((len(left), most), len(mine), np.int64)
    for i, ws in enumerate(lw):
        seat[i, :len(ws)] = [mine[w] for w in ws]
    flat, base, out = near.ravel(), b * near.shape[1], np.zeros(len(a), np.int64)
    for j in range(most):
        out += flat[base + seat[a, j]]
    return out


def compared(left: pa.Array, right: pa.Array) -> pa.Array:
    """(distance, common) of each pair of names; none where a name is null."""
    given = np.flatnonzero(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros((2, len(left)), np.int32)
    if len(given):
        l, r = (x.take(pa.array(given)).dictionary_encode() for x in (left, right))
        ln, rn = l.dictionary.to_pylist(), r.dictionary.to_pylist()
        a, b = l.indices.to_numpy().astype(np.int64), r.indices.to_numpy().astype(np.int64)
        out[0, given], out[1, given] = edits(ln + rn, a, b + len(ln)), common_words(ln, rn, a, b)
    none = np.ones(len(left), bool)
    none[given] = False
    return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["distance", "common"], mask=pa.array(none))


def name_comparison(left: Column, right: Column) -> Column:
    """Struct (distance, common) of two names, null where a side is: their edits, and ``common_words``."""
    return F.arrow_udf(compared, "struct<distance:int,common:int>")(left, right)
