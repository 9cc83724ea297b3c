"""Secret scan over a trigram inverted index.

Each rule's pattern is turned into a Boolean query of trigrams that every match must hold. The trigrams that any query
names are indexed (trigram -> documents), postings are intersected per document, and only rules whose query holds are
verified by their pattern. A rule without mandatory trigrams is verified on every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymerge.plans.storage import written

from .common import slices, widened


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds runs leftmost and non-overlapping; a match counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either(word: str) -> str:
    """The word with ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# fixed values: base rules
ASSIGN = "(" + "|".join(map(either, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]+", 0, 20), Rule("hex", r"[0-9a-f]+", 0, 24))
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("codehost", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED

SETS = 64  # strings followed exactly per part of a pattern


def trigram_query(pattern: str) -> tuple | None:
    """Nested ("and" | "or", parts...) over lower-case trigrams that every match of the pattern holds; None if there are none."""
    _, query = _follow(parser.parse(pattern))
    return query


def _both(a, b):
    parts = [x for x in (a, b) if x is not None]
    return None if not parts else parts[0] if len(parts) == 1 or parts[0] == parts[1] else ("and", *parts)


def _of(exact: set[str] | None):
    """What a part that matches just these strings demands."""
    if exact is None or not exact or any(len(x) < 3 for x in exact):
        return None
    alternatives = [("and", *dict.fromkeys(x[i:i + 3] for i in range(len(x) - 2))) for x in sorted(exact)]
    return alternatives[0] if len(alternatives) == 1 else ("or", *alternatives)


def _follow(tree) -> tuple[set[str] | None, tuple | None]:
    """(the strings a sequence matches, or None if too many; a query its matches obey beyond them). Strings are lower-cased."""
    run, query, whole = {""}, None, True
    for op, arg in tree:
        exact, demand = _one(op, arg)
        if exact is not None and len(run) * len(exact) <= SETS:
            run = {a + b for a in run for b in exact}
        else:
            query = _both(_both(query, _of(run)), demand)
            run, whole = exact or {""}, False
    return (run, query) if whole else (None, _both(query, _of(run)))


def _one(op, arg) -> tuple[set[str] | None, tuple | None]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, None
    if op is C.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                found.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (found, None) if len(found) <= 8 else (None, None)
    if op is C.AT:
        return {""}, None
    if op is C.SUBPATTERN:
        return _follow(arg[3])
    if op is C.BRANCH:
        branches = [_follow(b) for b in arg[1]]
        if all(exact is not None for exact, _ in branches):
            union = set().union(*(exact for exact, _ in branches))
            if len(union) <= SETS:
                return union, None
        demands = [_both(_of(exact), query) for exact, query in branches]
        return None, None if any(d is None for d in demands) else ("or", *demands)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, sub = arg
        exact, query = _follow(sub)
        if high == 1 and low == 0:
            return (exact | {""}, None) if exact is not None else (None, None)
        if low == 0:
            return None, None
        return (exact, query) if low == high == 1 else (None, _both(_of(exact), query))
    return None, None


def trigrams(query: tuple | None) -> set[str]:
    return set() if query is None else {t for part in query[1:] for t in ({part} if isinstance(part, str) else trigrams(part))}


def _holds(query: tuple, bits: dict[str, int]) -> Column:
    """The query over the columns mask0, mask1, ... of 62 trigrams each."""
    parts = [(F.col(f"mask{bits[p] // 62}").bitwiseAND(F.lit(1 << bits[p] % 62)) != 0) if isinstance(p, str) else _holds(p, bits) for p in query[1:]]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if query[0] == "and" else out | part
    return out


def build_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the wanted trigrams over whole lower-cased texts; null doc_ids have none."""
    low = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, rules (bits of the rules whose trigram query the document's postings fulfil)."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    bits = {t: i for i, t in enumerate(wanted)}
    number = F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*[F.lit(i) for i in range(len(wanted))]))[F.col("trigram")]
    masks = index.select("doc_id", number.alias("n")).groupBy("doc_id").agg(*[
        F.bit_or(F.when(F.floor(F.col("n") / 62) == j, F.expr("shiftleft(1L, n % 62)")).otherwise(0)).alias(f"mask{j}") for j in range(len(wanted) // 62 + 1)])
    chosen = F.lit(0)
    for k, q in enumerate(queries):
        if q is not None:
            chosen = chosen + F.when(_holds(q, bits), F.lit(1 << k)).otherwise(F.lit(0))
    return masks.select("doc_id", chosen.alias("rules")).where("rules != 0")


def _finders(rules: tuple[Rule, ...]):
    """Per rule: text -> spans that count. A rule that is one repeated class finds its runs of enough characters at once."""
    out = []
    for r in rules:
        run = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
        pattern = re.compile(f"{run[1]}{{{r.least},}}" if run and not r.group else r.pattern)
        out.append(lambda text, p=pattern, r=r: [(m.start(), m.end()) for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least])
    return out


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], mark: str | None) -> DataFrame:
    """docs' columns and ``__spans``; with ``mark``, the spans' texts are replaced by it."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    always = sum(1 << k for k, q in enumerate(queries) if q is None)
    found = candidates(written(build_index(docs, wanted), "secret-index"), rules).toDF("__doc", "__rules")
    joined = docs.join(found, F.col("doc_id").cast("bigint") == F.col("__doc"), "left").drop("__doc")
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = _finders(rules)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, masks = batch.column("doc_id").to_pylist(), batch.column("__rules").to_pylist()
            spans = []
            for i, (text, doc, mask) in enumerate(zip(texts, ids, masks)):
                mask = always | (mask or 0) if doc is not None else -1
                own = [(a, k, b) for k, find in enumerate(finders) if text and mask >> k & 1 for a, b in find(text)]
                own.sort()
                spans.append([{"kind": kinds[k], "start": a, "end": b} for a, k, b in own])
                if mark is not None and own:
                    texts[i] = _marked(text, own, mark)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "__rules"}
            if mark is not None:
                columns["text"] = pa.array(texts, pa.string())
            columns["__spans"] = pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(run, widened(docs.schema, "__spans array<struct<kind:string,start:bigint,end:bigint>>"))


def _marked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive; by start, then kind as listed) per row.

    Null and empty texts have no spans. Rows with a null doc_id cannot be in the index and are verified by every rule. Repeated
    doc_ids share their postings, so each of their rows is verified by the rules of any. An empty table gives an empty result; other columns are not read.
    """
    return _scanned(docs.select("doc_id", "text"), rules, None).select("doc_id", F.col("__spans").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, each secret's text replaced by ``mark``; overlapping spans become one mark."""
    return _scanned(docs, rules, mark).drop("__spans")


def digests(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans and all spans as text, from find_secrets."""
    kinds = [r.kind for r in base]

    def said(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*wanted: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    own = of(*kinds)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(said(own), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
