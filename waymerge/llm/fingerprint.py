"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a sequence of tokens; K neighbouring tokens are a k-mer, S neighbouring tokens an s-mer. A k-mer is chosen if the least
hash among its s-mers stands at its first or last place. The choice looks at nothing outside the k-mer, so equal passages choose equal
k-mers wherever they stand: anchors for positional matching, about two in K - S + 1 places and one at least in any 2K - S - 1 tokens.

Tokens are words, cut where they are longer than LONGEST, and single characters of scripts without spaces. A text of SHORT code points at most has
anchors over its characters other than white space as well. So two texts that begin alike share an anchor if they share 13 whole words, or 17 such
characters and are both short.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymerge.plans.storage import written

K, S = 8, 2  # over words
K_CHARS, S_CHARS = 12, 6  # over characters
SHORT, LONGEST = 480, 16  # half of a longer text has 13 whole tokens of LONGEST characters and a space
# kana and ideographs; Thai, Lao, Tibetan, Myanmar and Khmer
UNSPACED = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\u0e00-\\u0fff\\u1000-\\u109f\\u1780-\\u17ff"
SPACES = "[\\s\\u00a0\\u3000]+"
WORD = f"[{UNSPACED}]|[^\\s\\u00a0\\u3000{UNSPACED}]{{1,{LONGEST}}}"
PER_PART = 20_000  # documents whose order one task settles
BELOW_ALL = Decimal(-(1 << 63) - 1)  # stands for a null doc_id


def _chosen(df: DataFrame, tokens: str, name: str, k: int, s: int) -> DataFrame:
    """df with ``name``: (at, h) of each chosen k-mer of the hashes in ``tokens``; the whole sequence where none is chosen, none where there are no tokens."""
    mers, chosen = f"{name}_s", f"{name}_c"
    inner = k - s + 1
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - s), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(s)]))
    df = df.withColumn(mers, F.when(F.size(tokens) >= s, pairs).otherwise(F.array().cast("array<bigint>")))
    at = lambda i, j: F.get(mers, i + F.lit(j))
    closed = lambda i: F.least(at(i, 0), at(i, inner - 1)) <= F.least(*[at(i, j) for j in range(1, inner - 1)])
    places = F.filter(F.sequence(F.lit(0), F.size(mers) - inner), closed)
    df = df.withColumn(chosen, F.when(F.size(mers) >= inner, places).otherwise(F.array().cast("array<int>")))
    each = F.transform(chosen, lambda i: F.struct(i.alias("at"), F.hash(*[at(i, j) for j in range(0, inner, s)]).alias("h")))
    whole = F.when(F.size(tokens) > 0, F.array(F.struct(F.lit(0).alias("at"), F.hash(tokens).alias("h")))).otherwise(F.array().cast("array<struct<at:int,h:int>>"))
    return df.withColumn(name, F.when(F.size(chosen) > 0, each).otherwise(whole)).drop(mers, chosen)


def _hashed(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w))


def words(text: Column) -> Column:
    """Hashes of the matches of WORD. Splitting at white space is several times faster than matching, so only texts of unspaced scripts and long words are matched."""
    each = F.filter(F.split(text, SPACES), lambda w: w != "")
    plain = F.flatten(F.transform(each, lambda w: F.when(F.octet_length(w) <= LONGEST, F.array(F.xxhash64(w))).otherwise(_hashed(w, WORD))))
    unspaced = (F.octet_length(text) > F.char_length(text)) & text.rlike(f"[{UNSPACED}]")
    return F.when(unspaced, _hashed(text, WORD)).otherwise(plain)


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with ``name``: array of (at, h), token position and 32-bit hash of each chosen k-mer of words in text order, and ``name``_chars: those of
    characters, for texts of SHORT code points at most. A sequence too short to have one is its own anchor at 0; a text without tokens has none."""
    t, c = f"__{name}_t", f"__{name}_u"
    whole = F.coalesce(F.col(text), F.lit(""))
    short = F.char_length(whole) <= SHORT
    df = df.withColumn(t, words(whole)).withColumn(c, F.when(short, _hashed(whole, "[^\\s\\u00a0\\u3000]")).otherwise(F.array().cast("array<bigint>")))
    return _chosen(_chosen(df, t, name, K, S), c, f"{name}_chars", K_CHARS, S_CHARS).drop(t, c)


def hashes(anchors: str) -> Column:
    """Hashes of the anchors over words, then of those over characters."""
    return F.transform(F.concat(F.col(anchors), F.col(f"{anchors}_chars")), lambda a: a["h"])


def said(values: Column) -> Column:
    """Eight hexadecimal digits an anchor, in text order."""
    return F.array_join(F.transform(values, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct hash lists; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``anchors`` and ``fingerprint``; see with_anchors. Null texts count as empty."""
    return with_anchors(docs, text, "anchors").withColumn("fingerprint", said(hashes("anchors")))


def successors(ids: DataFrame) -> DataFrame:
    """id, next: the next greater different id, the least after the greatest. Ids are split into ranges, each ordered by a task of its own."""
    n = ids.agg(F.count_distinct("id")).first()[0]
    parts = max(1, -(-n // PER_PART))
    ranged = written(ids.distinct().repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))  # one row a range
    wrap = firsts.agg(F.min("first").alias("lowest"))
    over = Window.orderBy("part")
    after = firsts.crossJoin(wrap).select("part", F.coalesce(F.lead("first").over(over), "lowest").alias("then"))
    own = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return ranged.join(after, "part").select("id", F.coalesce(own, "then").alias("next"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, in
    ascending doc_id, the first document following the last; a single document follows itself. Null texts count as empty; two empty fingerprints are alike (1.0).
    Rows that repeat a doc_id follow each other's id alike; as a next document their least text stands for them. A null doc_id counts as one that is smaller than all
    others. Other columns are not read; an empty table gives an empty result.
    """
    given = F.col("doc_id").cast("bigint")
    rows = docs.select(F.coalesce(given.cast("decimal(20,0)"), F.lit(BELOW_ALL).cast("decimal(20,0)")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = written(successors(rows.select("id")), "order")
    needs = rows.select("id", F.floor(F.char_length("text") / 2).alias("half")).groupBy("id").agg(F.max("half").alias("half"))
    before = written(order.join(needs, "id").select(F.col("next").alias("id"), F.col("id").alias("for"), "half"), "before")
    # the only shuffle of whole texts: both joins below read it
    placed = with_anchors(rows, "text", "anchors").select("id", "text", hashes("anchors").alias("own")).repartition("id")
    tails = placed.join(before, "id").select(F.col("for").alias("id"), F.struct(F.expr("left(text, int(half))").alias("tail"), F.array_distinct("own").alias("own")).alias("then"))
    tails = tails.groupBy("id").agg(F.min("then").alias("then"))
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), F.expr("left(then.tail, int(char_length(text) div 2))"))
    doc_id = F.when(F.col("id") > BELOW_ALL, F.col("id").cast("bigint")).alias("doc_id")
    both = placed.join(tails, "id").select(doc_id, n.cast("bigint").alias("n_chars"), "own", F.col("then.own").alias("next_own"), edited.alias("edited"))
    both = with_anchors(both, "edited", "edited_anchors").withColumn("edited_own", hashes("edited_anchors"))
    mine = F.array_distinct("own")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), said(F.col("own")).alias("fingerprint"), said(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(mine, F.array_distinct("edited_own")).alias("near_edited"), likeness(mine, F.col("next_own")).alias("near_next"))
