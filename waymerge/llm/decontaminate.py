"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

A window is as long as an item. It can only reach the similarity if it holds so many of the item's shingles, at whatever places of
the item, as the limit asks of the item's own. Of such windows those are laid that start with a shared shingle, and those over the start of
the text that end with one: any other can be moved to one of them without losing a shared shingle or gaining another, so
none is more similar. Fingerprints of windows and of the items they were laid for meet in a multi-index: radius + 1 blocks of bits, of which at
least one is equal if at most ``radius`` bits differ. Pairs within the radius are verified by the exact similarity of their weighted shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymerge.plans.storage import written

SIZE = 5
RADIUS = 20  # similarity 0.8 differs in 9.7 of 64 bits on average, standard deviation 2.9
SMALL = 1_000_000  # item shingles (24 bytes each) that are broadcast at most; beyond, both sides are shuffled


def word_hashes(text: str) -> Column:
    """64-bit hashes of the words: runs without ASCII white space, in lower case."""
    words = F.split(F.lower(text), "[ \t-\r]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: Column, size: int) -> Column:
    """Hashes of each ``size`` neighbouring words of a column of word hashes; empty if there are fewer."""
    at = lambda i, j: F.get(words, i + F.lit(j))
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[at(i, j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(features: Column) -> Column:
    """64 bits: the sign, over all features with their multiplicity, of each hash bit.

    Bits are counted side by side in a few sums, eight of them with a byte for each count (up to 127 features) or sixteen with two (up to 32767); beyond, bit by bit.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n)

    def signed(ones) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * ones(b) > F.size(features), F.call_function("shiftleft", one, b)).otherwise(zero))
        return F.aggregate(bits, zero, lambda a, x: a.bitwiseOR(x))

    def packed(width: int) -> Column:
        lanes = F.lit(sum(1 << at for at in range(0, 64, width))).cast("bigint")

        def summed(j: int) -> Column:
            return F.aggregate(features, zero, lambda n, x: n + right(x, F.lit(j)).bitwiseAND(lanes))

        def read(sums: Column) -> Column:
            return signed(lambda b: right(F.get(sums, b % width), (F.floor(b / width) * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1)))

        # the sums are made once and then read for each bit
        return F.get(F.transform(F.array(F.array(*[summed(j) for j in range(width)])), read), F.lit(0))

    counted = signed(lambda b: F.aggregate(features, F.lit(0), lambda n, x: n + right(x, b).bitwiseAND(F.lit(1)).cast("int")))
    return F.when(F.size(features) < 128, packed(8)).when(F.size(features) < 32768, packed(16)).otherwise(counted)


def _blocks(fingerprint: str, radius: int) -> Column:
    """(number, bits) of radius + 1 blocks."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    bits = [F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.struct(F.lit(i).alias("block"), x.alias("bits")) for i, x in enumerate(bits)])


def weights_shared(a: Column, b: Column) -> tuple[Column, Column]:
    """(sum of least, sum of greatest) multiplicities over all shingles of two lists."""
    def times(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    least = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return least, F.size(a) + F.size(b) - least


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, words, size (of shingles: 5, or the words of a shorter item), sh, m (words), fp; items without words are left out. Items of equal words keep the least item_id."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), word_hashes("text").alias("words")).where("size(words) > 0")
    rows = rows.groupBy("words").agg(F.min("item_id").alias("item_id")).withColumn("m", F.size("words")).withColumn("size", F.least("m", F.lit(SIZE)))
    sh = F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("words"), k)) for k in range(1, SIZE + 1)])
    return rows.withColumn("sh", sh).select("item_id", "m", "size", "sh").withColumn("fp", simhash(F.col("sh")))


KEY = ["k1", "k2"]
WINDOW = [*KEY, "m", "start"]
REGION = 4096  # words


def window_starts(places: Column, m: Column, size: int, percent: int) -> Column:
    """Starts of windows of m words worth a look, given the ascending places where a text has a shingle of the item."""
    span = m - size + 1  # shingles of the item, and of a window inside the text
    need = F.ceil(span * percent / 100).cast("int")
    place = lambda i: F.get(places, i)
    last = F.sequence(need - 1, F.size(places) - 1)
    inside = F.transform(F.filter(last, lambda i: place(i) - place(i - need + 1) < span), lambda i: place(i - need + 1))
    over = F.transform(F.filter(last, lambda i: place(i) < span - 1), lambda i: place(i) - span + 1)
    return F.when(F.size(places) >= need, F.concat(inside, over)).otherwise(F.array().cast("array<int>"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts under a key of 96 bits, so that equal texts are judged once."""
    return docs.where("text is not null").select(F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "text")


def _width(df: DataFrame) -> int:
    """Tasks for a step that computes much on few bytes, which merging small partitions at run time would leave to a few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _window_prints(texts: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """k1, k2, m, start, own (the window's shingles), wfp: every window once, cut from its text before it moves.

    The windows of a text are cut in groups of those that start within REGION words of each other.
    """
    region = F.floor(F.col("start") / REGION)
    groups = links.select(*WINDOW).distinct().groupBy(*KEY, region.alias("region")).agg(F.collect_list(F.struct("m", "start")).alias("ws"))
    holders = texts.join(links.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))

    def cut(w: Column) -> Column:
        first = F.greatest(w["start"], F.lit(0))
        return F.struct(w["m"].alias("m"), w["start"].alias("start"), F.slice("words", first + 1, w["start"] + w["m"] - first).alias("own"))

    split = holders.select(*KEY, word_hashes("text").alias("words")).join(groups, KEY)
    cuts = split.select(*KEY, F.explode(F.transform("ws", cut)).alias("w")).select(*KEY, "w.*")
    spread = cuts.repartition(_width(cuts), *WINDOW).select(*WINDOW, shingles(F.col("own"), size).alias("own"))
    return spread.withColumn("wfp", simhash(F.col("own")))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """k1, k2, item_id, similarity: the items that a text holds, by text."""
    items = written(item_table(benchmark), "items")
    sizes = [r.size for r in items.select(F.col("size")).distinct().collect()]  # five values at most
    postings = written(items.select("item_id", "m", "size", F.explode("sh").alias("h")).distinct(), "postings")
    if (items.agg(F.sum(F.size("sh"))).first()[0] or 0) <= SMALL:
        postings = F.broadcast(postings)
    texts = _keyed(docs)
    none = docs.sparkSession.createDataFrame([], "k1 bigint, k2 int, item_id bigint, similarity double")
    found = none
    for size in sorted(sizes):
        parts = texts.select(*KEY, word_hashes("text").alias("words")).select(*KEY, F.posexplode(shingles(F.col("words"), size)).alias("pos", "h"))
        hits = parts.join(postings.where(F.col("size") == size), "h")
        places = hits.groupBy(*KEY, "item_id", "m").agg(F.sort_array(F.collect_set("pos")).alias("places"))
        links = written(places.select(*KEY, "item_id", "m", F.explode(window_starts(F.col("places"), F.col("m"), size, percent)).alias("start")), "windows")
        laid = written(_window_prints(texts, links, size), "prints")
        # a window meets the items it was laid for, on the blocks that its fingerprint shares with theirs
        blocked = links.join(laid.select(*WINDOW, "wfp"), WINDOW).withColumn("b", F.explode(_blocks("wfp", radius)))
        targets = items.where(F.col("size") == size).select("item_id", "fp", F.explode(_blocks("fp", radius)).alias("b"))
        near = blocked.join(targets, ["item_id", "b"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= radius).select(*WINDOW, "item_id").distinct()
        near = near.join(laid.select(*WINDOW, "own"), WINDOW).join(items.select("item_id", "sh"), "item_id").select(*KEY, "item_id", "own", "sh").distinct()
        near = near.repartition(_width(near), *KEY, "item_id", "own")
        least, greatest = weights_shared(F.col("own"), F.col("sh"))
        exact = near.select(*KEY, "item_id", least.alias("least"), greatest.alias("greatest")).where(100 * F.col("least") >= percent * F.col("greatest"))
        found = found.union(exact.select(*KEY, "item_id", (F.col("least") / F.col("greatest")).alias("similarity")))
    return found.groupBy(*KEY, "item_id").agg(F.max("similarity").alias("similarity"))


def _judged(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """k1, k2, n_items, item_id, similarity of texts that hold an item; the item is the most similar, then the least id."""
    best = F.max(F.struct("similarity", (-F.col("item_id")).alias("id"))).alias("best")
    judged = contaminated_texts(docs, benchmark, **how).groupBy(*KEY).agg(F.count("*").alias("n_items"), best)
    return judged.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "n_items", (-F.col("best.id")).alias("item_id"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_id (most similar item; null if none), similarity (its, 0 if none).

    Similarity of a window and an item: weighted Jaccard of their five-word shingles, weights being multiplicities; items of fewer
    words are compared as one shingle. ``percent`` is the least similarity. Null and empty texts hold nothing. Rows of equal text get equal results; doc_ids may
    be null or repeat; benchmark rows with null or empty text are no items; empty tables and other columns do no harm.
    """
    judged = _judged(docs, benchmark, **how)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("__k1"), F.hash("text").alias("__k2"))
    return rows.join(judged, ["__k1", "__k2"], "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), "item_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    judged = _judged(docs, benchmark, **how)
    return docs.join(judged, (F.xxhash64("text") == F.col("__k1")) & (F.hash("text") == F.col("__k2")), "left_anti")
