"""Numbering, top-k, retention and batch plans.

A plain window sends each key to one task. Where one key may hold a large share
of the rows, ``numbered`` splits it by an ordered bucket and adds the counts of
the earlier buckets, so the sort of a hot key is spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


HOT_ROWS = 1_000_000  # rows of a key from which it is cut into slices
SLICES = 64


def with_slices(df: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Add ``__slice``: how many of the 63 inner 64-quantiles of its key's times ``at`` lie below a row's. A slice has about one in 64 of a key's
    rows; rows of one instant share one. The cuts (63 numbers a key) are broadcast, so keys must be few."""
    rows = df.withColumn("__instant", F.unix_micros(at.cast("timestamp")))
    shares = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("__instant", shares, 10_000).alias("__cuts"))
    joined = rows.alias("r").join(F.broadcast(cuts).alias("c"), _same_keys("r", "c", keys), "left").select("r.*", "c.__cuts")
    below = F.size(F.filter("__cuts", lambda c: c < F.col("__instant")))
    return joined.withColumn("__slice", F.coalesce(below, F.lit(0))).drop("__cuts", "__instant")


def running_sums(
    df: DataFrame, keys: Sequence[str], at: str, order: Sequence[Column], sums: dict[str, Column], counts: DataFrame,
    descending: bool = False, most: int = HOT_ROWS,
) -> DataFrame:
    """Add running sums per key in an order that starts with the time ``at``, each row's own value included.

    Keys of up to ``most`` rows by ``counts`` (keys, n) are ordered as they are, larger ones in slices of time. There is at most one larger key in ``most`` rows,
    so their list is broadcast; without one their part of the plan is dropped at run time.
    """
    large = F.broadcast(counts.where(F.col("n") > most).select(*keys))
    parted = lambda how: df.alias("r").join(large.alias("c"), _same_keys("r", "c", keys), how)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    calm = parted("left_anti").withColumns({out: F.sum(c).over(inside) for out, c in sums.items()})
    hot = prefix_sums(with_slices(parted("left_semi"), keys, F.col(at)), keys, order, sums, F.col("__slice"), descending)
    return calm.unionByName(hot.select(*calm.columns))


def _same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    return _all_equal([(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in keys])


def _all_equal(pairs: Sequence[tuple[Column, Column]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & a.eqNullSafe(b)
    return cond


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], bucket: Column, descending: bool = False,
) -> DataFrame:
    """Add running sums per key in the given order, each row's own value included.

    Rows are ordered within their bucket only; the totals of earlier buckets come from an aggregate. ``bucket`` must be
    monotone in the order (``descending`` when it falls as rows advance).
    """
    keys = list(keys)
    df = df.withColumns({"__bucket": bucket, **{f"__v_{out}": c for out, c in sums.items()}})
    first = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    before = Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    right = {k: f"__r_{k}" for k in [*keys, "__bucket"]}
    totals = df.groupBy(*keys, "__bucket").agg(*[F.sum(f"__v_{out}").alias(f"__t_{out}") for out in sums])
    offsets = totals.select(
        *[F.col(k).alias(v) for k, v in right.items()], *[F.coalesce(F.sum(f"__t_{out}").over(before), F.lit(0)).alias(f"__o_{out}") for out in sums])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumns({f"__v_{out}": F.sum(f"__v_{out}").over(inside) for out in sums})
    joined = own.join(offsets, _all_equal([(F.col(k), F.col(v)) for k, v in right.items()]))
    return joined.withColumns({out: F.col(f"__v_{out}") + F.col(f"__o_{out}") for out in sums}) \
        .drop("__bucket", *right.values(), *[f"__{x}_{out}" for x in "vo" for out in sums])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str,
    bucket: Column | None = None, descending: bool = False,
) -> DataFrame:
    """1..n per key in the given order. ``bucket`` must be monotone in that order
    (``descending`` when it falls as rows advance)."""
    if bucket is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return prefix_sums(df, keys, order, {out: F.lit(1)}, bucket, descending).withColumn(out, F.col(out).cast("int"))


def first_per_key(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """First row per key; an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.col(ordinal)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def keep_last(df: DataFrame, time: str, tie: str, n: int = 1000) -> DataFrame:
    """Newest ``n`` rows (a per-partition top-n, then a merge)."""
    return df.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def keep_last_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str, n: int, most: int = HOT_ROWS) -> DataFrame:
    """Newest ``n`` rows per key. Days are counted first, so only those that can hold one of the ``n`` rows are
    ordered; a crowded day is ordered in slices."""
    keys = list(keys)
    dated = df.withColumn("__day", F.date_trunc("day", F.col(time)))
    newer = Window.partitionBy(*keys).orderBy(F.col("__day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = dated.groupBy(*keys, "__day").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("__newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("__newer") < n).select(*keys, "__day", "__newer", "n")
    held = dated.alias("r").join(days.alias("d"), _same_keys("r", "d", [*keys, "__day"])).select("r.*", "d.__newer")
    ranked = running_sums(held, [*keys, "__day"], time, [F.col(time).desc(), F.col(tie).desc()], {"__rank": F.lit(1)}, days, True, most)
    return ranked.where(F.col("__rank") + F.col("__newer") <= n).select(*df.columns)


def review_order(matches: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """Sort for review: confidence, name, status or created (verification time)."""
    statuses = ["pending", "accepted", "rejected", "manual"]
    keys = {
        "confidence": F.col("confidenceScore"),
        "name": F.collate(F.coalesce(F.get_json_object("targetPlaceData", "$.name"), F.lit("")), "UNICODE"),
        "status": F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("verificationStatus")),
        "created": F.coalesce(F.col("verifiedAt"), F.lit("1970-01-01").cast("timestamp")),
    }
    key = keys[by]
    return matches.orderBy(key.asc() if ascending else key.desc(), F.col("id"))


def newest_first(df: DataFrame, time: str, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(tie))


def retain_within_budget(
    entries: DataFrame, now: Column, max_size: int = 50 * 1024 * 1024, max_count: int = 10_000,
    tenant: Sequence[str] = (), most: int = HOT_ROWS,
) -> DataFrame:
    """Drop expired entries, then keep the most recently used ones while their
    running size and count stay within budget (per tenant when given).

    Hours of use are summed first. Only rows of the hours in which a limit could be
    crossed are kept and ordered row by row, a crowded hour in slices; hours wholly past the limit drop out early.
    """
    keys = list(tenant) or ["__all"]
    live = entries.where(F.col("expiresAt") >= now)
    if not tenant:
        live = live.withColumn("__all", F.lit(0))
    live = live.withColumn("__hour", F.date_trunc("hour", F.col("lastAccessedAt")))
    earlier = Window.partitionBy(*keys).orderBy(F.col("__hour").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    hours = (
        live.groupBy(*keys, "__hour")
        .agg(F.sum("size").alias("__size"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__size_before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .withColumn("__n_before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .where((F.col("__size_before") <= max_size) & (F.col("__n_before") < max_count))
        .select(*keys, "__hour", "__size_before", "__n_before", "__n")
    )
    kept = live.join(hours, [*keys, "__hour"])
    run = running_sums(
        kept, [*keys, "__hour"], "lastAccessedAt", [F.col("lastAccessedAt").desc(), F.col("key")], {"__run_size": F.col("size"), "__run_n": F.lit(1)},
        hours.withColumnRenamed("__n", "n"), True, most)
    within = (F.col("__run_size") + F.col("__size_before") <= max_size) & (F.col("__run_n") + F.col("__n_before") <= max_count)
    return run.where(within).select(*entries.columns)


def drop_tagged(entries: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Entries that carry none of ``tags``."""
    hit = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    return entries.where(~F.coalesce(hit, F.lit(False)))


def batch_plan(members: DataFrame, caps: DataFrame, requested_size: int = 10) -> DataFrame:
    """Batch numbers for the places of each pack (columns packId, placeId, tier).

    Packs above their tier's places-per-session cap are rejected from counts alone;
    only packs within the cap are ordered, so no window sees an oversized pack.
    """
    totals = members.groupBy("packId", "tier").agg(F.count(F.lit(1)).alias("totalPlaces"))
    judged = totals.join(caps, "tier").select(
        "packId", "totalPlaces",
        (F.col("totalPlaces") > F.col("maxPlacesPerSession")).alias("rejected"),
        F.least(F.lit(requested_size), F.col("maxBatchSize")).alias("batchSize"),
    )
    planned = members.join(judged.where(~F.col("rejected")), "packId")
    order = Window.partitionBy("packId").orderBy("placeId")
    batch = F.floor((F.row_number().over(order) - 1) / F.col("batchSize")).cast("int") + 1
    accepted = planned.select("packId", "placeId", batch.alias("batch"), "totalPlaces", "rejected")
    refused = judged.where("rejected").select(
        "packId", F.lit(None).cast("string").alias("placeId"), F.lit(None).cast("int").alias("batch"),
        "totalPlaces", "rejected",
    )
    return accepted.unionByName(refused)
