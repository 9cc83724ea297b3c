"""Automation quotas: caps, verdicts and usage rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dates import seconds_to_next_day
from .windows import HOT_ROWS, running_sums, top_k

# --- fixed values -----------------------------------------------------------
# tier: places per session, batch size, day cap, minute cap.
CAPS = {"free": (10, 10, 1, 1), "premium": (100, 10, 10, 10)}
# ----------------------------------------------------------------------------

TIERS = tuple(CAPS)


def caps_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, *v) for t, v in CAPS.items()],
        "tier string, maxPlacesPerSession int, maxBatchSize int, dailyCap int, perMinuteCap int")


def _cap(position: int) -> Column:
    table = F.create_map(*[F.lit(x) for t, v in CAPS.items() for x in (t, v[position])])
    return F.element_at(table, F.col("tier"))


def verdict_columns(day_count: Column, minute_count: Column, ts: Column) -> dict[str, Column]:
    """Outcome of a call from its running counts; the minute cap is tested first."""
    day_cap, minute_cap = _cap(2), _cap(3)
    over_minute, over_day = minute_count > minute_cap, day_count > day_cap
    left = lambda cap, n: F.greatest(cap - n, F.lit(0)).cast("int")
    return {
        "allowed": ~over_minute & ~over_day,
        "reason": F.when(over_minute, "minute").when(over_day, "daily"),
        "retryAfterSeconds": F.when(over_minute, 60).when(over_day, seconds_to_next_day(ts)),
        "remainingDaily": left(day_cap, day_count),
        "remainingMinute": F.when(~over_minute & over_day, minute_cap).otherwise(left(minute_cap, minute_count)).cast("int"),
    }


def running_counts(calls: DataFrame, prior: DataFrame | None = None, most: int = HOT_ROWS) -> DataFrame:
    """Calls (callId, tier, userId, ts) with their running day and minute counts.

    Two levels: calls are numbered inside (tier, user, minute); the minutes of a day are
    counted by an aggregate and summed. A user with very many calls is spread over minutes, a minute
    of more than ``most`` calls over slices of it, and a refused call still counts. ``prior`` holds counts of earlier calls (tier, userId, minute, n).
    """
    keys = ["tier", "userId"]
    timed = calls.withColumn("minute", F.date_trunc("minute", "ts"))
    counted = timed.groupBy(*keys, "minute").agg(F.count(F.lit(1)).alias("n"))
    per = counted.withColumn("old", F.lit(0).cast("bigint"))
    if prior is not None:
        per = per.unionByName(
            prior.select(*keys, "minute", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("old"))
        ).groupBy(*keys, "minute").agg(F.sum("n").alias("n"), F.sum("old").alias("old"))
    day = Window.partitionBy(*keys, F.date_trunc("day", "minute"))
    earlier = day.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    # earlier counts of the whole day precede every call of this batch
    per = per.withColumns({
        "__day_before": F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.sum("old").over(day),
        "__minute_before": F.col("old"),
    }).where(F.col("n") > 0).drop("n", "old")
    order = [F.col("ts"), F.col("callId")]
    return (
        running_sums(timed, [*keys, "minute"], "ts", order, {"__rn": F.lit(1)}, counted, most=most).join(per, [*keys, "minute"])
        .withColumns({
            "dayCount": F.col("__rn") + F.col("__day_before"), "minuteCount": F.col("__rn") + F.col("__minute_before")})
        .drop("__rn", "__day_before", "__minute_before")
    )


def quota_verdicts(calls: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Replay the access log and judge each call."""
    counted = running_counts(calls, prior)
    return counted.withColumns(verdict_columns(F.col("dayCount"), F.col("minuteCount"), F.col("ts"))).drop("minute")


def usage_by_user(calls: DataFrame, day: str) -> DataFrame:
    """Calls per (tier, user) on a day."""
    start = F.lit(day).cast("timestamp")
    today = (F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY"))
    return calls.where(today).groupBy("tier", "userId").agg(F.count(F.lit(1)).alias("count"))


def usage_today(calls: DataFrame, day: str) -> DataFrame:
    """Total per tier and overall (tier NULL)."""
    return usage_by_user(calls, day).rollup("tier").agg(F.sum("count").alias("count"))


def top_users(calls: DataFrame, day: str, k: int = 5) -> DataFrame:
    return top_k(usage_by_user(calls, day), [F.col("count").desc(), F.col("tier"), F.col("userId")], k)


def _last_days(spark: SparkSession, day: str, n: int) -> DataFrame:
    end = F.to_date(F.lit(day))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("date"))


def weekly_series(calls: DataFrame, day: str, n: int = 7) -> DataFrame:
    """Zero-filled daily calls per tier and in total for the last ``n`` days."""
    end = F.lit(day).cast("timestamp")
    recent = calls.where((F.col("ts") >= end - F.expr(f"INTERVAL {n - 1} DAYS")) & (F.col("ts") < end + F.expr("INTERVAL 1 DAY")))
    counts = recent.groupBy(F.to_date("ts").alias("date")).pivot("tier", list(TIERS)).agg(F.count(F.lit(1)))
    filled = _last_days(calls.sparkSession, day, n).join(counts, "date", "left")
    zero = F.lit(0).cast("bigint")
    return filled.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), *[F.coalesce(t, zero).alias(t) for t in TIERS],
        sum((F.coalesce(t, zero) for t in TIERS[1:]), F.coalesce(TIERS[0], zero)).alias("total"))


def user_weekly_series(calls: DataFrame, day: str, n: int = 7) -> DataFrame:
    """Zero-filled daily calls of every user seen in the log, with the day cap; ready for ``write.csv``."""
    end = F.lit(day).cast("timestamp")
    recent = calls.where((F.col("ts") >= end - F.expr(f"INTERVAL {n - 1} DAYS")) & (F.col("ts") < end + F.expr("INTERVAL 1 DAY")))
    counts = recent.groupBy("tier", "userId", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    last = F.to_date(F.lit(day))
    # each user's own seven days, exploded beside the user: no product with a day table
    spine = calls.select("tier", "userId").distinct().withColumn("date", F.explode(F.sequence(F.date_sub(last, n - 1), last)))
    return spine.join(counts, ["tier", "userId", "date"], "left").select(
        "tier", "userId", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), _cap(2).alias("dailyCap"))


def minute_usage(calls: DataFrame) -> DataFrame:
    """Calls per user and minute against the minute cap."""
    return calls.groupBy("tier", "userId", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("count")).withColumn("minuteCap", _cap(3))
