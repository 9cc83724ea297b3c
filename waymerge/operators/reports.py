"""Progress, accuracy, latency, behaviour and usage reports.

Each report reads a table once with conditional aggregates. A report over several
tables tags and unions their rows, so one aggregate answers it without joining.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import pct_change, ratio_pct, round_half_up
from .windows import top_k

STATUSES = ("pending", "accepted", "rejected", "manual")
LEVELS = ("high", "medium", "low")

# --- fixed values -----------------------------------------------------------
CALIBRATION_BINS = [(0, 20), (20, 40), (40, 60), (60, 70), (70, 80), (80, 90), (90, 100)]
# ----------------------------------------------------------------------------

_NUMBERS = [
    "processingTime", "processingTimePerPlace", "apiCallsPerPlace", "cacheHitRate", "verificationTime",
    "responseTime", "batchSize", "hitRate", "missRate", "cacheSize", "evictionRate",
    "utilization", "completionRate", "queueTime",
]
_FLAGS = ["apiCall", "cacheOperation", "workerOperation", "filterUsed", "rateLimited", "errorRecovery"]
_TEXTS = ["service", "errorType"]
PAYLOAD = ", ".join(
    [f"{n} double" for n in _NUMBERS] + [f"{n} string" for n in _FLAGS + _TEXTS]
)


def parsed_events(events: DataFrame) -> DataFrame:
    """Events with ``d``: the payload parsed once. A number given as text does not count as a number."""
    return events.withColumn("d", F.from_json("data", PAYLOAD))


def _flag(name: str) -> Column:
    value = F.col("d")[name]
    return F.coalesce(~value.isin("false", "0", "0.0", "", "null"), F.lit(False))


def _count_type(*types: str) -> Column:
    return F.count_if(F.col("type").isin(*types))


def _mean(value: Column, when: Column | None = None) -> Column:
    kept = value if when is None else F.when(when, value)
    return F.coalesce(F.avg(kept), F.lit(0.0))


# --- sessions and packs -----------------------------------------------------

def session_match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("sessionId").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verificationStatus") == s).alias(s) for s in STATUSES],
        *[F.count_if(F.col("confidenceLevel") == lv).alias(f"{lv}Confidence") for lv in LEVELS],
    )


def verification_progress(matches: DataFrame) -> DataFrame:
    counts = session_match_counts(matches)
    done = F.col("accepted") + F.col("rejected") + F.col("manual")
    return counts.withColumns({
        "completed": done,
        "completionPct": F.when(F.col("total") > 0, round_half_up(done / F.col("total") * 100.0)).otherwise(0),
        "highConfidencePending": F.col("highConfidence") - done,
    })


def _item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("packId").agg(
        F.count_if(F.col("status").isin("done", "skipped")).alias("done"), F.count(F.lit(1)).alias("total"))


def _with_progress(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "pct": ratio_pct(F.col("done"), F.col("total")),
        "isComplete": (F.col("done") == F.col("total")) & (F.col("total") > 0),
    })


def progress_of_items(items: DataFrame) -> DataFrame:
    """``pack_progress`` of the packs that the items name, which are read once."""
    return _with_progress(_item_counts(items))


def pack_progress(packs: DataFrame, items: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return _with_progress(
        packs.select(F.col("id").alias("packId")).join(_item_counts(items), "packId", "left")
        .withColumns({"done": F.coalesce("done", zero), "total": F.coalesce("total", zero)})
    )


def execution_stats(sessions: DataFrame, matches: DataFrame) -> DataFrame:
    verified = matches.where(F.col("verificationStatus").isin("accepted", "manual")).groupBy("sessionId").agg(
        F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return sessions.select(F.col("id").alias("sessionId"), "status").join(verified, "sessionId", "left").select(
        "sessionId", n.alias("totalVerified"), n.alias("readyForExecution"),
        (F.col("status") == "completed").alias("alreadyExecuted"),
    )


def batch_run_summary(sessions: DataFrame, matches: DataFrame, batch_size: int = 10) -> DataFrame:
    """Per session: matches, failures, rate per second, batch i of n."""
    found = matches.groupBy("sessionId").agg(F.count(F.lit(1)).alias("n"))
    processed = F.least("totalPlaces", "processedPlaces")
    rate = F.when((F.col("processedPlaces") == 0) | (F.col("processingTimeMs") == 0), F.lit(0.0)).otherwise(
        processed / F.col("processingTimeMs") * 1000.0)
    batches = lambda c: F.ceil(c / F.lit(float(batch_size))).cast("bigint")
    return sessions.select(F.col("id").alias("sessionId"), "totalPlaces", "processedPlaces", "processingTimeMs", "errorCount") \
        .join(found, "sessionId", "left").select(
            "sessionId", "totalPlaces", processed.alias("processedPlaces"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("successfulMatches"),
            F.col("errorCount").alias("failedMatches"), rate.alias("placesPerSecond"),
            batches(processed).alias("currentBatch"), batches(F.col("totalPlaces")).alias("totalBatches"),
        )


# --- insights and trends ----------------------------------------------------

@dataclass(frozen=True)
class Period:
    start: str
    end: str

    def holds(self, time: Column) -> Column:
        return (time >= F.lit(self.start).cast("timestamp")) & (time <= F.lit(self.end).cast("timestamp"))


def _insight_rows(sessions: DataFrame, matches: DataFrame, events: DataFrame) -> DataFrame:
    s = sessions.select(
        F.lit("s").alias("kind"), F.col("createdAt").alias("at"), F.col("status"),
        F.col("processingTimeMs").cast("double").alias("ms"), F.col("totalPlaces").cast("double").alias("places"),
    )
    m = matches.join(
        sessions.select(F.col("id").alias("sessionId"), "createdAt"), "sessionId"
    ).select(F.lit("m").alias("kind"), F.col("createdAt").alias("at"),
             F.col("verificationStatus").alias("status"), F.col("confidenceLevel").alias("level"))
    e = parsed_events(events).select(
        F.lit("e").alias("kind"), F.col("timestamp").alias("at"), F.col("type").alias("status"),
        F.col("d.processingTime"), F.col("d.apiCallsPerPlace"), F.col("d.cacheHitRate"), F.col("d.verificationTime"),
    )
    return s.unionByName(m, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)


def _insight_measures(inside: Column) -> dict[str, Column]:
    kind = lambda k: inside & (F.col("kind") == k)
    n = lambda k, *st: F.count_if(kind(k) & F.col("status").isin(*st)) if st else F.count_if(kind(k))
    level = lambda lv: F.count_if(kind("m") & (F.col("level") == lv))
    perf = kind("e") & (F.col("status") == "performance_metric")
    judged = kind("e") & F.col("status").isin("match_accepted", "match_rejected") & (F.col("verificationTime") != 0)
    return {
        "totalSessions": n("s"), "completedSessions": n("s", "completed"),
        "averageSessionDuration": _mean(F.col("ms"), kind("s") & (F.col("ms") > 0)),
        "averagePlacesPerSession": _mean(F.col("places"), kind("s")),
        "completionRate": ratio_pct(n("s", "completed"), n("s")),
        "totalMatches": n("m"), "acceptedMatches": n("m", "accepted"), "rejectedMatches": n("m", "rejected"),
        "manualMatches": n("m", "manual"), "matchAccuracyRate": ratio_pct(n("m", "accepted"), n("m")),
        "highConfidenceMatches": level("high"), "mediumConfidenceMatches": level("medium"),
        "lowConfidenceMatches": level("low"),
        "averageProcessingTime": _mean(F.col("processingTime"), perf),
        "averageApiCallsPerPlace": _mean(F.col("apiCallsPerPlace"), perf),
        "cacheHitRate": _mean(F.col("cacheHitRate"), perf),
        "errorRate": ratio_pct(n("e", "error_occurred"), n("e")),
        "bulkActionsUsed": n("e", "bulk_action_performed"),
        "manualSearchesPerformed": n("e", "manual_search_performed"),
        "averageVerificationTime": _mean(F.col("verificationTime"), judged),
    }


def usage_insights(sessions: DataFrame, matches: DataFrame, events: DataFrame, period: Period) -> DataFrame:
    """One row with twenty measures of a period."""
    rows = _insight_rows(sessions, matches, events).where(period.holds(F.col("at")))
    return rows.agg(*[c.alias(k) for k, c in _insight_measures(F.lit(True)).items()])


def usage_trends(sessions: DataFrame, matches: DataFrame, events: DataFrame, current: Period, previous: Period) -> DataFrame:
    """Percentage changes of sessions, accuracy and processing time; both periods in
    one pass (an instant on a shared boundary counts in both)."""
    rows = _insight_rows(sessions, matches, events).where(current.holds(F.col("at")) | previous.holds(F.col("at")))
    measures = {
        "sessionsChange": "totalSessions", "accuracyChange": "matchAccuracyRate", "performanceChange": "averageProcessingTime"}
    now, then = _insight_measures(current.holds(F.col("at"))), _insight_measures(previous.holds(F.col("at")))
    both = rows.agg(*[now[m].cast("double").alias("now_" + k) for k, m in measures.items()],
                    *[then[m].cast("double").alias("then_" + k) for k, m in measures.items()])
    return both.select(*[pct_change(F.col("then_" + k), F.col("now_" + k)).alias(k) for k in measures])


# --- accuracy ---------------------------------------------------------------

def _accuracy() -> list[Column]:
    accepted = F.count_if(F.col("verificationStatus") == "accepted")
    return [F.count(F.lit(1)).alias("total"), accepted.alias("accepted"),
            ratio_pct(accepted, F.count(F.lit(1))).alias("accuracy")]


def _all_values(counts: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Every value of a short fixed list, with zeros where nothing was counted."""
    spark = counts.sparkSession
    base = spark.createDataFrame([(v,) for v in values], f"{column} string")
    zero = F.lit(0).cast("bigint")
    return base.join(counts, column, "left").select(
        column, F.coalesce("total", zero).alias("total"), F.coalesce("accepted", zero).alias("accepted"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def accuracy_by_level(matches: DataFrame) -> DataFrame:
    return _all_values(matches.groupBy("confidenceLevel").agg(*_accuracy()), "confidenceLevel", LEVELS)


def accuracy_by_provider(matches: DataFrame, sessions: DataFrame, packs: DataFrame) -> DataFrame:
    """Sessions meet their packs first (both are far smaller than matches)."""
    target = sessions.select(F.col("id").alias("sessionId"), "packId").join(
        packs.select(F.col("id").alias("packId"), F.col("target").alias("provider")), "packId", "left")
    # counting per session first shrinks the side that joins
    per = matches.groupBy("sessionId").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verificationStatus") == "accepted").alias("accepted"))
    counts = per.join(target, "sessionId").groupBy("provider").agg(
        F.sum("total").alias("total"), F.sum("accepted").alias("accepted"),
    ).withColumn("accuracy", ratio_pct(F.col("accepted"), F.col("total")))
    return _all_values(counts, "provider", ("apple", "google"))


def accuracy_by_category(matches: DataFrame) -> DataFrame:
    category = F.get_json_object("targetPlaceData", "$.category")
    valid = matches.where(F.try_parse_json("targetPlaceData").isNotNull())
    named = F.when((category != "") & (category != "null"), category).otherwise("Unknown")
    return valid.groupBy(named.alias("category")).agg(*_accuracy())


def overall_accuracy(matches: DataFrame) -> DataFrame:
    return matches.agg(*_accuracy())


def confidence_calibration(matches: DataFrame, closed_top: bool = False) -> DataFrame:
    """Predicted (midpoint) against actual accuracy in seven bins. A score of 100 is in
    no bin unless ``closed_top``. The bin is computed per row, so nothing joins before the count."""
    score = F.col("confidenceScore")
    bin_of = None
    for low, high in CALIBRATION_BINS:
        inside = (score >= low) & ((score < high) | (F.lit(closed_top and high == 100) & (score == high)))
        bin_of = F.when(inside, low) if bin_of is None else bin_of.when(inside, low)
    counts = matches.groupBy(bin_of.alias("bin")).agg(*_accuracy())
    bins = matches.sparkSession.createDataFrame(CALIBRATION_BINS, "rangeLow int, rangeHigh int")
    joined = bins.join(counts, F.col("rangeLow") == F.col("bin"), "left")
    predicted = (F.col("rangeLow") + F.col("rangeHigh")) / 2.0
    actual = F.coalesce("accuracy", F.lit(0.0))
    return joined.select("rangeLow", "rangeHigh", predicted.alias("predictedAccuracy"), actual.alias("actualAccuracy"),
                         F.abs(predicted - actual).alias("calibrationError"))


# --- event reports ----------------------------------------------------------

def performance_events(events: DataFrame) -> DataFrame:
    return parsed_events(events.where(F.col("type") == "performance_metric"))


WANTED = ("mid_a", "mid_b", "p95")


def _next_slices(rows: DataFrame, slices: int) -> DataFrame:
    """Cut each slice of (s, v, n, before, ranks) at approximate quantiles of its distinct values and keep the parts that hold a wanted rank.

    There are no more slices than wanted ranks, so their cuts and totals are a few rows.
    """
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = rows.groupBy("s").agg(F.percentile_approx("v", shares, 10_000).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    parted = rows.join(F.broadcast(cuts), "s").withColumn("part", below).drop("cuts")
    sums = parted.groupBy("s", "part").agg(F.sum("n").alias("total"), *[F.first(c).alias(c) for c in ("before", *WANTED)])
    earlier = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    holds = F.lit(False)
    for r in WANTED:
        holds = holds | ((F.col(r) > F.col("start")) & (F.col(r) <= F.col("start") + F.col("total")))
    chosen = placed.where(holds).select("s", "part", "start")
    return (
        parted.join(F.broadcast(chosen), ["s", "part"])
        .select((F.col("s") * slices + F.col("part")).alias("s"), "v", "n", F.col("start").alias("before"), *WANTED, "mean")
    )


def values_around_ranks(df: DataFrame, value: str, slices: int = 64) -> DataFrame:
    """The few values among which the median and the 95th percentile lie: (s, v, n, before, mid_a, mid_b, p95, mean).

    ``before`` counts the rows below slice ``s``. Cuts come from a quantile sketch of the distinct values, so a slice
    has about one in ``slices`` of them, however the values are spread.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.col("v") * F.col("n")).alias("weight"))
    ranks = total.select(
        F.floor((F.col("total") + 1) / 2).alias("mid_a"), (F.floor(F.col("total") / 2) + 1).alias("mid_b"),
        F.greatest(F.ceil(F.col("total") * F.lit(95) / F.lit(100)), F.lit(1)).alias("p95"), (F.col("weight") / F.col("total")).alias("mean"),
    )
    # one scalar subquery carries the ranks
    known = ranks.select(F.struct(*WANTED, "mean").alias("r")).scalar()
    rows = counts.select(F.lit(0).alias("s"), "v", "n", F.lit(0).cast("bigint").alias("before"), known.alias("r")).select("s", "v", "n", "before", "r.*")
    return _next_slices(rows, slices)


def order_statistics(df: DataFrame, value: str, slices: int = 64) -> DataFrame:
    """One row: mean, exact interpolated median and nearest-rank 95th percentile; zeros without values.

    Spark's exact percentile keeps every distinct value in one task. Here only the values around the wanted ranks are ordered.
    """
    order = Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values_around_ranks(df, value, slices).withColumn("upto", F.col("before") + F.sum("n").over(order))
    hit = lambda r: F.max(F.when((F.col(r) <= F.col("upto")) & (F.col(r) > F.col("upto") - F.col("n")), F.col("v")))
    found = placed.agg(hit("mid_a").alias("a"), hit("mid_b").alias("b"), hit("p95").alias("p95"), F.max("mean").alias("mean"))
    return found.select(
        F.coalesce("mean", F.lit(0.0)).alias("averageTime"),
        F.coalesce((F.col("a") + F.col("b")) / 2.0, F.lit(0.0)).alias("medianTime"),
        F.coalesce("p95", F.lit(0.0)).alias("p95Time"),
    )


def processing_latency(events: DataFrame, approximate: bool = False) -> DataFrame:
    rows = performance_events(events).select(F.col("d.processingTimePerPlace").alias("v"))
    if approximate:
        return rows.agg(
            _mean(F.col("v")).alias("averageTime"),
            F.coalesce(F.percentile_approx("v", 0.5, 10000), F.lit(0.0)).alias("medianTime"),
            F.coalesce(F.percentile_approx("v", 0.95, 10000), F.lit(0.0)).alias("p95Time"))
    return order_statistics(rows, "v")


def latency_by_batch_size(events: DataFrame) -> DataFrame:
    e = performance_events(events).select("d.batchSize", F.col("d.processingTimePerPlace").alias("t"))
    return e.where(F.col("batchSize").isNotNull() & F.col("t").isNotNull()).groupBy("batchSize").agg(
        F.avg("t").alias("averageTime"))


def api_metrics(events: DataFrame) -> DataFrame:
    e = parsed_events(events).where(_flag("apiCall"))
    n = F.count(F.lit(1))
    return e.agg(
        n.alias("totalApiCalls"), _mean(F.col("d.responseTime")).alias("averageResponseTime"),
        ratio_pct(_count_type("error_occurred"), n).alias("errorRate"), F.count_if(_flag("rateLimited")).alias("rateLimitHits"),
        F.count_if(F.col("d.service") == "apple").alias("appleCalls"),
        F.count_if(F.col("d.service") == "google").alias("googleCalls"))


def cache_and_worker_metrics(events: DataFrame) -> DataFrame:
    e = parsed_events(events)
    mean = lambda field, flag: _mean(F.col(f"d.{field}"), _flag(flag)).alias(field)
    return e.agg(*[mean(f, "cacheOperation") for f in ("hitRate", "missRate", "cacheSize", "evictionRate")],
                 *[mean(f, "workerOperation") for f in ("utilization", "completionRate", "queueTime")])


def verification_patterns(events: DataFrame) -> DataFrame:
    e = parsed_events(events)
    judged = F.col("type").isin("match_accepted", "match_rejected") & (F.col("d.verificationTime") != 0)
    return e.agg(
        _mean(F.col("d.verificationTime"), judged).alias("averageTimePerMatch"),
        _count_type("bulk_action_performed").alias("bulkActionUsage"),
        _count_type("manual_search_performed").alias("manualSearchUsage"),
        F.count_if(_flag("filterUsed")).alias("filterUsage"))


def session_patterns(sessions: DataFrame, events: DataFrame) -> DataFrame:
    s = sessions.select(F.lit("s").alias("kind"), "status", F.col("processingTimeMs").cast("double").alias("ms"),
                        (F.col("processedPlaces") < F.col("totalPlaces")).alias("partial"))
    e = events.select(F.lit("e").alias("kind"), F.col("type").alias("status"))
    is_s = F.col("kind") == "s"
    left = is_s & ((F.col("status") == "paused") | ((F.col("status") == "processing") & F.col("partial")))
    return s.unionByName(e, allowMissingColumns=True).agg(
        _mean(F.col("ms"), is_s & (F.col("ms") > 0)).alias("averageSessionLength"),
        F.count_if((F.col("kind") == "e") & (F.col("status") == "session_paused")).alias("pauseResumeFrequency"),
        ratio_pct(F.count_if(left), F.count_if(is_s)).alias("abandonmentRate"))


def completion_times(sessions: DataFrame) -> DataFrame:
    """Completion-time distribution as rows."""
    return sessions.where(F.col("status") == "completed").select("id", "processingTimeMs")


def error_recovery(sessions: DataFrame, events: DataFrame) -> DataFrame:
    s = sessions.select(F.lit("s").alias("kind"))
    e = parsed_events(events).select(F.lit("e").alias("kind"), "type", _flag("errorRecovery").alias("recovered"))
    errors = _count_type("error_occurred")
    return s.unionByName(e, allowMissingColumns=True).agg(
        (errors / F.greatest(F.count_if(F.col("kind") == "s"), F.lit(1))).alias("errorEncounterRate"),
        ratio_pct(F.count_if(F.col("recovered")), errors).alias("recoverySuccessRate"))


def common_errors(events: DataFrame, k: int = 10) -> DataFrame:
    e = parsed_events(events.where(F.col("type") == "error_occurred"))
    kind = F.when(F.col("d.errorType") != "", F.col("d.errorType")).otherwise("Unknown")
    return top_k(e.groupBy(kind.alias("errorType")).agg(F.count(F.lit(1)).alias("frequency")),
                 [F.col("frequency").desc(), F.col("errorType")], k)


# --- API log, engagement, tables --------------------------------------------

def api_usage_totals(log: DataFrame, start: str, end: str) -> DataFrame:
    inside = Period(start, end).holds(F.col("createdAt"))
    return log.where(inside).groupBy("service").agg(
        F.count(F.lit(1)).alias("totalCalls"), F.sum("responseTimeMs").alias("totalResponseTime"),
        F.count_if(F.col("responseStatus") >= 400).alias("errorCount"))


def api_usage_since(log: DataFrame, since: str | None = None) -> DataFrame:
    rows = log if since is None else log.where(F.col("createdAt") >= F.lit(since).cast("timestamp"))
    good = F.count_if(F.col("responseStatus").between(200, 299))
    n = F.count(F.lit(1))
    return rows.groupBy("service").agg(
        n.alias("totalRequests"), good.alias("successfulRequests"), F.avg("responseTimeMs").alias("averageResponseTime"),
        ((n - good) / n).alias("errorRate"))


def engagement(events: DataFrame) -> DataFrame:
    """Impressions, clicks and click rate per placement (columns placementId, event)."""
    shown, clicked = F.count_if(F.col("event") == "ad_impression"), F.count_if(F.col("event") == "ad_click")
    return events.where(F.col("placementId").isNotNull()).groupBy("placementId").agg(
        shown.alias("impressions"), clicked.alias("clicks"), ratio_pct(clicked, shown).alias("ctr"))


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table and a total row (table NULL); counts come from footers where Spark can read them there."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionAll(one)
    return counts.rollup("table").agg(F.sum("rows").alias("rows"))


def expiring_profile(entries: DataFrame, now: Column) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("totalEntries"), F.count_if(F.col("expiresAt") < now).alias("expiredEntries"),
        F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("totalSize"),
        F.min("createdAt").alias("oldestEntry"), F.max("createdAt").alias("newestEntry"))


def collection_names(memberships: DataFrame, collections: DataFrame) -> DataFrame:
    """(placeId, names): collection names of each place in collection order. A place's
    own memberships bound the array."""
    rows = memberships.select("placeId", "collectionId").distinct().join(
        collections.select(F.col("id").alias("collectionId"), "name"), "collectionId")
    return rows.groupBy("placeId").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("collectionId", "name"))), lambda s: s["name"]).alias("names"))
