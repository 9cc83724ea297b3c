"""Reports, windows, quotas and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymerge.functions.text import split_tags
from waymerge.operators import filters as X, quota as Q, reports as R, windows as W

from .registry import query

NOW = "2024-01-20 12:00:00"
PERIOD = R.Period("1997-01-01", "2024-01-20")
BEFORE = R.Period("1995-01-01", "1997-01-01")


def _now():
    return F.lit(NOW).cast("timestamp")


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


# --- sessions and packs -----------------------------------------------------

_COUNTS = """count(*) as total, count(case when verificationStatus = 'pending' then 1 end) as pending, count(case when verificationStatus = 'accepted' then 1 end) as accepted,
    count(case when verificationStatus = 'rejected' then 1 end) as rejected, count(case when verificationStatus = 'manual' then 1 end) as manual,
    count(case when confidenceLevel = 'high' then 1 end) as "highConfidence", count(case when confidenceLevel = 'medium' then 1 end) as "mediumConfidence",
    count(case when confidenceLevel = 'low' then 1 end) as "lowConfidence" """


@query("a1_session_match_counts", f'select sessionId as "sessionId", {_COUNTS} from {{matches}} group by sessionId')
def _(t):
    return R.session_match_counts(t["matches"])


@query("a2_verification_progress", f"""
    with c as (select sessionId, {_COUNTS} from {{matches}} group by sessionId)
    select sessionId as "sessionId", total, pending, accepted, rejected, manual, "highConfidence", "mediumConfidence", "lowConfidence",
        accepted + rejected + manual as completed, cast(floor(100.0 * (accepted + rejected + manual) / total + 0.5) as bigint) as "completionPct",
        "highConfidence" - (accepted + rejected + manual) as "highConfidencePending" from c""")
def _(t):
    return R.verification_progress(t["matches"])


@query("a3_pack_progress", """
    select p.id as "packId", count(case when i.status in ('done', 'skipped') then 1 end) as done, count(i.id) as total,
        round(case when count(i.id) > 0 then 100.0 * count(case when i.status in ('done', 'skipped') then 1 end) / count(i.id) else 0 end, 6) as pct,
        count(i.id) > 0 and count(case when i.status in ('done', 'skipped') then 1 end) = count(i.id) as "isComplete"
    from {packs} p left join {items} i on i.packId = p.id group by p.id""")
def _(t):
    df = R.pack_progress(t["packs"], t["items"])
    return df.select("packId", "done", "total", *_r("pct"), "isComplete")


_INSIGHTS = """
    s as (select * from {sessions} where createdAt between timestamp '1997-01-01' and timestamp '2024-01-20'),
    m as (select m.* from {matches} m join s on s.id = m.sessionId),
    e as (select *, case when typed then value end as v from {app_events} where happened between timestamp '1997-01-01' and timestamp '2024-01-20'),
    si as (select count(*) as "totalSessions", count(case when status = 'completed' then 1 end) as "completedSessions",
        round(coalesce(avg(case when processingTimeMs > 0 then processingTimeMs end), 0), 6) as "averageSessionDuration", round(coalesce(avg(totalPlaces), 0), 6) as "averagePlacesPerSession" from s),
    mi as (select count(*) as "totalMatches", count(case when verificationStatus = 'accepted' then 1 end) as "acceptedMatches", count(case when verificationStatus = 'rejected' then 1 end) as "rejectedMatches",
        count(case when verificationStatus = 'manual' then 1 end) as "manualMatches", count(case when confidenceLevel = 'high' then 1 end) as "highConfidenceMatches",
        count(case when confidenceLevel = 'medium' then 1 end) as "mediumConfidenceMatches", count(case when confidenceLevel = 'low' then 1 end) as "lowConfidenceMatches" from m),
    ei as (select round(coalesce(avg(case when type = 'performance_metric' then v end), 0), 6) as "averageProcessingTime",
        round(coalesce(avg(case when type = 'performance_metric' then k end), 0), 6) as "averageApiCallsPerPlace", round(coalesce(avg(case when type = 'performance_metric' then k end), 0), 6) as "cacheHitRate",
        round(100.0 * count(case when type = 'error_occurred' then 1 end) / count(*), 6) as "errorRate", count(case when type = 'bulk_action_performed' then 1 end) as "bulkActionsUsed",
        count(case when type = 'manual_search_performed' then 1 end) as "manualSearchesPerformed",
        round(coalesce(avg(case when type in ('match_accepted', 'match_rejected') then v end), 0), 6) as "averageVerificationTime" from e)"""


@query("a5_usage_insights", f"""
    with {_INSIGHTS}
    select *, round(100.0 * "completedSessions" / "totalSessions", 6) as "completionRate", round(100.0 * "acceptedMatches" / "totalMatches", 6) as "matchAccuracyRate" from si, mi, ei""")
def _(t):
    df = R.usage_insights(t["sessions"], t["matches"], t["event_log"], PERIOD)
    return df.select(*[F.round(c, 6).alias(c) if dt == "double" else F.col(c) for c, dt in df.dtypes])


@query("a6_usage_trends", """
    with s as (select *, createdAt between timestamp '1997-01-01' and timestamp '2024-01-20' as cur, createdAt between timestamp '1995-01-01' and timestamp '1997-01-01' as prev from {sessions}),
    a as (select count(case when cur then 1 end) as n1, count(case when prev then 1 end) as n0 from s),
    m as (select 100.0 * count(case when cur and verificationStatus = 'accepted' then 1 end) / count(case when cur then 1 end) as m1,
        100.0 * count(case when prev and verificationStatus = 'accepted' then 1 end) / count(case when prev then 1 end) as m0 from {matches} x join s on s.id = x.sessionId),
    p as (select coalesce(avg(case when typed and type = 'performance_metric' then value end), 0) as p1 from {app_events} where happened <= timestamp '2024-01-20')
    select round(100.0 * (n1 - n0) / n0, 6) as "sessionsChange", round(100.0 * (m1 - m0) / m0, 6) as "accuracyChange", case when p1 > 0 then 100.0 else 0.0 end as "performanceChange" from a, m, p""")
def _(t):
    df = R.usage_trends(t["sessions"], t["matches"], t["event_log"], PERIOD, BEFORE)
    return df.select(*_r(*df.columns))


_ACC = "count(*) as total, count(case when verificationStatus = 'accepted' then 1 end) as accepted, round(100.0 * count(case when verificationStatus = 'accepted' then 1 end) / count(*), 6) as accuracy"


@query("a7_accuracy_by_level", f'select confidenceLevel as "confidenceLevel", {_ACC} from {{matches}} group by 1')
def _(t):
    return R.accuracy_by_level(t["matches"]).withColumn("accuracy", F.round("accuracy", 6))


@query("a8_accuracy_by_provider", f"""
    select target as provider, {_ACC} from {{matches}} m join {{sessions}} s on s.id = m.sessionId join {{packs}} p on p.id = s.packId group by 1""")
def _(t):
    return R.accuracy_by_provider(t["matches"], t["sessions"], t["packs"]).withColumn("accuracy", F.round("accuracy", 6))


@query("a9_accuracy_by_category", f"""
    select coalesce(json_extract_string(targetPlaceData, '$.category'), 'Unknown') as category, {_ACC}
    from {{matches}} where targetPlaceData <> 'not json' group by 1""")
def _(t):
    return R.accuracy_by_category(t["matches"]).withColumn("accuracy", F.round("accuracy", 6))


@query("a10_overall_accuracy", f"select {_ACC} from {{matches}}")
def _(t):
    return R.overall_accuracy(t["matches"]).withColumn("accuracy", F.round("accuracy", 6))


@query("a11_confidence_calibration", """
    with b(lo, hi) as (values (0, 20), (20, 40), (40, 60), (60, 70), (70, 80), (80, 90), (90, 100)),
    c as (select lo, hi, count(id) as n, count(case when verificationStatus = 'accepted' then 1 end) as a
          from b left join {matches} m on confidenceScore >= lo and confidenceScore < hi group by lo, hi)
    select lo as "rangeLow", hi as "rangeHigh", (lo + hi) / 2.0 as "predictedAccuracy", round(case when n > 0 then 100.0 * a / n else 0 end, 6) as "actualAccuracy",
        round(abs((lo + hi) / 2.0 - case when n > 0 then 100.0 * a / n else 0 end), 6) as "calibrationError" from c""")
def _(t):
    df = R.confidence_calibration(t["matches"])
    return df.select("rangeLow", "rangeHigh", "predictedAccuracy", *_r("actualAccuracy", "calibrationError"))


# --- event reports ----------------------------------------------------------

@query("a12_processing_latency", """
    with v as (select value as x, row_number() over (order by value) as r, count(*) over () as n from {app_events} where type = 'performance_metric' and typed)
    select round(avg(x), 6) as "averageTime", round(median(x), 6) as "medianTime", max(case when r = cast(ceil(n * 95 / 100.0) as bigint) then x end) as "p95Time" from v""")
def _(t):
    return R.processing_latency(t["event_log"]).select(*_r("averageTime", "medianTime"), "p95Time")


@query("a13_latency_by_batch_size", """
    select cast(k % 5 as double) as "batchSize", round(avg(value), 6) as "averageTime" from {app_events} where type = 'performance_metric' and typed group by 1""")
def _(t):
    return R.latency_by_batch_size(t["event_log"]).select("batchSize", *_r("averageTime"))


@query("a14_api_metrics", """
    select count(*) as "totalApiCalls", round(avg(case when typed then value end), 6) as "averageResponseTime", round(100.0 * count(case when type = 'error_occurred' then 1 end) / count(*), 6) as "errorRate",
        count(case when limited then 1 end) as "rateLimitHits", count(case when service = 'apple' then 1 end) as "appleCalls", count(case when service = 'google' then 1 end) as "googleCalls"
    from {app_events} where api_call""")
def _(t):
    df = R.api_metrics(t["event_log"])
    return df.select("totalApiCalls", *_r("averageResponseTime", "errorRate"), "rateLimitHits", "appleCalls", "googleCalls")


@query("a15_cache_and_worker_metrics", """
    select round(avg(case when cache_op then k end), 6) as "hitRate", round(avg(case when cache_op then 100 - k end), 6) as "missRate", round(avg(case when cache_op and typed then value end), 6) as "cacheSize",
        round(avg(case when cache_op then k end), 6) as "evictionRate", round(avg(case when worker_op then k end), 6) as utilization, round(avg(case when worker_op then k end), 6) as "completionRate",
        round(avg(case when worker_op and typed then value end), 6) as "queueTime" from {app_events}""")
def _(t):
    df = R.cache_and_worker_metrics(t["event_log"])
    return df.select(*_r(*df.columns))


@query("a16_verification_patterns", """
    select round(avg(case when typed and type in ('match_accepted', 'match_rejected') then value end), 6) as "averageTimePerMatch", count(case when type = 'bulk_action_performed' then 1 end) as "bulkActionUsage",
        count(case when type = 'manual_search_performed' then 1 end) as "manualSearchUsage", count(case when filter_used then 1 end) as "filterUsage" from {app_events}""")
def _(t):
    df = R.verification_patterns(t["event_log"])
    return df.withColumn("averageTimePerMatch", F.round("averageTimePerMatch", 6))


@query("a17_session_patterns", """
    select round(avg(case when processingTimeMs > 0 then processingTimeMs end), 6) as "averageSessionLength", (select count(*) from {app_events} where type = 'session_paused') as "pauseResumeFrequency",
        round(100.0 * count(case when status = 'paused' or (status = 'processing' and processedPlaces < totalPlaces) then 1 end) / count(*), 6) as "abandonmentRate" from {sessions}""")
def _(t):
    df = R.session_patterns(t["sessions"], t["event_log"])
    return df.select(*_r("averageSessionLength"), "pauseResumeFrequency", *_r("abandonmentRate"))


@query("a17_completion_times", """select id, processingTimeMs as "processingTimeMs" from {sessions} where status = 'completed'""")
def _(t):
    return R.completion_times(t["sessions"])


@query("a18_error_recovery", """
    with e as (select count(case when type = 'error_occurred' then 1 end) as n, count(case when recovered then 1 end) as r from {app_events}), s as (select count(*) as m from {sessions})
    select round(n / greatest(m, 1), 6) as "errorEncounterRate", round(100.0 * r / n, 6) as "recoverySuccessRate" from e, s""")
def _(t):
    df = R.error_recovery(t["sessions"], t["event_log"])
    return df.select(*_r(*df.columns))


@query("a18_w7_common_errors", """
    select coalesce(error_type, 'Unknown') as "errorType", count(*) as frequency from {app_events} where type = 'error_occurred'
    group by 1 order by frequency desc, 1 limit 10""")
def _(t):
    return R.common_errors(t["event_log"])


@query("a19_api_usage_totals", """
    select service, count(*) as "totalCalls", cast(sum(responseTimeMs) as bigint) as "totalResponseTime", count(case when responseStatus >= 400 then 1 end) as "errorCount"
    from {api_log} where createdAt between timestamp '2024-01-05' and timestamp '2024-01-20' group by 1""")
def _(t):
    return R.api_usage_totals(t["api_log"], "2024-01-05", "2024-01-20")


@query("a19_api_usage_since", """
    select service, count(*) as "totalRequests", count(case when responseStatus between 200 and 299 then 1 end) as "successfulRequests", round(avg(responseTimeMs), 6) as "averageResponseTime",
        round(1.0 * (count(*) - count(case when responseStatus between 200 and 299 then 1 end)) / count(*), 6) as "errorRate" from {api_log} where createdAt >= timestamp '2024-01-10' group by 1""")
def _(t):
    df = R.api_usage_since(t["api_log"], "2024-01-10")
    return df.select("service", "totalRequests", "successfulRequests", *_r("averageResponseTime", "errorRate"))


@query("a23_batch_run_summary", """
    select s.id as "sessionId", totalPlaces as "totalPlaces", least(totalPlaces, processedPlaces) as "processedPlaces", coalesce(n, 0) as "successfulMatches", errorCount as "failedMatches",
        round(case when processedPlaces = 0 or processingTimeMs = 0 then 0 else least(totalPlaces, processedPlaces) / processingTimeMs * 1000.0 end, 6) as "placesPerSecond",
        cast(ceil(least(totalPlaces, processedPlaces) / 10.0) as bigint) as "currentBatch", cast(ceil(totalPlaces / 10.0) as bigint) as "totalBatches"
    from {sessions} s left join (select sessionId, count(*) as n from {matches} group by 1) m on m.sessionId = s.id""")
def _(t):
    df = R.batch_run_summary(t["sessions"], t["matches"])
    return df.withColumn("placesPerSecond", F.round("placesPerSecond", 6))


@query("a24_execution_stats", """
    select s.id as "sessionId", count(m.id) as "totalVerified", count(m.id) as "readyForExecution", max(s.status) = 'completed' as "alreadyExecuted"
    from {sessions} s left join {matches} m on m.sessionId = s.id and m.verificationStatus in ('accepted', 'manual') group by s.id""")
def _(t):
    return R.execution_stats(t["sessions"], t["matches"])


@query("a25_engagement", """
    select placementId as "placementId", count(case when event = 'ad_impression' then 1 end) as impressions, count(case when event = 'ad_click' then 1 end) as clicks,
        round(100.0 * count(case when event = 'ad_click' then 1 end) / count(case when event = 'ad_impression' then 1 end), 6) as ctr from {placements} group by 1""")
def _(t):
    return R.engagement(t["placements"]).withColumn("ctr", F.round("ctr", 6))


_TABLES = ("places", "collections", "memberships", "packs", "items", "sessions", "matches", "api_log", "cache_entries", "event_log")


@query("a26_table_statistics", "select * from (" + " union all ".join(f"select '{n}' as \"table\", count(*) as rows from {{{n}}}" for n in _TABLES)
       + ") x union all select null, cast(sum(rows) as bigint) from (" + " union all ".join(f"select count(*) as rows from {{{n}}}" for n in _TABLES) + ") y")
def _(t):
    return R.table_statistics({n: t[n] for n in _TABLES})


@query("a27_expiring_profile", f"""
    select count(*) as "totalEntries", count(case when expiresAt < timestamp '{NOW}' then 1 end) as "expiredEntries", cast(sum(size) as bigint) as "totalSize",
        min(createdAt) as "oldestEntry", max(createdAt) as "newestEntry" from {{cache_entries}}""")
def _(t):
    return R.expiring_profile(t["cache_entries"], _now())


@query("a28_collection_names", """
    select placeId as "placeId", string_agg(c.name, '|' order by c.id) as names from {memberships} m join {collections} c on c.id = m.collectionId group by 1""")
def _(t):
    return R.collection_names(t["memberships"], t["collections"]).select("placeId", F.array_join("names", "|").alias("names"))


# --- quotas -----------------------------------------------------------------

_DAY = "2024-01-20"


@query("a20_usage_today", f"""
    select tier, count(*) as count from {{calls}} where cast(ts as date) = date '{_DAY}' group by tier
    union all select null, count(*) from {{calls}} where cast(ts as date) = date '{_DAY}'""")
def _(t):
    return Q.usage_today(t["calls"], _DAY)


@query("a20_w7_top_users", f"""
    select tier, userId as "userId", count(*) as count from {{calls}} where cast(ts as date) = date '{_DAY}' group by 1, 2 order by 3 desc, 1, 2 limit 5""")
def _(t):
    return Q.top_users(t["calls"], _DAY)


@query("a20_x1_weekly_series", f"""
    with d as (select date '{_DAY}' - cast(i as int) as day from range(7) r(i))
    select strftime(day, '%Y-%m-%d') as date, count(case when tier = 'free' then 1 end) as free, count(case when tier = 'premium' then 1 end) as premium, count(tier) as total
    from d left join {{calls}} c on cast(c.ts as date) = day group by 1""")
def _(t):
    return Q.weekly_series(t["calls"], _DAY)


@query("a20_user_weekly_series", f"""
    with u as (select distinct tier, userId from {{calls}}), d as (select date '{_DAY}' - cast(i as int) as day from range(7) r(i))
    select u.tier, u.userId as "userId", strftime(day, '%Y-%m-%d') as date, count(c.callId) as count, case u.tier when 'free' then 1 else 10 end as "dailyCap"
    from u cross join d left join {{calls}} c on c.tier = u.tier and c.userId = u.userId and cast(c.ts as date) = day group by 1, 2, 3""")
def _(t):
    return Q.user_weekly_series(t["calls"], _DAY)


@query("a20_minute_usage", """
    select tier, userId as "userId", date_trunc('minute', ts) as minute, count(*) as count, case tier when 'free' then 1 else 10 end as "minuteCap" from {calls} group by 1, 2, 3""")
def _(t):
    return Q.minute_usage(t["calls"])


VERDICTS = """
    with c as (select *, count(*) over (partition by tier, userId, date_trunc('minute', ts) order by ts, callId rows unbounded preceding) as m,
        count(*) over (partition by tier, userId, cast(ts as date) order by ts, callId rows unbounded preceding) as n, case tier when 'free' then 1 else 10 end as cap from {calls})
    select callId as "callId", tier, userId as "userId", ts, m as "minuteCount", n as "dayCount", m <= cap and n <= cap as allowed,
        case when m > cap then 'minute' when n > cap then 'daily' end as reason,
        case when m > cap then 60 when n > cap then greatest(cast(ceil(86400 - (hour(ts) * 3600 + minute(ts) * 60 + microsecond(ts) / 1000000.0)) as int), 60) end as "retryAfterSeconds",
        greatest(cap - n, 0) as "remainingDaily", case when m <= cap and n > cap then cap else greatest(cap - m, 0) end as "remainingMinute" from c"""


@query("w11_quota_verdicts", VERDICTS)
def _(t):
    return Q.quota_verdicts(t["calls"])


# --- windows ----------------------------------------------------------------

def _entries(t):
    return t["cache_entries"].withColumn("tags", split_tags(F.col("tags_csv")))


@query("w5_newest_first", "select c_custkey, id from {packs} order by createdAt desc, id")
def _(t):
    return W.newest_first(t["packs"], "createdAt").select("c_custkey", "id")


@query("w6_review_order", """select id, verificationStatus as "verificationStatus" from {matches}
    order by case verificationStatus when 'pending' then 1 when 'accepted' then 2 when 'rejected' then 3 else 4 end desc, id""")
def _(t):
    return W.review_order(t["matches"], "status").select("id", "verificationStatus")


@query("w8_keep_last", """select id, type from {event_log} order by timestamp desc, id desc limit 1000""")
def _(t):
    return W.keep_last(t["event_log"], "timestamp", "id").select("id", "type")


@query("w8_keep_last_per_user", """
    select id, userId as "userId" from (select *, row_number() over (partition by userId order by timestamp desc, id desc) as r from {event_log}) x where r <= 20""")
def _(t):
    return W.keep_last_per_key(t["event_log"], ["userId"], "timestamp", "id", 20).select("id", "userId")


@query("w9_retention", f"""
    with live as (select * from {{cache_entries}} where expiresAt >= timestamp '{NOW}'),
    r as (select *, sum(size) over (order by lastAccessedAt desc, key rows unbounded preceding) as run, row_number() over (order by lastAccessedAt desc, key) as n from live)
    select key, size from r where run <= 20000000 and n <= 3000""")
def _(t):
    return W.retain_within_budget(t["cache_entries"], _now(), max_size=20_000_000, max_count=3000).select("key", "size")


@query("w9_drop_tagged", "select key from {cache_entries} where not contains(tags_csv, 'apple') and not contains(tags_csv, 'error_occurred')")
def _(t):
    return W.drop_tagged(_entries(t), ["apple", "error_occurred"]).select("key")


@query("w10_batch_plan", """
    with m as (select distinct packId, placeId, case when l % 2 = 0 then 'free' else 'premium' end as tier from
        (select sessionId as packId, originalPlaceId as placeId, cast(substr(sessionId, 2) as bigint) as l from {matches}) x),
    n as (select packId, tier, count(*) as total from m group by 1, 2),
    j as (select packId, total, total > case tier when 'free' then 10 else 100 end as rejected from n)
    select m.packId as "packId", m.placeId as "placeId", cast((row_number() over (partition by m.packId order by m.placeId) - 1) // 4 + 1 as int) as batch, j.total as "totalPlaces", j.rejected
    from m join j on j.packId = m.packId where not rejected
    union all select packId, null, null, total, rejected from j where rejected""")
def _(t):
    l = F.substring("sessionId", 2, 20).cast("bigint")
    members = t["matches"].select(
        F.col("sessionId").alias("packId"), F.col("originalPlaceId").alias("placeId"),
        F.when(l % 2 == 0, "free").otherwise("premium").alias("tier")).distinct()
    return W.batch_plan(members, Q.caps_table(t.spark), requested_size=4)


# --- filters ----------------------------------------------------------------

@query("f1_missing_coordinates", "select id from {places} where latitude is null or longitude is null")
def _(t):
    return X.missing_coordinates(t["places"]).select("id")


@query("f2_library_search", """
    select id from {places} where contains(lower(title), 'oak') or contains(lower(address), 'oak') or
        len(list_filter(string_split(coalesce(tags_csv, ''), ','), lambda x: contains(lower(x), 'oak'))) > 0""")
def _(t):
    return X.search_library(t["places"].withColumn("tags", split_tags(F.col("tags_csv"))), "Oak").select("id")


@query("f3_review_filter", """
    select id from {matches} where verificationStatus = 'accepted' and confidenceLevel = 'low' and targetPlaceData <> 'not json' and
        (contains(lower(json_extract_string(targetPlaceData, '$.name')), 'gear') or contains(lower(json_extract_string(targetPlaceData, '$.address')), 'gear'))""")
def _(t):
    return X.review_matches(t["matches"], "accepted", "low", "Gear").select("id")


@query("f4_advanced_filter", """
    select m.id from {matches} m where targetPlaceData <> 'not json' and confidenceScore between 20 and 90 and json_extract_string(targetPlaceData, '$.latitude') is not null
        and json_extract_string(targetPlaceData, '$.address') is not null and verifiedAt >= timestamp '1997-01-01' and verifiedAt <= timestamp '2000-06-01'
        and cast(json_extract_string(matchFactors, '$[0].score') as double) >= 40 and cast(json_extract_string(matchFactors, '$[1].score') as double) >= 20
        and json_extract_string(targetPlaceData, '$.category') in ('large', 'small', 'promo')""")
def _(t):
    f = X.MatchFilter(score=(20, 90), has_coordinates=True, has_address=True, verified_after="1997-01-01", verified_before="2000-06-01",
                      name_floor=40, address_floor=20, categories=("large", "small", "promo"), exclude_categories=("medium",))
    return X.filter_matches(t["matches"], f).select("id")


@query("f6_active_sessions", "select id, status from {sessions} where status in ('processing', 'verifying', 'paused')")
def _(t):
    return X.active_sessions(t["sessions"]).select("id", "status")


@query("f7_j8_matches_in_range", """
    select m.id from {matches} m where sessionId in (select id from {sessions} where createdAt between timestamp '1997-03-01' and timestamp '1998-03-01')""")
def _(t):
    return X.matches_in_range(t["matches"], t["sessions"], "1997-03-01", "1998-03-01").select("id")


@query("f13_outcome_classes", """
    select id, case when responseStatus = 0 then case when responseTimeMs >= 30000 then 'TIMEOUT' else 'NETWORK_ERROR' end when responseStatus < 400 then null
        when responseStatus = 400 then 'BAD_REQUEST' when responseStatus = 401 then 'UNAUTHORIZED' when responseStatus = 403 then 'FORBIDDEN' when responseStatus = 404 then 'NOT_FOUND'
        when responseStatus = 429 then 'RATE_LIMITED' when responseStatus = 500 then 'SERVER_ERROR' when responseStatus = 503 then 'SERVICE_UNAVAILABLE' else 'HTTP_' || responseStatus end as "errorCode",
        responseStatus in (0, 429) or responseStatus >= 500 as retryable from {api_log}""")
def _(t):
    return X.classify_outcomes(t["api_log"]).select("id", "errorCode", "retryable")


@query("f14_open_now", """
    with h as (select event_id, ts, dayofweek(ts) as day, hour(ts) * 100 + minute(ts) as now, user_id % 4 as kind from events)
    select event_id, case when kind = 0 then null when kind = 1 then day = 3 and now between 900 and 1700
        when kind = 2 then now >= 1800 or now <= 200 else day in (0, 6) and now between 1000 and 1400 end as open from h""")
def _(t):
    def period(day, opens, closes):
        mark = lambda x: F.struct(day.cast("int").alias("day"), F.lit(x).alias("time"))
        return F.struct(mark(opens).alias("open"), mark(closes).alias("close"))
    every = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: period(x, "18:00", "02:00"))
    kind = F.col("user_id") % 4
    periods = (
        F.when(kind == 1, F.array(period(F.lit(3), "09:00", "17:00")))
        .when(kind == 2, every)
        .when(kind == 3, F.array(period(F.lit(0), "10:00", "14:00"), period(F.lit(6), "10:00", "14:00"))))
    return t["events"].select("event_id", X.open_at(periods, F.col("ts")).alias("open"))
