"""Place-domain tables as SQL over the driver's tables, readable by Spark and DuckDB alike.

A view names its inputs in braces. ``spark_view`` binds them to DataFrames and
``with_views`` to common table expressions, so both engines see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_N = "cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)"
_LANG = "regexp_extract(html, 'lang=\"([a-z]+)\"', 1)"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_HEADING = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"


def _id(prefix: str, number: str) -> str:
    return f"'{prefix}' || lpad(cast({number} as string), 8, '0')"


VIEWS = {
    "page_facts": f"""
        select page_id, url, {_N} as n, {_LANG} as lang, {_TITLE} as title,
               {_HEADING} as heading, length(html) as chars
        from {{pages}}""",
    "page_parts": """
        select *, cast(n % 400 + 1 as string) || ' ' ||
               case n % 8 when 0 then 'Main St' when 1 then 'Oak Ave.' when 2 then 'N. Elm Blvd'
                    when 3 then 'Rue Saint-Jean' when 4 then 'SE Pine Dr' when 5 then 'Highland Rd'
                    when 6 then 'Unter den Linden' else 'Market Sq' end as street,
               case lang when 'fr' then 'Paris' when 'de' then 'Berlin' when 'es' then 'Madrid' else 'New York' end as city,
               case n % 5 when 0 then ', NY 10001' when 1 then ', 75001' when 2 then ', ON M5V 3A8, Canada'
                    when 3 then '' else ', ' || cast(10000 + n as string) end as tail,
               case n % 14 when 0 then 'restaurant' when 1 then 'cafe' when 2 then 'Coffee Shop' when 3 then 'bar'
                    when 4 then 'restaurante' when 5 then 'grocery' when 6 then 'supermarket' when 7 then 'museum'
                    when 8 then 'park' when 9 then 'hospital' when 10 then 'pharmacy' when 11 then 'Fast Food'
                    when 12 then 'xyz' else null end as kind
        from {page_facts}""",
    "places": f"""
        select {_id('p', 'page_id')} as id, title,
               case when n % 17 = 3 then '' when n % 9 = 0 then street || ' ' || city else street || ', ' || city || tail end as address,
               case when n % 11 = 5 then null when n % 50 = 7 then 95.5e0 else 40e0 + cast(n % 500 as double) / 1000e0 end as latitude,
               case when n % 11 = 5 then null else -74e0 + cast(n % 90 as double) / 1000e0 end as longitude,
               kind as category, kind || ',' || lang as tags_csv,
               case when page_id % 3 = 0 then 'https://www.google.com/maps/search/?api=1&query=' || cast(n as string)
                    when page_id % 3 = 1 then 'https://maps.apple.com/?q=' || cast(n as string) else url end as source_url,
               page_id, n, lang
        from {{page_parts}}""",
    "candidates": f"""
        select {_id('q', 'page_id')} as id,
               case page_id % 4 when 0 then heading when 1 then upper(replace(heading, 'ß', 'ss')) when 2 then heading || ' Cafe' else heading || ' & Co.' end as name,
               case page_id % 3 when 0 then street || ', ' || city || tail
                    when 1 then replace(replace(street, ' St', ' Street'), 'Ave.', 'Avenue') || ', ' || city || tail
                    else street || ', ' || city end as address,
               40e0 + cast(n % 500 as double) / 1000e0 + cast(page_id % 7 as double) * 0.0004e0 as latitude,
               case when page_id % 13 = 4 then null else -74e0 + cast(n % 90 as double) / 1000e0 end as longitude,
               case when page_id % 5 = 0 then 'establishment' else kind end as category,
               case when kind is null then 'establishment' else kind || ',food' end as types_csv,
               'google_maps' as source, page_id, n
        from {{page_parts}}""",
    # given pairs: order lines whose part and supplier numbers are page numbers, and pages of one document
    "pairs": f"""
        select distinct {_id('p', 'l_partkey')} as place_id, {_id('q', 'l_suppkey')} as candidate_id
        from {{lineitem}}
        where l_partkey in (select page_id from {{pages}}) and l_suppkey in (select page_id from {{pages}})
        union
        select a.id as place_id, b.id as candidate_id from {{places}} a join {{candidates}} b on a.n = b.n""",
    "packs": f"""
        select {_id('c', 'c_custkey')} as id, c_name as name,
               case when c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY') then 'apple' else 'google' end as target,
               case when c_acctbal >= 9980 then 'library' when c_acctbal < -980 then 'filtered' else 'collection' end as scopeType,
               case when c_acctbal between -980 and 9979 then {_id('k', 'c_nationkey')} end as scopeId,
               cast('2024-01-01' as timestamp) as createdAt, cast('2024-01-02' as timestamp) as updatedAt, c_custkey
        from {{customer}}""",
    "line_counts": """
        select l_orderkey, count(*) as n, count(case when l_returnflag <> 'N' then 1 end) as judged
        from {lineitem} group by l_orderkey""",
    "sessions": f"""
        select {_id('s', 'o_orderkey')} as id, {_id('c', 'o_custkey')} as packId,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'processing' else 'paused' end as status,
               cast(o_orderdate as timestamp) as createdAt,
               case when o_orderkey % 9 = 0 then cast(0 as bigint) else cast(floor(o_totalprice) as bigint) end as processingTimeMs,
               coalesce(n, 0) as totalPlaces, coalesce(judged, 0) as processedPlaces, o_orderkey % 4 as errorCount
        from {{orders}} left join {{line_counts}} on o_orderkey = l_orderkey""",
    "matches": f"""
        select 'm' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                   || '-' || cast(l_suppkey as string) as id,
               {_id('s', 'l_orderkey')} as sessionId, {_id('p', 'l_partkey')} as originalPlaceId,
               case when l_quantity = 13 then 'not json' else '{{{{"id":"t' || cast(p_partkey as string) || '","name":"' || p_name || '"'
                   || case when p_size % 7 = 0 then '' else ',"address":"' || cast(p_size as string) || ' ' || p_brand || ' St"' end
                   || case when p_size % 5 = 0 then '' else ',"latitude":' || cast(p_size as string) || '.5,"longitude":-' || cast(p_size as string) || '.25' end
                   || case when p_size % 10 = 0 then '' else ',"category":"' || lower(p_type) || '"' end || '}}}}' end as targetPlaceData,
               cast(2 * l_quantity as int) as confidenceScore,
               case when 2 * l_quantity >= 90 then 'high' when 2 * l_quantity >= 70 then 'medium' else 'low' end as confidenceLevel,
               '[{{{{"type":"name","score":' || cast(cast(2 * l_quantity as int) as string) || ',"weight":40}}}},{{{{"type":"address","score":'
                   || cast(l_linenumber * 10 as string) || ',"weight":30}}}}]' as matchFactors,
               case when l_returnflag = 'A' then 'accepted' when l_returnflag = 'R' and l_linestatus = 'F' then 'manual'
                    when l_returnflag = 'R' then 'rejected' else 'pending' end as verificationStatus,
               case when l_returnflag = 'N' then null else cast(l_shipdate as timestamp) end as verifiedAt,
               case when l_returnflag = 'N' then null else 'user' end as verifiedBy,
               case when l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber % 2 = 0
                    then '{{{{"name":"' || p_brand || '","placeId":"id ' || cast(p_partkey as string) || '"}}}}' end as manualSelectedPlace
        from {{lineitem}} join {{part}} on l_partkey = p_partkey""",
    "collections": f"""
        select {_id('k', 's_suppkey')} as id, s_name as name from {{supplier}}""",
    "memberships": f"""
        select distinct {_id('m', 'l_suppkey')} || '-' || {_id('p', 'l_partkey')} as id,
               {_id('p', 'l_partkey')} as placeId, {_id('k', 'l_suppkey')} as collectionId
        from {{lineitem}}""",
    "items": f"""
        select 'i' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                   || '-' || cast(l_suppkey as string) as id,
               {_id('c', 'l_suppkey')} as packId, {_id('p', 'l_partkey')} as placeId,
               case when l_linestatus = 'O' then 'pending' when l_returnflag = 'A' then 'done'
                    when l_returnflag = 'R' then 'skipped' else 'flagged' end as status
        from {{lineitem}}""",
    "list_slots": f"""
        select {_id('l', 'l_orderkey')} as listId, {_id('p', 'l_partkey')} as placeId,
               row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as pos
        from {{lineitem}}""",
    "list_collections": f"""
        select distinct {_id('l', 'l_orderkey')} as listId, {_id('k', 'l_suppkey')} as collectionId
        from {{lineitem}} where l_returnflag = 'A' and l_linenumber = 1""",
    "app_events": """
        select cast(event_id as string) as id,
               case when event_type = 'error' then 'error_occurred'
                    when event_type = 'view' then 'performance_metric'
                    when event_type = 'click' and k % 2 = 0 then 'match_accepted'
                    when event_type = 'click' then 'match_rejected'
                    when event_type = 'signup' and k % 3 = 0 then 'session_paused'
                    when event_type = 'signup' and k % 3 = 1 then 'bulk_action_performed'
                    when event_type = 'signup' then 'session_started'
                    when k % 2 = 0 then 'manual_search_performed' else 'session_completed' end as type,
               user_id, ts as happened, value, k,
               k % 4 = 0 as api_call, k % 4 = 1 as cache_op, k % 4 = 2 as worker_op, k % 10 = 0 as limited,
               k % 7 = 0 as filter_used, k % 5 = 0 as recovered, k % 6 <> 0 as typed,
               case when k % 3 = 0 then 'apple' else 'google' end as service,
               case when k % 8 = 0 then null else 'E' || cast(k % 15 as string) end as error_type
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from {events}) e""",
    "event_log": """
        select id, type, cast(user_id as string) as userId, cast(happened as timestamp) as timestamp,
               '{{"processingTime":' || num || ',"processingTimePerPlace":' || num || ',"apiCallsPerPlace":' || ks || ',"cacheHitRate":' || ks
               || ',"verificationTime":' || num || ',"responseTime":' || num || ',"batchSize":' || cast(k % 5 as string) || ',"hitRate":' || ks
               || ',"missRate":' || cast(100 - k as string) || ',"cacheSize":' || num || ',"evictionRate":' || ks || ',"utilization":' || ks
               || ',"completionRate":' || ks || ',"queueTime":' || num || ',"apiCall":' || case when api_call then 'true' else 'false' end
               || ',"cacheOperation":' || case when cache_op then '1' else '0' end || ',"workerOperation":' || case when worker_op then '"run"' else 'null' end
               || ',"filterUsed":' || case when filter_used then 'true' else 'false' end || ',"rateLimited":' || case when limited then 'true' else 'false' end
               || ',"errorRecovery":' || case when recovered then 'true' else 'false' end || ',"service":"' || service || '"'
               || case when error_type is null then '' else ',"errorType":"' || error_type || '"' end || '}}' as data
        from (select *, cast(k as string) as ks, case when typed then cast(value as string) else '"' || cast(value as string) || '"' end as num from {app_events}) e""",
    "calls": """
        select cast(event_id as string) as callId, case when user_id % 2 = 0 then 'free' else 'premium' end as tier,
               cast(user_id as string) as userId, cast(ts as timestamp) as ts
        from {events}""",
    "api_log": """
        select id, service, case when k % 12 = 0 then '' when k % 13 = 0 then null else 's' || lpad(id, 8, '0') end as sessionId,
               cast(case when type <> 'error_occurred' then 200 + k % 2 when k % 10 = 0 then 0 when k % 10 = 1 then 400
                    when k % 10 = 2 then 401 when k % 10 = 3 then 403 when k % 10 = 4 then 404 when k % 10 = 5 then 429
                    when k % 10 = 6 then 500 when k % 10 = 7 then 503 when k % 10 = 8 then 502 else 418 end as int) as responseStatus,
               cast(floor(value * 100) as bigint) as responseTimeMs, cast(happened as timestamp) as createdAt
        from {app_events}""",
    "cache_entries": """
        select 'e' || lpad(id, 8, '0') as key, cast(floor(value * 1000) as bigint) as size, cast(happened as timestamp) as createdAt,
               cast(happened as timestamp) + interval '1' hour * k as expiresAt, cast(happened as timestamp) + interval '1' minute * k as lastAccessedAt,
               service || ',' || type as tags_csv
        from {app_events}""",
    "placements": """
        select 'slot' || cast(k % 5 as string) as placementId,
               case when type = 'performance_metric' then 'ad_impression' when type in ('match_accepted', 'match_rejected') then 'ad_click'
                    else 'ad_other' end as event
        from {app_events}""",
    "links": """
        select page_id,
               case page_id % 7
                    when 0 then 'https://maps.apple.com/?ll=40.' || cast(n as string) || ',-74.5&q=Cafe+' || lang || '%20' || cast(n as string)
                    when 1 then 'https://maps.apple.com/?q=Oak+Street+' || cast(n as string)
                    when 2 then 'https://www.google.com/maps/search/?api=1&query=Bar+' || lang || '+' || cast(n as string)
                    when 3 then 'https://www.google.com/maps/search/?api=1&query=12.' || cast(n as string) || ',-3.25'
                    when 4 then ' https://www.google.com/maps/place/Big+Park+' || cast(n as string) || '/@41.5,-7' || cast(n % 10 as string) || '.125,15z '
                    when 5 then 'https://maps.app.goo.gl/?query=Hotel%20' || cast(n as string)
                    else url end as url, n, lang
        from {page_facts}""",
}


def _inputs(sql: str) -> list[str]:
    """Names in single braces."""
    return sorted(set(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", sql)))


class Tables:
    """Base tables of a directory and the views over them as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir, self._made = spark, sf_dir.rstrip("/"), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                sql = VIEWS[name]
                self._made[name] = self.spark.sql(sql, **{n: self[n] for n in _inputs(sql)})
        return self._made[name]


def with_views(sql: str) -> str:
    """DuckDB query with the views it names (in braces) as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _inputs(text):
            if name not in BASE and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    bind = lambda text: text.format(**{n: (n if n in BASE else f"v_{n}") for n in _inputs(text)})
    views = ",\n".join(f"v_{n} as materialized ({bind(VIEWS[n])})" for n in order)
    body = bind(sql)
    if body.lstrip().lower().startswith("with "):
        body = body.lstrip()[5:]
        return f"with {views},\n{body}" if views else f"with {body}"
    return f"with {views}\n{body}" if views else body
