"""Collections, lists, packs and sessions: lookups, edits, cascades and checks; import and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymerge.operators import curate as U, dedupe as D, reports as R

from . import duck as d
from .registry import query
from .views import Tables

NOW = "2024-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def lists(t: Tables) -> DataFrame:
    """Lists with id arrays, from slot rows."""
    ids = t["list_slots"].groupBy("listId").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "placeId"))), lambda s: s["placeId"]).alias("placeIds"))
    cols = t["list_collections"].groupBy("listId").agg(F.array_sort(F.collect_list("collectionId")).alias("collectionIds"))
    none = F.array().cast("array<string>")
    return ids.join(cols, "listId", "left").select(
        F.col("listId").alias("id"), F.concat(F.lit("List "), "listId").alias("title"), F.lit(None).cast("string").alias("description"),
        "placeIds", F.coalesce("collectionIds", none).alias("collectionIds"), F.lit("2024-01-01").cast("timestamp").alias("createdAt"),
        F.lit("2024-01-01").cast("timestamp").alias("updatedAt"))


# places deleted by the cascade queries: those without coordinates
_GONE = "(select id from {places} where latitude is null)"
# collections deleted: suppliers with a negative balance
_GONE_K = "(select 'k' || lpad(cast(s_suppkey as string), 8, '0') as id, s_name as name from supplier where s_acctbal < 0)"


def _gone(t):
    return t["places"].where(F.col("latitude").isNull())


def _gone_collections(t):
    return t["supplier"].where("s_acctbal < 0").select(F.expr("'k' || lpad(cast(s_suppkey as string), 8, '0')").alias("id"), F.col("s_name").alias("name"))


# --- lookups ----------------------------------------------------------------

@query("j1_places_in_collections", f"""
    select id from {{places}} where id in (select placeId from {{memberships}} where collectionId in (select id from {_GONE_K} g))""")
def _(t):
    return U.places_in_collections(t["places"], t["memberships"], _gone_collections(t)).select("id")


@query("j1_collections_of_places", f"""
    select id, name from {{collections}} where id in (select collectionId from {{memberships}} where placeId in (select id from {_GONE} g))""")
def _(t):
    return U.collections_of_places(t["collections"], t["memberships"], _gone(t))


@query("j2_x2_expand_lists", """
    with chosen as (select listId, placeId, 0 as grp, pos as n, '' as k from {list_slots}),
    members as (select l.listId, m.placeId, 1 as grp, 0 as n, m.placeId as k from {list_collections} l join {memberships} m on m.collectionId = l.collectionId
                where m.placeId in (select id from {places})),
    firsts as (select listId, placeId, min((grp, n, k)) as pos from (select * from chosen union all select * from members) u group by 1, 2)
    select listId as id, count(*) as size, string_agg(placeId, ',' order by pos) as ids from firsts group by 1""")
def _(t):
    out = U.expand_lists(lists(t), t["memberships"], t["places"])
    return out.select("id", F.size("placeIds").cast("bigint").alias("size"), F.array_join("placeIds", ",").alias("ids"))


@query("j3_list_places", """
    select listId as "listId", cast(pos as int) as pos, p.id, title from {list_slots} s join {places} p on p.id = s.placeId""")
def _(t):
    return U.list_places(lists(t), t["places"]).select("listId", "pos", "id", "title")


@query("j4_list_collections", """
    select listId as "listId", c.id, c.name from {list_collections} l join {collections} c on c.id = l.collectionId""")
def _(t):
    return U.list_collections(lists(t), t["collections"]).select("listId", "id", "name")


@query("f10_pack_scope", """
    select p.id as "packId", m.placeId as "placeId" from {packs} p join {memberships} m on m.collectionId = p.scopeId
    where scopeType = 'collection' and m.placeId in (select id from {places} where latitude is not null and longitude is not null)
    union all select p.id, x.id from {packs} p, {places} x where scopeType in ('library', 'filtered') and latitude is not null and longitude is not null""")
def _(t):
    return U.pack_scope(t["packs"], t["places"], t["memberships"], skip_missing_coordinates=True)


@query("j25_pack_materialization", """
    with scope as (select p.id as packId, m.placeId from {packs} p join {memberships} m on m.collectionId = p.scopeId where scopeType = 'collection' and m.placeId in (select id from {places})
        union all select p.id, x.id from {packs} p, {places} x where scopeType in ('library', 'filtered'))
    select 'session_' || p.id as id, p.id as "packId", 'pending' as status, count(s.placeId) as "totalPlaces" from {packs} p left join scope s on s.packId = p.id group by p.id""")
def _(t):
    items, sessions = U.materialize_packs(t["packs"], t["places"], t["memberships"], _now())
    return sessions.select("id", "packId", "status", "totalPlaces")


@query("j25_pack_items", """
    select 'item_' || p.id || '_' || m.placeId as id, p.id as "packId", m.placeId as "placeId", 'pending' as status from {packs} p join {memberships} m on m.collectionId = p.scopeId
    where scopeType = 'collection' and m.placeId in (select id from {places})
    union all select 'item_' || p.id || '_' || x.id, p.id, x.id, 'pending' from {packs} p, {places} x where scopeType in ('library', 'filtered')""")
def _(t):
    return U.materialize_packs(t["packs"], t["places"], t["memberships"], _now())[0]


@query("j12_x4_remaining_places", """
    with scope as (select distinct packId, placeId from {items}),
    done as (select s.packId, m.originalPlaceId as placeId from {matches} m join {sessions} s on s.id = m.sessionId)
    select packId as "packId", placeId as "placeId" from scope where (packId, placeId) not in (select packId, placeId from done)""")
def _(t):
    return U.remaining_places(t["items"].select("packId", "placeId").distinct(), t["sessions"], t["matches"])


@query("w4_next_pending", """select packId as "packId", min(id) as "itemId" from {items} where status = 'pending' group by 1""")
def _(t):
    return U.next_pending(t["items"])


@query("j22_items_with_places", """select i.id, p.title from {items} i join {places} p on p.id = i.placeId""")
def _(t):
    return U.items_with_places(t["items"], t["places"]).select("id", "title")


# --- integrity --------------------------------------------------------------

_ISSUES = """
    select 'pack_without_session' as issue, id from {packs} where id not in (select packId from {sessions})
    union all select 'match_without_session', id from {matches} where sessionId not in (select id from {sessions})
    union all select 'match_without_place', id from {matches} where originalPlaceId not in (select id from {places})"""


@query("j13_integrity_issues", _ISSUES)
def _(t):
    return U.integrity_issues(t["packs"], t["sessions"], t["matches"], t["places"])


@query("j14_health_report", f"""
    with x as ({_ISSUES})
    select (select count(*) from {{places}}) as places, (select count(*) from {{packs}}) as packs, (select count(*) from {{items}}) as items,
        (select count(*) from x where issue = 'pack_without_session') as "packsWithoutSession", (select count(*) from x where issue = 'match_without_session') as "matchesWithoutSession",
        (select count(*) from x where issue = 'match_without_place') as "matchesWithoutPlace", false as "packsWithoutPlaces", false as "itemsWithoutPacks",
        (select count(*) from x) = 0 as "isHealthy" """)
def _(t):
    return U.health_report(t["packs"], t["items"], t["sessions"], t["matches"], t["places"])


_KEPT_SESSIONS = "(select * from {sessions} where status <> 'paused')"


@query("j15_drop_orphan_matches", f"select id from {{matches}} where sessionId in (select id from {_KEPT_SESSIONS} s)")
def _(t):
    return U.drop_orphan_matches(t["matches"], t["sessions"].where("status <> 'paused'")).select("id")


@query("j15_drop_orphan_logs", f"select id from {{api_log}} where coalesce(sessionId, '') = '' or sessionId in (select id from {_KEPT_SESSIONS} s)")
def _(t):
    return U.drop_orphan_logs(t["api_log"], t["sessions"].where("status <> 'paused'")).select("id")


@query("j16_session_backfill", """
    with i as (select packId, count(*) as n, count(case when status = 'done' then 1 end) as dn from {items} group by 1)
    select 'session_' || p.id as id, p.id as "packId", case when dn = n and n > 0 then 'completed' when dn > 0 then 'paused' else 'pending' end as status,
        coalesce(n, 0) as "totalPlaces", coalesce(dn, 0) as "verifiedPlaces"
    from {packs} p left join i on i.packId = p.id where p.id not in (select packId from {sessions} where status = 'completed')""")
def _(t):
    out = U.backfill_sessions(t["packs"], t["items"], t["sessions"].where("status = 'completed'"))
    return out.select("id", "packId", "status", "totalPlaces", "verifiedPlaces")


# --- cascades ---------------------------------------------------------------

_STRIPPED = f"""
    s as (select listId, placeId, pos, placeId in (select id from {_GONE} g) as lost from {{list_slots}}),
    c as (select listId, count(*) as nc from {{list_collections}} group by 1),
    l as (select s.listId, count(case when not lost then 1 end) as kept, count(case when lost then 1 end) as gone, coalesce(max(nc), 0) as nc,
            string_agg(placeId, ',' order by pos) filter (where not lost) as ids from s left join c on c.listId = s.listId group by 1)"""


@query("j17_place_delete_lists", f"""
    with {_STRIPPED} select listId as id, coalesce(ids, '') as ids, gone > 0 as touched from l where not (gone > 0 and kept = 0 and nc = 0)""")
def _(t):
    tables = {"places": t["places"], "memberships": t["memberships"], "items": t["items"], "lists": lists(t)}
    out = U.delete_places(tables, _gone(t), _now())["lists"]
    return out.select("id", F.array_join("placeIds", ",").alias("ids"), (F.col("updatedAt") == _now()).alias("touched"))


def _stripped(t: Tables):
    slots = t["list_slots"].select("listId", F.col("pos").cast("int").alias("pos"), F.col("placeId").alias("ref"))
    return U.strip_slots(slots, _gone(t), t["list_collections"].select("listId", F.col("collectionId").alias("ref")))


@query("j17_strip_slots", f"""
    select listId as "listId", cast(pos as int) as pos, placeId as ref from {{list_slots}} where placeId not in (select id from {_GONE} g)""")
def _(t):
    return _stripped(t)[0]


@query("j17_strip_actions", f"""
    with {_STRIPPED} select listId as "listId", case when kept = 0 and nc = 0 then 'deleted' else 'updated' end as action, gone as lost from l where gone > 0""")
def _(t):
    return _stripped(t)[1]


@query("j17_place_delete_rows", f"""
    select 'places' as tab, id from {{places}} where id not in (select id from {_GONE} g)
    union all select 'memberships', id from {{memberships}} where placeId not in (select id from {_GONE} g)
    union all select 'items', id from {{items}} where placeId not in (select id from {_GONE} g)""")
def _(t):
    out = U.delete_places({"places": t["places"], "memberships": t["memberships"], "items": t["items"], "lists": lists(t)}, _gone(t), _now())
    tag = lambda k: out[k].select(F.lit(k).alias("tab"), "id")
    return tag("places").unionAll(tag("memberships")).unionAll(tag("items"))


@query("j18_collection_delete_lists", f"""
    with c as (select listId, collectionId, collectionId in (select id from {_GONE_K} g) as lost from {{list_collections}}),
    k as (select listId, count(case when lost then 1 end) as gone, string_agg(collectionId, ',' order by collectionId) filter (where not lost) as ids from c group by 1)
    select distinct s.listId as id, coalesce(ids, '') as ids, coalesce(gone, 0) > 0 as touched from {{list_slots}} s left join k on k.listId = s.listId""")
def _(t):
    out = U.delete_collections({"collections": t["collections"], "memberships": t["memberships"], "lists": lists(t)}, _gone_collections(t), _now())["lists"]
    return out.select("id", F.array_join("collectionIds", ",").alias("ids"), (F.col("updatedAt") == _now()).alias("touched"))


@query("a30_deletion_impact", f"""
    with {_STRIPPED}, hit as (select distinct s.placeId, s.listId, case when kept = 0 and nc = 0 then 1 else 0 end as del from s join l on l.listId = s.listId where lost),
    n as (select placeId, sum(del) as dl, count(*) - sum(del) as ul from hit group by 1)
    select placeId as "goneId", title as name, cast(dl as bigint) as "deletedLists", cast(ul as bigint) as "updatedLists",
        case when dl > 0 and ul > 0 then cast(dl + ul as bigint) || ' Link Lists affected' when dl = 1 then 'Link List removed' when dl > 1 then cast(dl as bigint) || ' Link Lists removed'
             when ul = 1 then 'Link List updated' else cast(ul as bigint) || ' Link Lists updated' end as title
    from n join {{places}} p on p.id = placeId""")
def _(t):
    changes = U.list_changes(lists(t), _gone(t), "placeIds", "collectionIds")
    return U.deletion_impact(changes, lists(t), _gone(t), "name", "title")


@query("j19_session_delete", """
    select 'sessions' as tab, id from {sessions} where status <> 'paused'
    union all select 'matches', id from {matches} where sessionId not in (select id from {sessions} where status = 'paused')
    union all select 'log', id from {api_log} where sessionId is null or sessionId not in (select id from {sessions} where status = 'paused')""")
def _(t):
    out = U.delete_sessions({"sessions": t["sessions"], "matches": t["matches"], "log": t["api_log"]}, t["sessions"].where("status = 'paused'"))
    tag = lambda k: out[k].select(F.lit(k).alias("tab"), "id")
    return tag("sessions").unionAll(tag("matches")).unionAll(tag("log"))


@query("j19_pack_delete", """
    select 'packs' as tab, id from {packs} where target <> 'google' union all select 'items', id from {items} where packId not in (select id from {packs} where target = 'google')""")
def _(t):
    out = U.delete_packs({"packs": t["packs"], "items": t["items"]}, t["packs"].where("target = 'google'"))
    return out["packs"].select(F.lit("packs").alias("tab"), "id").unionAll(out["items"].select(F.lit("items").alias("tab"), "id"))


# --- upserts ----------------------------------------------------------------

_DECIDED = """
    select m.id, m.id || '-' || cast(r.i as string) as decisionId, coalesce(verifiedAt, timestamp '2001-01-01') + interval '1' day * r.i as decidedAt,
        case when r.i = 0 then 'accepted' else 'rejected' end as status, case when r.i = 0 then 'user' else 'bulk_action' end as verifiedBy,
        case when confidenceScore % 10 = 0 then 'note ' || cast(r.i as string) end as userNotes,
        case when confidenceScore % 30 = 0 and r.i = 1 then 'query' end as manualSearchQuery, cast(null as string) as manualSelectedPlace
    from {matches} m join (select 0 as i union all select 1 as i) r on r.i = 0 or confidenceScore % 20 = 0 where confidenceScore % 4 = 0"""


def _decisions(t: Tables) -> DataFrame:
    return t.spark.sql(_DECIDED, matches=t["matches"])


@query("j20_apply_decisions", f"""
    with x as ({_DECIDED}), y as (select *, row_number() over (partition by id order by decidedAt desc, decisionId desc) as r from x), z as (select * from y where r = 1)
    select m.id, case when z.manualSearchQuery is not null then 'manual' else coalesce(z.status, m.verificationStatus) end as "verificationStatus",
        coalesce(z.decidedAt, m.verifiedAt) as "verifiedAt", case when z.manualSearchQuery is not null then 'user' else coalesce(z.verifiedBy, m.verifiedBy) end as "verifiedBy", z.userNotes as "userNotes"
    from {{matches}} m left join z on z.id = m.id""")
def _(t):
    out = U.apply_decisions(t["matches"], _decisions(t))
    return out.select("id", "verificationStatus", "verifiedAt", "verifiedBy", "userNotes")


@query("j21_bulk_accept_high", f"""
    select id, case when verificationStatus = 'pending' and confidenceLevel = 'high' then 'accepted' else verificationStatus end as "verificationStatus",
        case when verificationStatus = 'pending' and confidenceLevel = 'high' then 'bulk_action' else verifiedBy end as "verifiedBy",
        case when verificationStatus = 'pending' and confidenceLevel = 'high' then timestamp '{NOW}' else verifiedAt end as "verifiedAt" from {{matches}}""")
def _(t):
    return U.bulk_accept_high(t["matches"], _now()).select("id", "verificationStatus", "verifiedBy", "verifiedAt")


def _item_updates(t: Tables) -> DataFrame:
    return t["items"].where("status in ('pending', 'flagged')").select(
        "id", F.lit("u1").alias("updateId"), _now().alias("at"),
        F.when(F.col("status") == "pending", "done").otherwise("pending").alias("status"),
        F.when(F.col("status") == "flagged", "wrong place").otherwise("").alias("mismatchReason"), F.lit(None).cast("string").alias("mismatchNotes"))


def _updated(t: Tables):
    items = t["items"].withColumns({
        "mismatchReason": F.lit(None).cast("string"), "mismatchNotes": F.lit(None).cast("string"), "completedAt": F.lit(None).cast("timestamp")})
    return U.apply_item_updates(items, t["packs"], _item_updates(t))


@query("j22_item_updates", f"""
    select id, case status when 'pending' then 'done' when 'flagged' then 'pending' else status end as status, case when status = 'pending' then timestamp '{NOW}' end as "completedAt",
        case when status = 'flagged' then 'wrong place' end as "mismatchReason" from {{items}}""")
def _(t):
    return _updated(t)[0].select("id", "status", "completedAt", "mismatchReason")


@query("j22_touched_packs", f"""
    select id, case when id in (select packId from {{items}} where status in ('pending', 'flagged')) then timestamp '{NOW}' else updatedAt end as "updatedAt" from {{packs}}""")
def _(t):
    return _updated(t)[1].select("id", "updatedAt")


_WANTED = "(select id as placeId, 'k00000001' as collectionId from {places})"


@query("j23_membership_upsert", f"""
    select id, placeId as "placeId", collectionId as "collectionId" from {{memberships}} union all
    select placeId || '_' || collectionId, placeId, collectionId from {_WANTED} w where (placeId, collectionId) not in (select placeId, collectionId from {{memberships}})""")
def _(t):
    wanted = t["places"].select(F.col("id").alias("placeId"), F.lit("k00000001").alias("collectionId"))
    return U.add_memberships(t["memberships"], wanted)


@query("j23_membership_removal", f"""
    select id from {{memberships}} where (placeId, collectionId) not in (select placeId, collectionId from {_WANTED} w)""")
def _(t):
    unwanted = t["places"].select(F.col("id").alias("placeId"), F.lit("k00000001").alias("collectionId"))
    return U.remove_memberships(t["memberships"], unwanted).select("id")


@query("j24_place_upsert", f"""
    select id, case when lang = 'en' then 'New ' || title else title end as title, {d.dedupe_key("case when lang = 'en' then 'New ' || title else title end")} as "normalizedTitle",
        case when lang = 'en' and latitude is null then 1.5 else latitude end as latitude, lang = 'en' as touched from {{places}}""")
def _(t):
    places = D.with_dedupe_keys(t["places"]).withColumn("updatedAt", F.lit("2024-01-01").cast("timestamp"))
    updates = t["places"].where("lang = 'en'").select(
        "id", F.lit("u").alias("updateId"), _now().alias("at"), F.concat(F.lit("New "), "title").alias("title"),
        F.when(F.col("latitude").isNull(), 1.5).alias("latitude"))
    out = U.update_places(places, updates)
    return out.select("id", "title", "normalizedTitle", "latitude", (F.col("updatedAt") == _now()).alias("touched"))


@query("j24_record_upsert", f"""
    select id, case when c_custkey % 2 = 0 then 'Pack ' || name else name end as name, case when c_custkey % 2 = 0 then timestamp '{NOW}' else updatedAt end as "updatedAt" from {{packs}}""")
def _(t):
    updates = t["packs"].where("c_custkey % 2 = 0").select(
        "id", F.lit("u").alias("updateId"), _now().alias("at"), F.concat(F.lit("Pack "), "name").alias("name"))
    return U.update_records(t["packs"], updates).select("id", "name", "updatedAt")


# --- import and duplicates --------------------------------------------------

# incoming rows: every document's text as a title, so copies repeat; library: pages with an English title
_IN = "(select doc_id, text as title, source as address, cast(null as double) as latitude, lang as listName from documents)"
_HAVE = "(select doc_id, text as title, source as address from documents where n_chars % 5 = 0)"


def _incoming(t):
    return t["documents"].select(
        "doc_id", F.col("text").alias("title"), F.col("source").alias("address"), F.lit(None).cast("double").alias("latitude"),
        F.when(F.col("n_chars") % 2 == 0, F.lit(1.0)).alias("longitude"), F.col("lang").alias("listName"),
        F.concat(F.lit("https://"), "source", F.lit(".google.com")).alias("sourceUrl"))


def _existing(t):
    have = t["documents"].where("n_chars % 5 = 0").select(F.col("text").alias("title"), F.col("source").alias("address"))
    return D.with_dedupe_keys(have)


_OUTCOME = f"""
    k as (select *, {d.dedupe_key('title')} as kt, {d.dedupe_key('address')} as ka from {_IN} i),
    h as (select {d.dedupe_key('title')} as kt, {d.dedupe_key('address')} as ka from {_HAVE} e),
    o as (select *, doc_id = min(doc_id) over (partition by kt, ka) and (kt, ka) not in (select kt, ka from h) as imported from k)"""


@query("j5_w3_import_dedupe", f"with {_OUTCOME} select doc_id from o where imported")
def _(t):
    return D.new_rows(_incoming(t), _existing(t), "doc_id").select("doc_id")


@query("j5_f12_import_outcome", f"with {_OUTCOME} select doc_id, imported, 'google' as source from o")
def _(t):
    return D.import_outcome(_incoming(t), _existing(t), "doc_id").select("doc_id", "imported", "source")


@query("a21_import_summary", f"""
    with {_OUTCOME}, g as (select listName, count(case when imported then 1 end) as i, count(case when not imported then 1 end) as s from o group by rollup(listName))
    select listName as "listName", i as "importedCount", s as "skippedCount", s as "duplicateCandidatesCount", i as "missingCoordinatesCount", 0 as "errorCount" from g""")
def _(t):
    return D.import_summary(D.import_outcome(_incoming(t), _existing(t), "doc_id"))


@query("j6_likely_duplicates", f"""
    with p as (select id, latitude, longitude, {d.dedupe_key('title')} as kt, {d.dedupe_key('address')} as ka from {{places}})
    select b.id as place_id, min(case when a.kt = b.kt and a.ka = b.ka then a.id end) as same_text_as,
        min(case when {d.meters('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} < 100 then a.id end) as near, min(a.id) as duplicate_of
    from p a join p b on a.id < b.id and ((a.kt = b.kt and a.ka = b.ka) or {d.meters('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} < 100) group by 1""")
def _(t):
    return D.likely_duplicates(t["places"])
