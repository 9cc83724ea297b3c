"""Collections, lists, packs, sessions: lookups, edits, cascades and checks.

Tables are immutable: an edit is a job ``table, changes -> table``. Change sets are
joined as tables, never gathered into one row or onto the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.storage import written
from .blocking import joined_in_blocks
from .dedupe import with_dedupe_keys


# --- lookups ----------------------------------------------------------------

def places_in_collections(places: DataFrame, memberships: DataFrame, collections: DataFrame) -> DataFrame:
    """Places that belong to any of the given collections (column ``id``)."""
    chosen = memberships.join(collections.select(F.col("id").alias("collectionId")), "collectionId", "left_semi")
    return places.join(chosen.select(F.col("placeId").alias("id")), "id", "left_semi")


def collections_of_places(collections: DataFrame, memberships: DataFrame, places: DataFrame) -> DataFrame:
    chosen = memberships.join(places.select(F.col("id").alias("placeId")), "placeId", "left_semi")
    return collections.join(chosen.select(F.col("collectionId").alias("id")), "id", "left_semi")


def expand_list_members(lists: DataFrame, memberships: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (listId, placeId, pos) of each list: chosen places first, then members of
    its collections in place order; the first sighting of a place counts."""
    chosen = lists.select(F.col("id").alias("listId"), F.posexplode("placeIds").alias("n", "placeId")).select(
        "listId", "placeId", F.struct(F.lit(0).alias("grp"), F.col("n").cast("string").alias("k"), F.col("n").cast("bigint").alias("n")).alias("ord")
    )
    wanted = lists.select(F.col("id").alias("listId"), F.explode("collectionIds").alias("collectionId"))
    members = (
        wanted.join(memberships.select("collectionId", "placeId"), "collectionId")
        .join(places.select(F.col("id").alias("placeId")), "placeId", "left_semi")
        .select("listId", "placeId", F.struct(
            F.lit(1).alias("grp"), F.col("placeId").alias("k"), F.lit(0).cast("bigint").alias("n")).alias("ord"))
    )
    ordered = F.struct(F.col("ord.grp").alias("grp"), F.when(F.col("ord.grp") == 0, F.col("ord.n")).otherwise(0).alias("n"),
                       F.when(F.col("ord.grp") == 1, F.col("ord.k")).otherwise("").alias("k"))
    return chosen.unionByName(members).groupBy("listId", "placeId").agg(F.min(ordered).alias("pos"))


def expand_lists(lists: DataFrame, memberships: DataFrame, places: DataFrame) -> DataFrame:
    """Lists with ``placeIds`` replaced by the expanded, ordered ids (a list's own size bounds the array): ``expand_list_members`` in one row a list.

    The members of a collection that some list names are gathered once and move as one array to each such list, so no row is made, moved or
    sorted per list and member.
    """
    wanted = lists.select(F.col("id").alias("listId"), F.explode(F.array_distinct("collectionIds")).alias("collectionId"))
    held = (
        memberships.select("collectionId", "placeId").join(wanted, "collectionId", "left_semi")
        .join(places.select(F.col("id").alias("placeId")), "placeId", "left_semi")
        .groupBy("collectionId").agg(F.collect_set("placeId").alias("held"))
    )
    members = wanted.join(held, "collectionId").groupBy("listId").agg(F.array_sort(F.flatten(F.collect_list("held"))).alias("held"))
    none = F.array().cast("array<string>")
    return (
        lists.join(members, lists["id"] == members["listId"], "left")
        .withColumn("placeIds", F.array_distinct(F.concat(F.coalesce("placeIds", none), F.coalesce("held", none)))).drop("held", "listId")
    )


def list_places(lists: DataFrame, places: DataFrame) -> DataFrame:
    """Places of each list in stored order; ids without a place drop out."""
    slots = lists.select(F.col("id").alias("listId"), F.posexplode("placeIds").alias("pos", "placeId"))
    return slots.join(places, slots["placeId"] == places["id"]).drop("placeId")


def list_collections(lists: DataFrame, collections: DataFrame) -> DataFrame:
    """(listId, collection columns) for the collections each list names."""
    named = lists.select(F.col("id").alias("listId"), F.explode(F.array_distinct("collectionIds")).alias("cid"))
    return named.join(collections, named["cid"] == collections["id"]).drop("cid")


def pack_scopes(packs: DataFrame) -> DataFrame:
    """(packId, scope): the scope key of each pack, a collection's or ``*`` for the whole library."""
    return packs.select(
        F.col("id").alias("packId"),
        F.when(F.col("scopeType").isin("library", "filtered"), F.lit("*"))
        .when((F.col("scopeType") == "collection") & (F.col("scopeId") != ""), F.concat(F.lit("c:"), "scopeId"))
        .alias("scope"),
    ).where(F.col("scope").isNotNull())


def _usable(places: DataFrame, skip_missing_coordinates: bool) -> DataFrame:
    usable = places.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()) \
        if skip_missing_coordinates else places
    return usable.select(F.col("id").alias("placeId"))


def _collection_members(memberships: DataFrame, ids: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """(scope, placeId) of the collections; ``packs``: of those only that some pack names, so the others' memberships are never moved."""
    if packs is not None:
        named = packs.where((F.col("scopeType") == "collection") & (F.col("scopeId") != "")).select(F.col("scopeId").alias("collectionId")).distinct()
        memberships = memberships.join(named, "collectionId", "left_semi")
    return memberships.join(ids, "placeId", "left_semi").select(F.concat(F.lit("c:"), "collectionId").alias("scope"), "placeId").distinct()


def scope_members(places: DataFrame, memberships: DataFrame, skip_missing_coordinates: bool = False) -> DataFrame:
    """(scope, placeId): what each scope key holds, every place under ``*``."""
    ids = _usable(places, skip_missing_coordinates)
    return _collection_members(memberships, ids).unionByName(ids.select(F.lit("*").alias("scope"), "placeId"))


def pack_scope(packs: DataFrame, places: DataFrame, memberships: DataFrame, skip_missing_coordinates: bool = False) -> DataFrame:
    """(packId, placeId) in scope: a collection pack takes its members (a collection
    id is required), library and filtered packs take every place.

    One equi-join on a scope key: the collection id, or ``*`` for the whole library. Scopes of many packs and places are cut into
    blocks, as what they list is far more than what is read.
    """
    ids = _usable(places, skip_missing_coordinates)
    members = written(_collection_members(memberships, ids, packs).unionByName(ids.select(F.lit("*").alias("scope"), "placeId")), "named-members")
    return joined_in_blocks(pack_scopes(packs), members, "packId", "placeId", ["scope"]).select("packId", "placeId")


def pack_totals(packs: DataFrame, places: DataFrame, memberships: DataFrame, skip_missing_coordinates: bool = False) -> DataFrame:
    """(packId, n): places in scope of each pack that has any, equal to counting ``pack_scope``. Counts are per scope key, one row each,
    so the library is counted once and not once for every pack that spans it."""
    ids = _usable(places, skip_missing_coordinates)
    n = F.count(F.lit(1)).alias("n")
    counts = _collection_members(memberships, ids, packs).groupBy("scope").agg(n).unionByName(ids.agg(n).select(F.lit("*").alias("scope"), "n"))
    return pack_scopes(packs).join(counts.where("n > 0"), "scope").select("packId", "n")


def materialize_packs(packs: DataFrame, places: DataFrame, memberships: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(pending items, session rows) for new packs."""
    scope = pack_scope(packs, places, memberships)
    items = scope.select(
        F.concat_ws("_", F.lit("item"), "packId", "placeId").alias("id"), "packId", "placeId",
        F.lit("pending").alias("status"),
    )
    totals = pack_totals(packs, places, memberships)
    zero = F.lit(0).cast("bigint")
    sessions = packs.select(F.col("id").alias("packId")).join(totals, "packId", "left").select(
        F.concat(F.lit("session_"), F.col("packId")).alias("id"), "packId", F.lit("pending").alias("status"),
        now.alias("createdAt"), now.alias("updatedAt"),
        zero.alias("apiCallsUsed"), zero.alias("processingTimeMs"), zero.alias("errorCount"),
        F.coalesce("n", zero).alias("totalPlaces"), zero.alias("processedPlaces"),
        zero.alias("verifiedPlaces"), zero.alias("completedPlaces"),
    )
    return items, sessions


def remaining_places(scope: DataFrame, sessions: DataFrame, matches: DataFrame) -> DataFrame:
    """Scope rows whose place has no match record in the pack's session."""
    done = matches.join(sessions.select(F.col("id").alias("sessionId"), "packId"), "sessionId").select(
        "packId", F.col("originalPlaceId").alias("placeId"))
    return scope.join(done, ["packId", "placeId"], "left_anti")


def next_pending(items: DataFrame) -> DataFrame:
    """Lowest pending item id per pack."""
    return items.where(F.col("status") == "pending").groupBy("packId").agg(F.min("id").alias("itemId"))


def items_with_places(items: DataFrame, places: DataFrame) -> DataFrame:
    return items.join(places.select(F.col("id").alias("placeId"), "title", "address", "latitude", "longitude"), "placeId")


# --- integrity --------------------------------------------------------------

def integrity_issues(packs: DataFrame, sessions: DataFrame, matches: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (issue, id) for dangling references."""
    session_ids = sessions.select(F.col("id").alias("sessionId"))
    issue = lambda df, name: df.select(F.lit(name).alias("issue"), "id")
    return (
        issue(packs.join(sessions.select(F.col("packId").alias("id")), "id", "left_anti"), "pack_without_session")
        .unionByName(issue(matches.join(session_ids, "sessionId", "left_anti"), "match_without_session"))
        .unionByName(issue(
            matches.join(places.select(F.col("id").alias("originalPlaceId")), "originalPlaceId", "left_anti"),
            "match_without_place"))
    )


def health_report(packs, items, sessions, matches, places) -> DataFrame:
    """One row: table sizes, issue counts and the overall verdict, from one aggregate over tagged rows."""
    tag = lambda df, name: df.select(F.lit(name).alias("what"))
    rows = integrity_issues(packs, sessions, matches, places).select(F.col("issue").alias("what"))
    for name, df in (("places", places), ("packs", packs), ("items", items)):
        rows = rows.unionByName(tag(df, name))
    n = lambda name: F.count_if(F.col("what") == name)
    counts = rows.agg(
        n("places").alias("places"), n("packs").alias("packs"), n("items").alias("items"),
        n("pack_without_session").alias("packsWithoutSession"),
        n("match_without_session").alias("matchesWithoutSession"),
        n("match_without_place").alias("matchesWithoutPlace"),
    )
    lonely_packs = (F.col("places") == 0) & (F.col("packs") > 0)
    lonely_items = (F.col("items") > 0) & (F.col("packs") == 0)
    dangling = F.col("packsWithoutSession") + F.col("matchesWithoutSession") + F.col("matchesWithoutPlace")
    return counts.withColumns({
        "packsWithoutPlaces": lonely_packs, "itemsWithoutPacks": lonely_items,
        "isHealthy": (dangling == 0) & ~lonely_packs & ~lonely_items,
    })


def drop_orphan_matches(matches: DataFrame, sessions: DataFrame) -> DataFrame:
    return matches.join(sessions.select(F.col("id").alias("sessionId")), "sessionId", "left_semi").select(*matches.columns)


def drop_orphan_logs(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drop logs naming an unknown session; logs naming none stay."""
    unbound = F.coalesce("sessionId", F.lit("")) == ""
    known = log.where(~unbound).join(sessions.select(F.col("id").alias("sessionId")), "sessionId", "left_semi")
    return log.where(unbound).unionByName(known.select(*log.columns))


def backfill_sessions(packs: DataFrame, items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session rows for packs that have none, judged from their items."""
    bare = packs.join(sessions.select(F.col("packId").alias("id")), "id", "left_anti")
    counts = items.groupBy("packId").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"))
    zero = F.lit(0).cast("bigint")
    df = bare.join(counts, bare["id"] == counts["packId"], "left").withColumns(
        {"n": F.coalesce("n", zero), "done": F.coalesce("done", zero)})
    status = F.when((F.col("done") == F.col("n")) & (F.col("n") > 0), "completed") \
        .when(F.col("done") > 0, "paused").otherwise("pending")
    return df.select(
        F.concat(F.lit("session_"), "id").alias("id"), F.col("id").alias("packId"), status.alias("status"),
        "createdAt", F.coalesce("updatedAt", "createdAt").alias("updatedAt"),
        zero.alias("apiCallsUsed"), zero.alias("processingTimeMs"), zero.alias("errorCount"),
        F.col("n").alias("totalPlaces"), F.col("n").alias("processedPlaces"),
        F.col("done").alias("verifiedPlaces"), F.col("done").alias("completedPlaces"),
    )


# --- cascades ---------------------------------------------------------------

def without_ids(df: DataFrame, gone: DataFrame, column: str, many: bool = False) -> DataFrame:
    """Rows whose ``column`` is not among ``gone.id``. ``many``: the ids are too many for every task to hold; each then holds those of its
    own partition, while the rows pass by unsorted."""
    ids = gone.select(F.col("id").alias(column))
    return df.join(ids.hint("shuffle_hash") if many else ids, column, "left_anti").select(*df.columns)


def list_changes(lists: DataFrame, gone: DataFrame, array: str, other: str) -> DataFrame:
    """(listId, goneId, action) for each list that names a deleted id.

    A list is deleted when nothing remains in either array, else updated.
    """
    named = lists.select(
        F.col("id").alias("listId"), F.explode(F.array_distinct(array)).alias("goneId"),
        F.size(F.array_distinct(array)).alias("held"), F.size(other).alias("others"),
    )
    hits = named.join(gone.select(F.col("id").alias("goneId")), "goneId", "left_semi")
    per_list = hits.groupBy("listId").agg(F.count(F.lit(1)).alias("lost"))
    action = F.when((F.col("lost") == F.col("held")) & (F.col("others") == 0), "deleted").otherwise("updated")
    return hits.join(per_list, "listId").select("listId", "goneId", action.alias("action"))


def list_slots(lists: DataFrame, array: str) -> DataFrame:
    """(listId, pos, ref): the row form of a list's ids."""
    return lists.select(F.col("id").alias("listId"), F.posexplode(array).alias("pos", "ref"))


def strip_slots(slots: DataFrame, gone: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, actions) after deletion, in row form: for lists too long for an array in one row.

    ``slots`` has listId, pos, ref; ``others`` has a listId for each id of the other kind. Slots that name a deleted id go, the rest keep their
    positions. Actions are (listId, action, lost): ``deleted`` where nothing remains of either kind, else ``updated``; lists that lose nothing have none.
    A list is counted before any shuffle and never gathered. Slots without a ref stay; without a listId they have no action.
    """
    ids = gone.select(F.col("id").alias("ref")).distinct()
    kept = slots.join(ids, "ref", "left_anti").select(*slots.columns)
    marked = slots.join(ids.withColumn("hit", F.lit(True)), "ref", "left").select("listId", F.col("hit").isNotNull().alias("lost"), F.lit(False).alias("other"))
    rest = others.select("listId", F.lit(False).alias("lost"), F.lit(True).alias("other"))
    counts = marked.unionByName(rest).where(F.col("listId").isNotNull()).groupBy("listId").agg(
        F.count_if("lost").alias("lost"), F.count_if(~F.col("lost")).alias("left"))
    action = F.when(F.col("left") == 0, "deleted").otherwise("updated").alias("action")
    return kept, counts.where("lost > 0").select("listId", action, "lost")


def strip_from_lists(lists: DataFrame, gone: DataFrame, array: str, other: str, now: Column) -> DataFrame:
    """Lists after deletion: ids stripped, emptied lists removed. Only affected lists are rebuilt, each from its own array by
    the positions it loses, in time linear in its length; ``strip_slots`` is the form for lists beyond a row."""
    hits = list_slots(lists, array).join(gone.select(F.col("id").alias("ref")), "ref", "left_semi")
    lost = hits.groupBy("listId").agg(F.collect_list("pos").alias("__lost"))
    joined = lists.join(lost, lists["id"] == lost["listId"], "left")
    remaining = F.array_except(F.sequence(F.lit(0), F.size(array) - 1), F.col("__lost"))
    kept = F.when(F.col("__lost").isNull(), F.col(array)).otherwise(F.transform(remaining, lambda i: F.get(array, i)))
    joined = joined.withColumns({
        "__kept": kept,
        "updatedAt": F.when(F.col("__lost").isNull(), F.col("updatedAt")).otherwise(now),
    })
    emptied = F.col("__lost").isNotNull() & (F.size("__kept") == 0) & (F.size(other) == 0)
    return joined.where(~emptied).withColumn(array, F.col("__kept")).select(*lists.columns)


def delete_places(tables: dict[str, DataFrame], gone: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Tables after deleting ``gone.id`` from places, with memberships, items and lists."""
    return {
        **tables,
        "places": without_ids(tables["places"], gone, "id"),
        "memberships": without_ids(tables["memberships"], gone, "placeId"),
        "items": without_ids(tables["items"], gone, "placeId"),
        "lists": strip_from_lists(tables["lists"], gone, "placeIds", "collectionIds", now),
    }


def delete_collections(tables: dict[str, DataFrame], gone: DataFrame, now: Column) -> dict[str, DataFrame]:
    return {
        **tables,
        "collections": without_ids(tables["collections"], gone, "id"),
        "memberships": without_ids(tables["memberships"], gone, "collectionId"),
        "lists": strip_from_lists(tables["lists"], gone, "collectionIds", "placeIds", now),
    }


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Sessions go by the million, and compressed files make them look fewer to Spark than they are."""
    return {
        **tables,
        "sessions": without_ids(tables["sessions"], gone, "id", many=True),
        "matches": without_ids(tables["matches"], gone, "sessionId", many=True),
        "log": without_ids(tables["log"], gone, "sessionId", many=True),
    }


def delete_packs(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    return {
        **tables,
        "packs": without_ids(tables["packs"], gone, "id"),
        "items": without_ids(tables["items"], gone, "packId"),
    }


def deletion_impact(changes: DataFrame, lists: DataFrame, gone: DataFrame, name: str, label: str) -> DataFrame:
    """Per deleted record: lists removed and updated, and the summary title.

    ``label`` is the name column of ``gone``. Titles of affected lists are rows of
    ``changes`` joined to ``lists``; only counts are aggregated here.
    """
    per = changes.groupBy("goneId").agg(
        F.count_if(F.col("action") == "deleted").alias("deletedLists"),
        F.count_if(F.col("action") == "updated").alias("updatedLists"),
    )
    both = (F.col("deletedLists") > 0) & (F.col("updatedLists") > 0)
    total = F.col("deletedLists") + F.col("updatedLists")
    title = (
        F.when(both, F.concat(total.cast("string"), F.lit(" Link Lists affected")))
        .when(F.col("deletedLists") == 1, "Link List removed")
        .when(F.col("deletedLists") > 1, F.concat(F.col("deletedLists").cast("string"), F.lit(" Link Lists removed")))
        .when(F.col("updatedLists") == 1, "Link List updated")
        .otherwise(F.concat(F.col("updatedLists").cast("string"), F.lit(" Link Lists updated")))
    )
    named = gone.select(F.col("id").alias("goneId"), F.col(label).alias(name))
    return per.join(named, "goneId").select("goneId", name, "deletedLists", "updatedLists", title.alias("title"))


# --- upserts ----------------------------------------------------------------

def latest_change(changes: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Newest change per key, as an aggregate."""
    rest = [c for c in changes.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__row")
    return changes.groupBy(key).agg(row).select(key, "__row.*")


def apply_changes(table: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Override ``columns`` where a change row (at most one per key) holds a value."""
    side = changes.select(F.col(key).alias("__key"), *[F.col(c).alias("__" + c) for c in columns])
    joined = table.join(side, F.col(key) == F.col("__key"), "left")
    return joined.select(*[
        F.coalesce("__" + c, c).alias(c) if c in columns else F.col(c) for c in table.columns
    ])


def apply_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply verification decisions; the latest per match wins.

    Decision columns: id, decisionId, decidedAt, status, verifiedBy, userNotes,
    manualSearchQuery, manualSelectedPlace (absent values NULL). A search decision
    (with a query) sets the status to manual by the user.
    """
    manual = F.col("manualSearchQuery").isNotNull()
    last = latest_change(decisions, "id", "decidedAt", "decisionId").select(
        "id", F.when(manual, "manual").otherwise(F.col("status")).alias("verificationStatus"),
        F.col("decidedAt").alias("verifiedAt"),
        F.when(manual, "user").otherwise(F.col("verifiedBy")).alias("verifiedBy"),
        "userNotes", "manualSearchQuery", "manualSelectedPlace",
    )
    cols = ["verificationStatus", "verifiedAt", "verifiedBy", "userNotes", "manualSearchQuery", "manualSelectedPlace"]
    for c in cols:
        if c not in matches.columns:
            matches = matches.withColumn(c, F.lit(None).cast(last.schema[c].dataType))
    return apply_changes(matches, last, cols)


def bulk_accept_high(matches: DataFrame, now: Column) -> DataFrame:
    """Accept pending high-confidence matches. The decision depends on the row alone, so no join is needed."""
    hit = (F.col("verificationStatus") == "pending") & (F.col("confidenceLevel") == "high")
    return matches.withColumns({
        "verifiedAt": F.when(hit, now).otherwise(F.col("verifiedAt")),
        "verifiedBy": F.when(hit, "bulk_action").otherwise(F.col("verifiedBy")),
        "verificationStatus": F.when(hit, "accepted").otherwise(F.col("verificationStatus")),
    })


def apply_item_updates(items: DataFrame, packs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, packs) after status updates (id, updateId, at, status, mismatchReason,
    mismatchNotes). completedAt is set only by done and skipped; the pack is touched."""
    last = latest_change(updates, "id", "at", "updateId")
    finished = F.col("status").isin("done", "skipped")
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    changes = last.select("id", "status", F.when(finished, F.col("at")).alias("completedAt"),
                          blank("mismatchReason"), blank("mismatchNotes"))
    new_items = apply_changes(items, changes, ["status", "completedAt", "mismatchReason", "mismatchNotes"])
    touched = last.join(items.select("id", "packId"), "id").groupBy("packId").agg(F.max("at").alias("at"))
    new_packs = packs.join(touched, packs["id"] == touched["packId"], "left").withColumn(
        "updatedAt", F.greatest("updatedAt", "at")).select(*packs.columns)
    return new_items, new_packs


def add_memberships(memberships: DataFrame, wanted: DataFrame) -> DataFrame:
    """Memberships plus the wanted (placeId, collectionId) pairs that are absent."""
    fresh = wanted.select("placeId", "collectionId").distinct().join(
        memberships.select("placeId", "collectionId"), ["placeId", "collectionId"], "left_anti")
    fresh = fresh.withColumn("id", F.concat_ws("_", "placeId", "collectionId"))
    return memberships.select("id", "placeId", "collectionId").unionByName(fresh.select("id", "placeId", "collectionId"))


def remove_memberships(memberships: DataFrame, unwanted: DataFrame) -> DataFrame:
    return memberships.join(unwanted.select("placeId", "collectionId"), ["placeId", "collectionId"], "left_anti") \
        .select(*memberships.columns)


def update_places(places: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge field updates (id, updateId, at, and any place columns), stamp updatedAt and
    recompute the normalized fields whose source changed."""
    last = latest_change(updates, "id", "at", "updateId")
    fields = [c for c in last.columns if c in places.columns and c not in ("id", "updatedAt")]
    side = last.select("id", *fields, F.col("at").alias("updatedAt"))
    merged = apply_changes(places, side, [*fields, "updatedAt"])
    texts = [c for c in ("title", "address") if c in fields]
    if not texts:
        return merged
    fresh = with_dedupe_keys(
        last.select("id", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in texts],
                    *[F.lit(None).cast("string").alias(c) for c in ("title", "address") if c not in texts]))
    keys = {"title": "normalizedTitle", "address": "normalizedAddress"}
    fresh = fresh.select("id", *[F.when(F.col(c).isNotNull(), F.col(keys[c])).alias(keys[c]) for c in texts])
    return apply_changes(merged, fresh, [keys[c] for c in texts])


def update_records(table: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge field updates into collections, packs or lists and stamp updatedAt."""
    last = latest_change(updates, "id", "at", "updateId")
    fields = [c for c in last.columns if c in table.columns and c not in ("id", "updatedAt")]
    return apply_changes(table, last.withColumn("updatedAt", F.col("at")), [*fields, "updatedAt"])
