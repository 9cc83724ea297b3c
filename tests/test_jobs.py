"""Files, edits, windows, quotas and streams on small tables."""

import datetime as dt
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from waymerge import schemas
from waymerge.operators import curate as U, quota as Q, reports as R, windows as W
from waymerge.plans.imports import import_places
from waymerge.operators.dedupe import with_dedupe_keys
from waymerge.sources import files, sinks
from waymerge.streaming import live as L


def folder():
    return tempfile.mkdtemp(prefix="waymerge-test-")


def at(minute, second=0, day=1):
    return dt.datetime(2024, 1, day, 10, minute, second)


def test_csv_import(spark):
    path = folder()
    with open(f"{path}/a.csv", "w") as f:
        f.write('Name,location,lat,lng,tags,url\n"A ""B""","1 St, X",40.7abc,-74,"x; y|z,",u\n,addr,1,2,,\nC,,abc,3,,\n')
    places, rejects = files.read_places_csv(spark, path)
    rows = places.orderBy("title").collect()
    assert [(r.title, r.address, r.latitude, r.longitude, r.tags) for r in rows] == [
        ('A "B"', "1 St, X", 40.7, -74.0, ["x", "y", "z"]), ("C", "", None, None, [])]
    assert [(r.row, r.reason) for r in rejects.collect()] == [(3, "Missing title/name")]


def test_saved_lists_and_archives(spark):
    path = folder()
    os.makedirs(f"{path}/Takeout/Saved")
    body = "Title,Note,URL\nPark,nice,\"https://maps.google.com/?q=x&ll=1.5,2.5\"\n,skip,\n"
    with open(f"{path}/Takeout/Saved/Want to go+.csv", "w") as f:
        f.write(body)
    with open(f"{path}/Takeout/other.csv", "w") as f:
        f.write(body.replace("Park", "Other"))
    got = files.read_saved_lists(spark, path).collect()
    assert [(r.title, r.listName, r.latitude, r.longitude) for r in got] == [("Park", "Want to go+", 1.5, 2.5)]
    with zipfile.ZipFile(f"{path}/export.zip", "w") as z:
        z.write(f"{path}/Takeout/other.csv", "Takeout/other.csv")
    places, rejects = files.read_saved_archives(spark, path)
    got = places.collect()
    assert rejects.count() == 0
    assert [(r.title, r.listName, r.latitude) for r in got] == [("Other", "other", 1.5)]


def test_import_plan(spark):
    rows = [(i, t, "1 Main St", None, 1.0, None, ["x"], "https://google.com", l) for i, (t, l) in enumerate(
        [("A", "one"), ("a!", "two"), ("B", "one"), ("C", "two")])]
    incoming = spark.createDataFrame(rows, "ord int, title string, address string, latitude double, longitude double, notes string, tags array<string>, sourceUrl string, listName string")
    have = with_dedupe_keys(spark.createDataFrame([("b", "1 main st")], "title string, address string"))
    out = import_places(incoming, have, F.lit("2024-01-01").cast("timestamp"))
    assert {r.title for r in out["places"].collect()} == {"A", "C"}
    total = out["summary"].where("listName is null").first()
    assert (total.importedCount, total.skippedCount, total.missingCoordinatesCount) == (2, 2, 2)
    assert out["memberships"].join(out["places"], out["memberships"].placeId == out["places"].id, "left_anti").count() == 0


def test_csv_export_round_trip(spark):
    stamp = at(0)
    places = spark.createDataFrame([("1", 'A "q"', "x\ny", 40.0, -74.5, None, ["a", "b"], "manual", None, "a", "x", stamp, stamp)], schemas.PLACES)
    ms = spark.createDataFrame([("m2", "1", "k1"), ("m1", "1", "k2")], schemas.MEMBERSHIPS)
    ks = spark.createDataFrame([("k1", "One", None, stamp, stamp), ("k2", "Two", None, stamp, stamp)], schemas.COLLECTIONS)
    path = folder() + "/out"
    sinks.write_csv(sinks.export_places(places, ms, ks), path)
    back, _ = files.read_places_csv(spark, path)
    r = back.first()
    assert (r.title, r.address, r.latitude, r.longitude, r.tags) == ('A "q"', "x\ny", 40.0, -74.5, ["a", "b"])


def test_long_share_url_falls_back(spark):
    stamp = at(0)
    lists = spark.createDataFrame([("big", "T", None, stamp), ("small", "T", None, stamp)], "id string, title string, description string, createdAt timestamp")
    rows = [("big", i, f"p{i}", "x" * 60, "addr", 1.0, 2.0, []) for i in range(40)] + [("small", 0, "p", "Äö", "addr", None, None, ["t"])]
    lp = spark.createDataFrame(rows, "listId string, pos int, id string, title string, address string, latitude double, longitude double, tags array<string>")
    urls = sinks.share_urls(lists, lp, "https://h.example")
    got = {r.listId: r.url for r in urls.collect()}
    assert got["big"] == "https://h.example/link-list/big" and "?data=" in got["small"]
    back = sinks.shared_places(urls).collect()
    assert [(r.listId, r.title, r.tags) for r in back] == [("small", "Äö", ["t"])]
    bad = spark.createDataFrame([("https://h.example/link-list/x?data=%%%",), ("https://h.example/other/x?data=e30",)], "url string")
    assert sinks.shared_places(bad).count() == 0


def test_delete_cascade_leaves_no_reference(spark):
    stamp = at(0)
    lists = spark.createDataFrame(
        [("l1", "A", None, ["p1", "p2", "p1"], [], stamp, stamp, None, True), ("l2", "B", None, ["p1"], [], stamp, stamp, None, True),
         ("l3", "C", None, ["p1"], ["k"], stamp, stamp, None, True), ("l4", "D", None, ["p3"], [], stamp, stamp, None, True)], schemas.LISTS)
    gone = spark.createDataFrame([("p1", "Gone")], "id string, title string")
    out = {r.id: r.placeIds for r in U.strip_from_lists(lists, gone, "placeIds", "collectionIds", F.lit(at(5))).collect()}
    assert out == {"l1": ["p2"], "l3": [], "l4": ["p3"]}
    changes = U.list_changes(lists, gone, "placeIds", "collectionIds")
    impact = U.deletion_impact(changes, lists, gone, "name", "title").first()
    assert (impact.deletedLists, impact.updatedLists, impact.title) == (1, 2, "3 Link Lists affected")


def test_row_form_of_a_long_list(spark):
    """One list holds half of all slots; rows and actions equal the array form, repeats, nulls and empty tables included."""
    slots = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 900).cast("string"))).alias("listId"),
        F.col("id").cast("int").alias("pos"), F.concat(F.lit("p"), (F.col("id") % 1_000).cast("string")).alias("ref"))
    slots = slots.unionByName(spark.createDataFrame([("nulls", 0, None), ("nulls", 1, "p4"), (None, 0, "p4"), ("bare", 0, "p4"), ("bare", 1, "p4"), ("held", 0, "p4")], slots.schema))
    gone = spark.createDataFrame([("p4",), ("p4",), ("p6",), ("absent",)], "id string")
    others = spark.createDataFrame([("held", "k"), ("elsewhere", "k")], "listId string, ref string")
    kept, actions = U.strip_slots(slots, gone, others)
    rows = [tuple(r) for r in slots.collect()]
    lost = {l for l, _, ref in rows if ref in ("p4", "p6") and l is not None}
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[2] not in ("p4", "p6"))
    got = {r.listId: (r.action, r.lost) for r in actions.collect()}
    assert set(got) == lost and got["hot"] == ("updated", 80) and got["bare"] == ("deleted", 2) and got["held"] == ("updated", 1) and got["nulls"] == ("updated", 1)
    none, no_actions = U.strip_slots(slots, gone.limit(0), others)
    assert none.count() == len(rows) and no_actions.count() == 0 and U.strip_slots(slots.limit(0), gone, others)[1].count() == 0


def test_pack_totals_equal_counting_the_scope(spark):
    packs = spark.createDataFrame([("a", "library", None), ("b", "filtered", "x"), ("c", "collection", "k1"), ("d", "collection", ""), ("e", "collection", "none"), ("f", "collection", "k1"), ("g", None, None)],
                                  "id string, scopeType string, scopeId string")
    places = spark.createDataFrame([("p1", 1.0, 1.0), ("p2", None, 1.0), ("p3", 2.0, 2.0)], "id string, latitude double, longitude double")
    memberships = spark.createDataFrame([("p1", "k1"), ("p1", "k1"), ("p2", "k1"), ("gone", "k1"), ("p3", "k2")], "placeId string, collectionId string")
    for skip in (False, True):
        want = {r.packId: r["count"] for r in U.pack_scope(packs, places, memberships, skip).groupBy("packId").count().collect()}
        assert {r.packId: r.n for r in U.pack_totals(packs, places, memberships, skip).collect()} == want
    assert U.pack_totals(packs, places.limit(0), memberships).count() == 0


def test_empty_pack_is_not_complete(spark):
    packs = spark.createDataFrame([("a",), ("b",)], "id string")
    items = spark.createDataFrame([("i1", "a", "done"), ("i2", "a", "skipped")], "id string, packId string, status string")
    got = {r.packId: (r.done, r.total, r.isComplete) for r in R.pack_progress(packs, items).collect()}
    assert got == {"a": (2, 2, True), "b": (0, 0, False)}


def test_order_statistics(spark):
    for values in ([5.0], [1.0, 2.0], [7.0] * 9 + [1e6], [float(i) ** 3 for i in range(1001)], []):
        r = R.order_statistics(spark.createDataFrame([(v,) for v in values], "v double"), "v", slices=8).first()
        s = sorted(values)
        if not s:
            assert (r.averageTime, r.medianTime, r.p95Time) == (0, 0, 0)
            continue
        median = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        assert r.medianTime == median and r.p95Time == s[-(-len(s) * 95 // 100) - 1]


def test_order_statistics_of_long_tails(spark):
    """Log-uniform values with a value of many copies: exact, and no slice keeps many of the distinct values."""
    values = [10 ** (i / 700) for i in range(7000)] + [3.5] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    around = R.values_around_ranks(df, "v")
    assert max(r["count"] for r in around.groupBy("s").count().collect()) <= 0.02 * len(set(values))
    s = sorted(values)
    r = R.order_statistics(df, "v").first()
    assert (r.medianTime, r.p95Time) == ((s[len(s) // 2 - 1] + s[len(s) // 2]) / 2, s[-(-len(s) * 95 // 100) - 1])


def test_calibration_top_bin(spark):
    m = spark.createDataFrame([(100, "accepted"), (95, "rejected")], "confidenceScore int, verificationStatus string")
    top = lambda closed: R.confidence_calibration(m, closed).where("rangeLow = 90").first().actualAccuracy
    assert (top(False), top(True)) == (0.0, 50.0)


def test_second_call_in_a_minute_is_refused(spark):
    calls = spark.createDataFrame([("1", "free", "u", at(0)), ("2", "free", "u", at(0, 30)), ("3", "free", "u", at(5))], schemas.CALLS)
    got = {r.callId: (r.allowed, r.reason, r.retryAfterSeconds) for r in Q.quota_verdicts(calls).collect()}
    assert got["1"] == (True, None, None) and got["2"] == (False, "minute", 60)
    assert got["3"] == (False, "daily", 14 * 3600 - 5 * 60)


def test_numbered_splits_hot_key(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = W.numbered(df, ["k"], [F.col("id")], "n", bucket=F.floor(F.col("id") / 50))
    want = W.numbered(df, ["k"], [F.col("id")], "n")
    assert got.select("k", "id", "n").exceptAll(want.select("k", "id", "n")).count() == 0


def batches(spark, path, parts, schema):
    """A file stream of one file per part, taken one at a time."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
        for n in sorted(os.listdir(f"{path}/b{i}")):
            if n.endswith(".parquet"):
                os.utime(f"{path}/b{i}/{n}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*/*.parquet")


def test_live_quota_over_batches_equals_replay(spark):
    rows = [(f"{i:03}", t, u, at(i // 7, i % 60)) for i in range(120) for t, u in [("free" if i % 2 else "premium", f"u{i % 3}")]]
    parts = [rows[:50], rows[50:90], rows[90:]]
    src, out = folder(), folder()
    parts = [sorted(p, key=lambda r: r[3]) for p in parts]
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    parts = [ordered[:50], ordered[50:90], ordered[90:]]
    L.live_quota_verdicts(batches(spark, src, parts, schemas.CALLS), out).awaitTermination()
    got = spark.read.parquet(f"{out}/verdicts")
    want = Q.quota_verdicts(spark.createDataFrame(rows, schemas.CALLS)).select(*got.columns)
    assert got.count() == 120 and got.exceptAll(want).count() == 0


def test_quota_state_shrinks(spark):
    """Counters of closed minutes and days go, also those of users who do not come back."""
    many = [(f"a{i}", "free", f"u{i}", at(i % 50)) for i in range(60)]
    few = [(f"b{d}", "premium", "late", at(5, day=d)) for d in (3, 4, 5)]
    src, out = folder(), folder()
    query = L.live_quota_verdicts(batches(spark, src, [many, *[[r] for r in few]], schemas.CALLS), out)
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) >= 60 and held[-1] < 20
    assert spark.read.parquet(f"{out}/verdicts").count() == 63


def test_windows_stay_open_and_late_rows_are_counted(spark):
    parts = [[("1", "free", "u", at(0)), ("2", "free", "u", at(40))], [("3", "free", "u", at(1)), ("4", "free", "u", at(40, 30)), ("5", "free", "v", at(59))], [("6", "free", "u", at(59, 59))]]
    src, out = folder(), folder()
    for rows in parts:  # a run each, on one checkpoint: what a batch brings moves the watermark for the next but one, or for the next run
        spark.createDataFrame(rows, schemas.CALLS).coalesce(1).write.mode("append").parquet(src)
        query = L.live_usage_windows(spark.readStream.schema(schemas.CALLS).parquet(src), out)
        query.awaitTermination()
        L.note_arrivals(spark, query, out)
    got = {(r.start.minute, r.userId): r["count"] for r in L.current_windows(spark, out, ["start", "end", "tier", "userId"]).collect()}
    assert got == {(0, "u"): 1, (40, "u"): 2, (59, "v"): 1, (59, "u"): 1}
    assert tuple(L.late_calls(spark, out).first()) == (6, 5, 1)


def test_live_pack_progress_over_batches(spark):
    schema = "id string, packId string, status string, at timestamp"
    parts = [[("i1", "a", "pending", at(0)), ("i2", "a", "done", at(0)), ("i3", "b", "pending", at(0))], [("i1", "a", "done", at(1))]]
    src, out = folder(), folder()
    L.live_pack_progress(batches(spark, src, parts, schema), out).awaitTermination()
    got = {r.packId: (r.done, r.total) for r in L.current_summary(spark, out, "packId").collect()}
    assert got == {"a": (2, 2), "b": (0, 1)}


def test_live_import_over_batches(spark):
    schema = "ord int, title string, address string"
    parts = [[(1, "A", "x"), (2, "a!", "x")], [(3, "A", "X"), (4, "B", "x")]]
    src, out = folder(), folder()
    library = with_dedupe_keys(spark.createDataFrame([("C", "x")], "title string, address string"))
    L.live_import(batches(spark, src, parts, schema), library, out, "ord").awaitTermination()
    assert {r.ord for r in spark.read.parquet(f"{out}/rows").collect()} == {1, 4}


def test_bucket_table_reads_do_not_grow(spark):
    """Every batch sees what all batches before it brought, from a bounded number of files; a repeated batch sees the same."""
    from waymerge.streaming.buckets import BucketTable

    root = folder()
    newest = lambda rows: rows.groupBy("k").agg(F.max_by("v", "n").alias("v"), F.max("n").alias("n"))
    table = BucketTable(root, "k string, v int, n int", ["k"], newest, buckets=3, every=3)
    state, files_read = {}, []
    for n in range(14):
        rows = [(f"k{(n * 5 + i) % 11}", n * 10 + i, n) for i in range(4)]
        before = dict(state)
        for attempt in range(2 if n % 4 == 3 or n % 3 == 0 else 1):
            table.put(spark.createDataFrame(rows, table.schema), n)
            state.update({k: v for k, v, _ in rows})
            got = {r.k: r.v for r in newest(table.read(spark, n)).collect()}
            assert got == state
            assert {r.k: r.v for r in newest(table.read(spark, n, own=False)).collect()} == before
            one = table.read(spark, n, [1])
            assert {r.k for r in one.collect()} <= set(state)
            table.end(spark, n)
        files_read.append(len(set(table.read(spark, n).inputFiles())))
    assert max(files_read[7:]) <= max(files_read[:7]) + 3
    assert len(os.listdir(f"{root}/changes")) <= 6 and len(os.listdir(f"{root}/snapshots")) <= 2


def test_live_jobs_with_snapshots(spark, monkeypatch):
    from waymerge.streaming import buckets as K

    monkeypatch.setattr(K.BucketTable.__init__, "__defaults__", (64, 2))
    schema = "id string, packId string, status string, at timestamp"
    parts = [[(f"i{n % 3}", "ab"[n % 2], ["pending", "done"][n % 5 > 2], at(n))] for n in range(7)]
    src, out = folder(), folder()
    L.live_pack_progress(batches(spark, src, parts, schema), out).awaitTermination()
    latest = {}
    for ((i, p, s, _),) in parts:
        latest[p, i] = s
    want = {p: (sum(s == "done" for (q, _), s in latest.items() if q == p), sum(q == p for q, _ in latest)) for p in "ab"}
    assert {r.packId: (r.done, r.total) for r in L.current_summary(spark, out, "packId").collect()} == want
    src, out = folder(), folder()
    rows = [[(n, "ABCAB"[n % 5] + "x" * (n > 4), "x")] for n in range(8)]
    library = with_dedupe_keys(spark.createDataFrame([("C", "x")], "title string, address string"))
    L.live_import(batches(spark, src, rows, "ord int, title string, address string"), library, out, "ord").awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(f"{out}/rows").collect()) == [0, 1, 5, 6, 7]


def test_half_of_all_rows_in_one_key(spark):
    """Hot hour, day and minute: cut into slices, with the same result, and no slice holds many of their rows."""
    from waymerge.operators import quota

    hot = [(f"{i:04}", "free", "hot", at(7) + dt.timedelta(microseconds=int((i / 600) ** 3 * 59e6))) for i in range(600)]
    calls = spark.createDataFrame(hot + [(f"c{i:03}", "premium", f"u{i % 9}", at(i % 50, i % 60)) for i in range(500)], schemas.CALLS)
    plain, cut = quota.running_counts(calls), quota.running_counts(calls, most=100)
    assert cut.count() == 1100 and cut.exceptAll(plain.select(*cut.columns)).count() == 0
    sliced = W.with_slices(calls, ["tier"], F.col("ts"))
    assert max(r["count"] for r in sliced.groupBy("tier", "__slice").count().collect()) <= 30
    last = [W.keep_last_per_key(calls, ["tier"], "ts", "callId", 70, most=m) for m in (100, 10**6)]
    want = sorted((r[3], r[0]) for r in hot)[-70:]
    assert sorted((r.ts, r.callId) for r in last[0].where("tier = 'free'").collect()) == want
    assert last[0].exceptAll(last[1]).count() == 0 and last[0].count() == last[1].count() == 140
    entries = calls.select(F.col("callId").alias("key"), (F.length("callId") * 10).cast("bigint").alias("size"), F.col("ts").alias("lastAccessedAt"),
                           F.lit(at(59)).alias("expiresAt"))
    for size, n in ((10_000, 10**6), (10**9, 333)):
        kept = [sorted(r.key for r in W.retain_within_budget(entries, F.lit(at(0)), size, n, most=m).collect()) for m in (100, 10**6)]
        order, budget = sorted(entries.collect(), key=lambda r: (-r.lastAccessedAt.timestamp(), r.key)), 0
        want = []
        for r in order:
            budget += r["size"]
            if budget > size or len(want) == n:
                break
            want.append(r.key)
        assert kept == [sorted(want)] * 2
