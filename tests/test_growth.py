"""Steps whose cost must grow no faster than their input: same rows as the plain form, and no plan that moves or holds more."""

import pandas as pd
from pyspark.sql import functions as F

from waymerge.operators import blocking as B, curate as U
from waymerge.streaming import live as L, quota_state as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_expanded_lists_move_members_as_arrays(spark):
    lists = spark.createDataFrame(
        [("a", ["p3", "p1", "p3", "zz"], ["k1", "k2", "k1"]), ("b", None, ["k2"]), ("c", [], None), ("d", ["p9", None, None], ["none"]), ("e", ["p2"], [])],
        "id string, placeIds array<string>, collectionIds array<string>")
    memberships = spark.createDataFrame(
        [("k1", "p2"), ("k1", "p1"), ("k1", "p2"), ("k1", "gone"), ("k2", "p10"), ("k2", "p2"), ("k3", "p7"), (None, "p1"), ("k2", None)], "collectionId string, placeId string")
    places = spark.createDataFrame([(f"p{i}",) for i in range(12)], "id string")
    out = U.expand_lists(lists, memberships, places)
    got = {r.id: r.placeIds for r in out.collect()}
    assert got == {"a": ["p3", "p1", "zz", "p10", "p2"], "b": ["p10", "p2"], "c": [], "d": ["p9", None], "e": ["p2"]}
    rows = U.expand_list_members(lists, memberships, places).groupBy("listId").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "placeId"))), lambda s: s["placeId"]).alias("ids"))
    assert {r.listId: r.ids for r in rows.collect()} == {k: v for k, v in got.items() if v}
    assert "posexplode" not in plan(out)


def test_packs_move_named_collections_only(spark):
    packs = spark.createDataFrame(
        [("a", "collection", "k1"), ("b", "library", None), ("c", "collection", ""), ("d", "filtered", None), ("e", "collection", "none"), ("f", "collection", None)],
        "id string, scopeType string, scopeId string")
    memberships = spark.createDataFrame([("k1", "p1"), ("k1", "p1"), ("k1", "gone"), ("k2", "p2"), ("", "p1"), (None, "p1")], "collectionId string, placeId string")
    places = spark.createDataFrame([(f"p{i}", 1.0, 2.0) for i in range(200)], "id string, latitude double, longitude double")
    out = U.pack_scope(packs, places, memberships)
    want = [("a", "p1")] + [(k, f"p{i}") for k in "bd" for i in range(200)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert [r.scope for r in U._collection_members(memberships, places.select(F.col("id").alias("placeId")), packs).collect()] == ["c:k1"]
    assert {r.packId: r.n for r in U.pack_totals(packs, places, memberships).collect()} == {"a": 1, "b": 200, "d": 200}


def test_deleted_sessions_are_held_in_parts(spark):
    sessions = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    matches = spark.createDataFrame([("m1", "s1"), ("m2", "s2"), ("m3", None), ("m4", "")], "id string, sessionId string")
    log = spark.createDataFrame([("l1", "s2"), ("l2", None), ("l3", "")], "id string, sessionId string")
    out = U.delete_sessions({"sessions": sessions, "matches": matches, "log": log}, sessions.where("id <> 's1'"))
    assert {k: sorted(r.id for r in v.collect()) for k, v in out.items()} == {"sessions": ["s1"], "matches": ["m1", "m3", "m4"], "log": ["l2", "l3"]}
    for table in out.values():
        assert "BroadcastHashJoin" not in plan(table) and "ShuffledHashJoin" in plan(table)


def test_live_progress_over_several_batches(spark, tmp_path):
    """Null packs count like others, also in later batches; what a batch brings is not combined where it is read."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, packId string, status string, at timestamp"
    for rows in ([("i1", "a", "pending"), ("i2", "a", "done"), ("i1", None, "done")], [("i1", "a", "skipped"), ("i3", None, "pending")]):
        spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "id string, packId string, status string, n int").select(
            "id", "packId", "status", F.lit("2024-01-01").cast("timestamp").alias("at")).write.mode("append").parquet(source)
        L.live_pack_progress(spark.readStream.schema(schema).parquet(source), folder).awaitTermination()
    got = {r.packId: (r.done, r.total, r.isComplete) for r in L.current_summary(spark, folder, "packId").collect()}
    assert got == {"a": (2, 2, True), None: (1, 2, False)}


def test_current_windows_spread_rows_before_combining(spark, tmp_path):
    for epoch, rows in enumerate([[(1, "x", 3), (2, "y", 1)], [(1, "x", 5), (2, "y", None)]]):
        spark.createDataFrame(rows, "start int, user string, count long").write.parquet(f"{tmp_path}/windows/epoch={epoch}")
    out = L.current_windows(spark, str(tmp_path), ["start", "user"])
    assert "SortAggregate" not in plan(out) and plan(out).count("Exchange") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "x", 5), (2, "y", None)]


def test_quota_counts_in_plain_steps():
    class Held:
        value, timers = None, []

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None

        def getValueState(self, *_):
            return self

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return 0

    held, counter = Held(), Q.QuotaCounter(600_000)
    counter.init(held)
    calls = lambda *rows: iter([pd.DataFrame({"callId": [r[0]], "tier": ["free"], "userId": ["u"], "ts": pd.to_datetime([r[1]])}) for r in rows])
    first, = counter.handleInputRows(None, calls(("b", "2024-01-01 10:00:05"), ("a", "2024-01-01 10:00:05"), ("c", "2024-01-01 09:59:59"), ("d", "1969-12-31 10:00:00")), held)
    assert first[["callId", "dayCount", "minuteCount"]].values.tolist() == [["c", 1, 1], ["a", 2, 1], ["b", 3, 2]]
    second, = counter.handleInputRows(None, calls(("e", "2024-01-01 10:00:59"), ("f", "2024-01-02 00:00:00")), held)
    assert second[["callId", "dayCount", "minuteCount"]].values.tolist() == [["e", 4, 3], ["f", 1, 1]]
    assert not list(counter.handleInputRows(None, calls(("g", "1960-01-01")), held))
    assert "groupby" not in Q.QuotaCounter.handleInputRows.__code__.co_names


def test_nearby_tells_far_pairs_without_an_arc(spark):
    points = spark.createDataFrame([("n", 90.0, 10.0), ("e", 0.0, 180.0), ("o", 0.0, 0.0)], "query_id string, latitude double, longitude double")
    others = spark.createDataFrame([("pole", 89.9999, -170.0), ("west", 0.0, -179.9999), ("same", 0.0, 0.0), ("near", 0.0, 0.0001), ("far", 0.0, 0.01)],
                                   "id string, latitude double, longitude double")
    near = lambda r: sorted((x.query_id, x.candidate_id) for x in B.nearby(points, others, r).collect())
    close = [("e", "west"), ("n", "pole"), ("o", "near"), ("o", "same")]
    assert near(12.0) == close and near(1200.0) == sorted(close + [("o", "far")]) and near(0.001) == [("o", "same")]
    assert "(((q_x" in B.nearby(points, others, 12.0)._jdf.queryExecution().optimizedPlan().toString()
