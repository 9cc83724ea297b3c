"""Work that costs much stays spread over tasks, and out of the loops that make pairs."""

from pyspark.sql import functions as F

from tests.test_blocking import crowd
from waymerge.functions.category import with_canonical_category
from waymerge.operators import blocking as B
from waymerge.operators import matching as M
from waymerge.operators.records import normalize_records


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_an_unknown_category_do_not_meet_in_one_task(spark):
    rows = [(f"r{i:03}", [None, "", "cafe", "Coffee  Shops"][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, category string").repartition(4)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = with_canonical_category(df, "category", "canonical").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {None: "establishment", "": "establishment", "cafe": "cafe", "Coffee  Shops": "cafe"}
    assert len(got) == 400 and all(r.canonical == want[r.category] for r in got)
    assert len({r.task for r in got if r.category != "Coffee  Shops"}) > 1


def test_records_are_cleaned_before_the_join_with_categories(spark):
    df = spark.createDataFrame([("a", "The Cafe", "1 Main St", 1.0, 2.0, "cafe")], "id string, title string, address string, latitude double, longitude double, category string")
    plan = plan_of(normalize_records(df, "title", F.col("category")))
    assert plan.index("Join LeftOuter") < plan.index("AS normal_name") and "AS tokens" in plan[plan.index("Join LeftOuter"):]


def test_no_distance_in_the_join_that_makes_pairs(spark):
    places, candidates = crowd(spark, 6, 70)
    met = B.meeting(M.place_features(places), M.candidate_features(candidates), B.Blocking())
    plan = plan_of(met)
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    pairing = [line for line in joins if "(cb#" in line and "(pb#" in line]
    assert len(pairing) == 1 and "CASE WHEN" not in pairing[0] and "Generate explode(transform(" in plan
    row = M.distance_factor(met, 5000).select("distance_m", B.haversine_m(F.col("p_lat"), F.col("p_lng"), F.col("c_lat"), F.col("c_lng")).alias("m")).where("m is not null").first()
    assert row.distance_m == row.m
