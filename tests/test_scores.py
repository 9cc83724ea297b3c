"""Counts of all scores, and steps that the JVM can compile."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from tests.test_blocking import crowd
from waymerge.operators import blocking as B
from waymerge.operators import matching as M


def method_sizes(df):
    """Bytes of the largest method of each compiled step."""
    spark, out = df.sparkSession, io.StringIO()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(out):
            df.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]


def test_scoring_is_compiled(spark):
    places, candidates = crowd(spark, 8, 3)
    pairs = places.select(F.col("id").alias("place_id")).crossJoin(candidates.select(F.col("id").alias("candidate_id")))
    prepared = M.attach_features(pairs, places, candidates).drop("p_tags", "c_types", "c_ord")
    prepared = spark.createDataFrame(prepared.collect(), prepared.schema)
    sizes = method_sizes(M.score_features(prepared).select("place_id", "candidate_id", "confidence_score"))
    assert sizes and max(sizes) < 8000


def test_score_counts_equal_scores_of_every_pair(spark, monkeypatch):
    monkeypatch.setattr(B, "_HELD", 3)
    places, candidates = crowd(spark, 9, 40)
    odd = [("Ca'fe",), ("Cafe",), ("cafe",), ("",), (None,), (" ",), ("p_",), ("\u0001p_",), ("Inc.",)]
    named = lambda df, name, p: df.limit(1).drop(name).crossJoin(spark.createDataFrame(odd, f"{name} string")) \
        .withColumn("id", F.concat(F.lit(p), F.coalesce(name, F.lit("-")))).select(*df.columns)
    places = places.unionAll(places.withColumn("id", F.concat(F.lit("z"), "id"))).unionAll(named(places, "title", "o"))
    candidates = candidates.unionAll(named(candidates, "name", "o"))
    pairs = places.select(F.col("id").alias("place_id")).crossJoin(candidates.select(F.col("id").alias("candidate_id")))
    want = {r.confidence_score: r["count"] for r in M.score_pairs(pairs, places, candidates).groupBy("confidence_score").count().collect()}
    assert {r.confidence_score: r.pairs for r in B.score_counts(places, candidates).collect()} == want and len(want) > 10
    given = pairs.where("place_id < 'p3'").withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    found = {r.threshold: (r.matches, r.found) for r in B.recall(places, candidates, given, (30, 86, 101)).collect()}
    inside = {r.confidence_score: r["count"] for r in M.score_pairs(given.where("twice = 1"), places, candidates).groupBy("confidence_score").count().collect()}
    assert found == {t: (sum(n for s, n in want.items() if s >= t), sum(n for s, n in inside.items() if s >= t)) for t in (30, 86)}
