"""Names compared on arrays, and best matches of which only contenders are scored: as the plain forms have them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocking import crowd
from tests.test_scores import method_sizes
from waymerge.functions import compare as C
from waymerge.operators import blocking as B
from waymerge.operators import matching as M
from waymerge.plans import match as P


def names():
    rng = random.Random(4)
    words = ["cafe", "ca", "the", "a", "\u00f6l", "strasse", "", "x" * 70, "fe\u0301", "\u4e2d\u6587", "reeder", "read", "er"]
    return [*{" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(60)}, "", "a" * 64, "a" * 65, "b" * 64, "\U0001f600a", "a\u2003b", "a\tb"]


@pytest.mark.parametrize("most", [C._MOST, 50])
def test_names_are_compared_as_spark_does(spark, monkeypatch, most):
    every = names()
    df = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(every) for j, b in enumerate(every)], "i int, j int, a string, b string")
    words = lambda c: F.split(c, r"\\s+".replace("\\\\", "\\"))
    common = F.size(F.filter(words("a"), lambda w: (F.length(w) > 2) & F.exists(words("b"), lambda v: v.contains(w) | w.contains(v))))
    want = {(r.i, r.j): (r.d, r.c) for r in df.select("i", "j", F.levenshtein("a", "b").alias("d"), common.alias("c")).collect()}
    monkeypatch.setattr(C, "_MOST", most)
    a, b = (x.ravel() for x in np.indices((len(every), len(every))))
    assert {(i, j): (d, c) for i, j, d, c in zip(a.tolist(), b.tolist(), C.edits(every, a, b).tolist(), C.common_words(every, every, a, b).tolist())} == want
    got = df.limit(50).union(df.limit(1).select("i", "j", F.lit(None).cast("string"), "b")).select("i", "j", "a", C.name_comparison(F.col("a"), F.col("b")).alias("z")).collect()
    assert all(r.z is None if r.a is None else tuple(r.z) == want[r.i, r.j] for r in got)


def test_names_of_a_pair_are_not_compared_letter_by_letter(spark):
    places, candidates = crowd(spark, 8, 3)
    pairs = places.select(F.col("id").alias("place_id")).crossJoin(candidates.select(F.col("id").alias("candidate_id")))
    plan = M.name_factor(M.attach_features(pairs, places, candidates)).select("name_score")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "ArrowEvalPython" in plan


def test_only_contenders_are_scored(spark):
    places, candidates = crowd(spark, 11, 90)
    candidates = candidates.unionAll(candidates.withColumn("id", F.concat(F.lit("a"), "id")))
    own = places.select(F.concat(F.lit("q"), "id").alias("id"), F.col("title").alias("name"), "address", "latitude", "longitude", F.lit("cafe").alias("category"), F.col("tags").alias("types"))
    candidates = candidates.unionByName(own.select(*candidates.columns))
    prepared, (pf, _) = P.stored_candidates(candidates)[0], P.stored_places(places)
    every, few = (P.written(f(pf, prepared, P.MatchPlan()), "scored") for f in (P.scored_profiles, P.contending_profiles))
    best = lambda df: {tuple(r) for r in M.best_numbers(df).collect()}
    assert best(few) == best(every) and few.count() < every.count() / 2 and few.exceptAll(every).count() == 0
    p, c = B.bounded(pf, prepared, B.Blocking(), M.MatchOptions())
    top = {r.place_id: r.s for r in every.groupBy("place_id").agg(F.max("confidence_score").alias("s")).collect()}
    assert all(r.p_least <= max(top.get(r.place_id, 0), 30) for r in p.collect())


def test_contenders_are_told_in_compiled_steps(spark):
    places, candidates = crowd(spark, 8, 3)
    prepared, (pf, _) = P.stored_candidates(candidates)[0], P.stored_places(places)
    assert max(method_sizes(P.contending_profiles(pf, prepared, P.MatchPlan()))) < 8000
