"""Complete ranking above a score, its recall, and names within a few edits, against all pairs."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymerge.operators import blocking as B
from waymerge.operators import matching as M
from waymerge.operators import typos
from waymerge.plans import match as P

PLACE = "id string, title string, address string, latitude double, longitude double, tags array<string>"
CAND = "id string, name string, address string, latitude double, longitude double, category string, types array<string>"


def crowd(spark, seed, n=90):
    """Variants of a few records around one town: same, near and far points, changed names, other house numbers, missing parts."""
    rng = random.Random(seed)
    names = ["Café Central", "Blue Door Bakery", "Grand Hotel Paris West", "Sun", "The Old Mill & Co.", "Sunny Side Diner", "", "!!!"]
    def record(i):
        name, number = rng.choice(names), rng.randint(1, 4)
        if rng.random() < .4 and name:
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice(["", "x", "e "]) + name[k + 1:]
        if rng.random() < .2:
            name = name.upper() + " annex"
        street = rng.choice(["Main St", "Main Street", "Mian St", "Oak Ave."])
        address = rng.choice([f"{number} {street}, Springfield, NY 1000{number % 2}", f"{street}, Springfield", f"{number} {street}", "", "x1"])
        spread = rng.choice([0, .0003, .004, .03, 2.0])
        lat, lng = 51.5 + rng.uniform(-spread, spread), -0.1 + rng.uniform(-spread, spread)
        if rng.random() < .08:
            lat = None
        return name, address, lat, lng, rng.choice(["cafe", "restaurant", "hotel", "", None])
    ps = [(f"p{i:03}", *r[:4], [r[4]] if r[4] else []) for i in range(n) for r in [record(i)]]
    cs = [(f"c{i:03}", *r, ["food"]) for i in range(n) for r in [record(i)]]
    return spark.createDataFrame(ps, PLACE), spark.createDataFrame(cs, CAND)


def every_score(places, candidates, options):
    pairs = places.select(F.col("id").alias("place_id")).crossJoin(candidates.select(F.col("id").alias("candidate_id")))
    return {(r.place_id, r.candidate_id): r.confidence_score for r in M.score_pairs(pairs, places, candidates, options)
            .select("place_id", "candidate_id", "confidence_score").collect()}


@pytest.mark.parametrize("seed, options, scores", [
    (1, M.MatchOptions(), (86, 93, 100)),
    (2, M.MatchOptions(max_distance=1000, weights=M.Weights(20, 20, 50, 10)), (86, 90)),
    (3, M.MatchOptions(weights=M.Weights(30, 30, 20, 0)), (91, 95)),
])
def test_no_match_above_the_score_is_lost(spark, seed, options, scores):
    places, candidates = crowd(spark, seed)
    everything = every_score(places, candidates, options)
    pf, cf = M.place_features(places), M.candidate_features(candidates)
    for score in scores:
        want = {pair for pair, got in everything.items() if got >= score}
        found = [tuple(r) for r in B.pairs_reaching(pf, cf, score, options).collect()]
        assert len(found) == len(set(found)) and want <= set(found) and len(found) < len(everything) / 2
        if score == scores[0]:
            assert len(want) > 5


def test_bound_is_refused_where_distance_may_be_missing(spark):
    places, candidates = crowd(spark, 4, 3)
    with pytest.raises(ValueError):
        P.ranked_per_place(places, candidates, P.MatchPlan(complete_from=70))
    assert B.Reach.least() == 86 and B.Reach.of(90).meters < B.Reach.of(86).meters < 5000


def test_ranked_equals_all_pairs(spark):
    places, candidates = crowd(spark, 5, 60)
    places = places.unionAll(places.withColumn("id", F.concat(F.lit("z"), "id")))  # copies
    everything = every_score(places, candidates, M.MatchOptions())
    want, ranks = set(), Counter()
    for (p, c), score in sorted(everything.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        if score >= 86:
            ranks[p] += 1
            want.add((p, c, score, ranks[p]))
    got = {(r.place_id, r.candidate_id, r.confidence_score, r.match_rank) for r in P.ranked_per_place(places, candidates).collect()}
    assert got == want and want
    pairs = spark.createDataFrame([(p, c) for p, c, _, k in want if k == 1], "place_id string, candidate_id string")
    shares = {r.threshold: (r.matches, r.found) for r in B.recall(places, candidates, pairs, (30, 86)).collect()}
    assert shares == {30: (sum(s >= 30 for s in everything.values()), pairs.count()), 86: (len(want), pairs.count())}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


names = st.lists(st.text("abé 1", max_size=9), max_size=14)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names, names, st.sampled_from([(1, 2), (2, 2), (2, 3), (3, 2)]))
def test_names_within_equals_all_pairs(spark, left, right, how):
    edits, q = how
    table = lambda xs: spark.createDataFrame([(x, 1) for x in [*xs, None]], "name string, left_name int")
    got = sorted(map(tuple, typos.names_within(table(left), table(right), edits, q).collect()))
    assert got == sorted((a, b, distance(a, b)) for a in set(left) for b in set(right) if distance(a, b) <= edits)


def test_typos_in_real_names(spark):
    rng = random.Random(2)
    base = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    def changed(s):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            s = rng.choice([s[:k] + s[k + 1:], s[:k] + rng.choice("xyz") + s[k:], s[:k] + rng.choice("xyz") + s[k + 1:]])
        return s
    a, b = base + ["aaaa" * 30] * 40, [changed(s) for s in base] + ["aaaa" * 30 + "b"] * 40
    table = lambda xs, p: spark.createDataFrame([(f"{p}{i}", s) for i, s in enumerate(xs)], f"{'query_id' if p == 'q' else 'id'} string, name string")
    got = {tuple(r) for r in typos.typo_search(table(a, "q"), table(b, "c")).collect()}
    clean = lambda s: " ".join(s.split())
    assert len(got) > 1600
    assert got == {(f"q{i}", f"c{j}", distance(clean(x), clean(y))) for i, x in enumerate(a) for j, y in enumerate(b)
                   if clean(x) and clean(y) and abs(len(clean(x)) - len(clean(y))) <= 2 and distance(clean(x), clean(y)) <= 2}
