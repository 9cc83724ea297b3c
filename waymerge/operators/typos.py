"""Names within a few edits of each other: a join on rare positional q-grams with length and position filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import matcher_name
from ..plans.storage import written

_BEFORE, _AFTER = "\u0001", "\u0002"  # pad a name, so its ends count as grams too


def _all_grams(name: Column, q: int) -> Column:
    """Structs (pos, gram) of a padded name: length + q - 1 of them."""
    padded = F.concat(F.lit(_BEFORE * (q - 1)), name, F.lit(_AFTER * (q - 1)))
    return F.transform(
        F.sequence(F.lit(1), F.length(name) + (q - 1)),
        lambda i: F.struct(i.alias("pos"), F.substring(padded, i, F.lit(q)).alias("gram")),
    )


def _shorter(names: Column) -> Column:
    """Every string that is one of ``names`` less one character."""
    def less_one(s: Column) -> Column:
        return F.when(F.length(s) > 0, F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
        )).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(names, less_one)))


def _rare_grams(names: DataFrame, uses: DataFrame, q: int, edits: int) -> DataFrame:
    """(name, len, pos, gram): each name's ``q * edits + 1`` rarest grams, with all that tie with the last of them.

    An edit touches q grams at most, so one of them survives in a name within ``edits``; it stands among that name's rarest too.
    """
    grams = names.select("name", F.explode(_all_grams(F.col("name"), q)).alias("g")).select("name", "g.pos", "g.gram")
    ranked = grams.join(uses, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("uses", "gram", "pos"))).alias("gs"))
    last = F.get("gs", F.least(F.lit(q * edits), F.size("gs") - 1))
    ranked = ranked.withColumn("last", F.struct(last["uses"].alias("uses"), last["gram"].alias("gram")))
    kept = F.filter("gs", lambda g: F.struct(g["uses"].alias("uses"), g["gram"].alias("gram")) <= F.col("last"))
    return ranked.select("name", F.length("name").alias("len"), F.explode(kept).alias("g")).select("name", "len", "g.pos", "g.gram")


def names_within(left: DataFrame, right: DataFrame, edits: int = 2, q: int = 2) -> DataFrame:
    """(left_name, right_name, edits) for all distinct names of the two tables (column ``name``) at most ``edits`` edits apart.

    Equal names are 0 apart; null names meet nothing; empty names are names. Names meet on a gram, the length (the left side is copied to the
    lengths that may match) and a position no further off than the edits; only pairs that meet are compared. Names too short to keep a gram
    meet on what is left after deleting up to ``edits`` characters. Common grams are keys only of names made of nothing else.
    """
    if edits < 1 or q < 2:
        raise ValueError("edits must be 1 or more and q 2 or more")
    # written, since each is used several times: else every use would read and clean all texts again, in one very large plan
    l, r = (written(side.where(F.col("name").isNotNull()).select("name").distinct(), "names") for side in (left, right))
    gram = F.explode(F.transform(_all_grams(F.col("name"), q), lambda g: g["gram"])).alias("gram")
    uses = written(l.unionAll(r).select(gram).groupBy("gram").agg(F.count(F.lit(1)).alias("uses")), "gram-uses")
    copied = _rare_grams(l, uses, q, edits).withColumn("at", F.explode(F.sequence(F.greatest(F.col("len") - edits, F.lit(0)), F.col("len") + edits)))
    a = copied.select(F.col("name").alias("left_name"), F.col("pos").alias("left_pos"), "gram", "at")
    b = _rare_grams(r, uses, q, edits).select(F.col("name").alias("right_name"), F.col("pos").alias("right_pos"), "gram", F.col("len").alias("at"))
    apart = F.levenshtein("left_name", "right_name", edits)
    met = a.join(b, ["gram", "at"]).where(F.abs(F.col("left_pos") - F.col("right_pos")) <= edits).select("left_name", "right_name")

    def cut(side: DataFrame, who: str) -> DataFrame:
        short = side.where(F.length("name") <= q * edits - q + 1)
        every = level = F.array("name")
        for _ in range(edits):
            level = _shorter(level)
            every = F.concat(every, level)
        return short.select(F.col("name").alias(who), F.explode(F.array_distinct(every)).alias("rest"))

    short = cut(l, "left_name").join(cut(r, "right_name"), "rest").select("left_name", "right_name")
    return written(met.unionAll(short).withColumn("edits", apart).where("edits >= 0").distinct(), "close-names")


def typo_search(queries: DataFrame, candidates: DataFrame, edits: int = 2) -> DataFrame:
    """(query_id, candidate_id, edits): candidates whose matcher name is within ``edits`` of the query's (query_id, name).

    Names are compared once however many records bear them; empty names are not searched for.
    """
    q = written(queries.select("query_id", matcher_name(F.col("name")).alias("name")).where("name <> ''"), "query-names")
    c = written(candidates.select(F.col("id").alias("candidate_id"), matcher_name(F.col("name")).alias("name")).where("name <> ''"), "candidate-names")
    pairs = names_within(q, c, edits)
    return (
        q.withColumnRenamed("name", "left_name").join(pairs, "left_name")
        .join(c.withColumnRenamed("name", "right_name"), "right_name").select("query_id", "candidate_id", "edits")
    )
