"""URL filter: rules first, then trust and distrust spread over the links between hosts, with DataFrame functions only.

Trust is a personalised PageRank that starts at hosts with pages allowed by a rule and follows links; distrust starts at hosts
with pages blocked by a rule and follows links backwards, to those who link there. Seeds weigh as their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymerge.plans.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AFTER, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER, 2), F.lit(""))


def _fits(rule: str, host: str, path: str) -> Column:
    name, _, rest = rule.partition("/")
    return ((F.col(host) == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted per pair before they are shuffled."""
    links = pages.where(F.col("html").rlike(LINK)).select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """host, trust, distrust of every host that is reached, from links (src, dst, n) and seeds (host, good, bad).

    Seeds are scaled to sum to 1 per kind. Each round adds, for every host, ``damping`` times the flow from its neighbours, split by
    link counts; it stops after ``rounds`` or when no value moves by more than ``tolerance``. Flow into hosts without further links ends there.
    """
    out, into = F.sum("n").alias("total"), F.sum("n").alias("total")
    forward = links.join(links.groupBy("src").agg(out), "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("total")).alias("good_share"), F.lit(0.0).alias("bad_share"))
    backward = links.join(links.groupBy("dst").agg(into), "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("good_share"), (F.col("n") / F.col("total")).alias("bad_share"))
    flows = written(forward.union(backward).groupBy("a", "b").agg(F.sum("good_share").alias("g"), F.sum("bad_share").alias("d")), "flows")
    totals = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("d")).first()
    start = written(seeds.select("host", (F.col("good") / F.lit(float(totals.g or 1))).alias("good"), (F.col("bad") / F.lit(float(totals.d or 1))).alias("bad")), "seeds")
    base = start.select("host", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust"))
    if flows.isEmpty():
        return base
    ranks = base
    for _ in range(rounds):
        flow = flows.join(ranks, flows["a"] == ranks["host"]).groupBy(F.col("b").alias("host")).agg(
            (damping * F.sum(F.col("g") * F.col("trust"))).alias("trust"), (damping * F.sum(F.col("d") * F.col("distrust"))).alias("distrust"))
        after = written(base.union(flow).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
        before = ranks.toDF("host", "t", "d")
        moved = after.join(before, "host", "left").select(F.max(F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0))) + F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0)))).alias("most")).first().most
        ranks = after
        if (moved or 0) <= tolerance:
            break
    return ranks


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = 1.0) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides (ties: the first given). Without one, a page is blocked if its host's distrust exceeds
    ``limit`` times its trust, and allowed otherwise, also where nothing reaches the host. ``rules`` is a short list, compared in turn.
    A null url, or one without ``://``, has an empty host and path. Null html has no links. Page_ids are only carried along, so
    they may be null or repeat; other columns are not read; an empty table gives an empty result.
    """
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for said, name in sorted(reversed(rules), key=lambda r: len(r[1])):
        rule = F.when(_fits(name, "host", "path"), F.lit(name)).otherwise(rule)
        verdict = F.when(_fits(name, "host", "path"), F.lit(said)).otherwise(verdict)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("rule", rule).withColumn("verdict", verdict)
    seeds = rows.where("host != ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")).where("good + bad > 0")
    ranks = propagate(host_links(pages.select("url", "html")), seeds).withColumnRenamed("host", "__host")
    joined = rows.join(ranks, rows["host"] == ranks["__host"], "left").fillna(0.0, ["trust", "distrust"])
    by_method = F.when(F.col("distrust") > limit * F.col("trust"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), "trust", "distrust")
