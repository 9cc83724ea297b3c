"""Pair scoring: the full profile step by step, and the three other profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymerge.operators import matching as M
from waymerge.functions.text import split_tags

from . import duck as d
from .normalize import _SPECIAL, _VARIATIONS, _canonical_sql, _values
from waymerge.functions import category as C
from .registry import query
from .views import Tables

WEIGHTS = (40, 30, 20, 10)


def places(t: Tables) -> DataFrame:
    return t["places"].withColumn("tags", split_tags(F.col("tags_csv")))


def candidates(t: Tables) -> DataFrame:
    return t["candidates"].withColumn("types", split_tags(F.col("types_csv")))


def scored(t: Tables, options: M.MatchOptions = M.MatchOptions()) -> DataFrame:
    return M.score_pairs(t["pairs"], places(t), candidates(t), options)


def _sim(a: str, b: str) -> str:
    longest = f"cast(greatest(length({a}), length({b})) as double)"
    return d.rounded(f"({longest} - levenshtein({a}, {b})) / {longest} * 100")


_MATCHER = _values(list(C.MATCHER.items()))
_RELATED = _values(sorted({p for k, vs in C.MATCHER_RELATED.items() for v in vs for p in ((k, v), (v, k))}))


def full_sql(weights=WEIGHTS, max_distance: float = 5000) -> str:
    """CTEs ending in ``final``: every score of the full profile."""
    total = sum(weights)
    w = [x if total == 100 else x * (100 / total) for x in weights]
    parts = [("number", 0.3), ("street", 0.4), ("city", 0.2), ("postal", 0.1)]
    return f"""
      pl as (select id, title, address, latitude, longitude, nullif(trim(split_part(coalesce(tags_csv, ''), ',', 1)), '') as cat,
               {d.matcher_name('title')} as nm, {d.matcher_address('address')} as ad from {{places}}),
      cl as (select id, name, address, latitude, longitude, nullif(category, '') as cat,
               {d.matcher_name('name')} as nm, {d.matcher_address('address')} as ad from {{candidates}}),
      {d.address_parts('pl', 'id', 'ad', 'pa')}, {d.address_parts('cl', 'id', 'ad', 'ca')},
      pm(k, v) as (values {_MATCHER}), rel(x, y) as (values {_RELATED}),
      j as (select p.place_id, p.candidate_id, a.title, b.name, a.address as pad, b.address as cad, a.nm as pn, b.nm as cn, a.ad as pa, b.ad as ca,
              x as px, y as cx, a.cat as pcat, b.cat as ccat, b.latitude as clat, b.longitude as clng,
              a.latitude is not null and a.longitude is not null as pco, b.latitude is not null and b.longitude is not null as cco,
              {d.meters('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} as dm,
              coalesce((select v from pm where k = regexp_replace(lower(a.cat), '\\s+', '_', 'g')), 'establishment') as pk,
              coalesce((select v from pm where k = regexp_replace(lower(b.cat), '\\s+', '_', 'g')), 'establishment') as ck
            from {{pairs}} p join pl a on a.id = p.place_id join cl b on b.id = p.candidate_id
            join paparts x on x.key = a.id join caparts y on y.key = b.id),
      n1 as (select *, case when coalesce(title, '') = '' or coalesce(name, '') = '' then 'missing' when trim(title) = trim(name) then 'raw'
                when pn = '' and cn = '' then 'empty' when pn = cn then 'same' else 'compare' end as ncase,
              len(list_filter(string_split_regex(pn, '\\s+'), lambda w: length(w) > 2 and
                  len(list_filter(string_split_regex(cn, '\\s+'), lambda v: contains(v, w) or contains(w, v))) > 0)) as common from j),
      n2 as (select *, case when contains(pn, cn) or contains(cn, pn) then 10 else 0 end + least(20, common * 5) as nbonus, {_sim('pn', 'cn')} as nsim from n1),
      n3 as (select *, case when ncase in ('raw', 'same') then 100 when ncase = 'compare' then least(100, nsim + nbonus) else 0 end as name_score,
              length(regexp_replace(pa, '[^a-z0-9]', '', 'gi')) as pal, length(regexp_replace(ca, '[^a-z0-9]', '', 'gi')) as cal,
              len(list_filter(string_split_regex(pa, '\\s+'), lambda z: z <> '')) as ptok, len(list_filter(string_split_regex(ca, '\\s+'), lambda z: z <> '')) as ctok from n2),
      a1 as (select *, case when coalesce(pad, '') = '' or coalesce(cad, '') = '' then 'missing' when trim(pad) = trim(cad) then 'raw'
                when length(pa) < 4 or length(ca) < 4 then 'length' when pal < 3 or cal < 3 then 'content'
                when (ptok < 3 or ctok < 3) and not contains(pa, ',') and not contains(ca, ',') then 'tokens'
                when pa = ca then 'same' else 'compare' end as acase from n3),
      a2 as (select *,
              case when coalesce(px.number, '') <> '' and coalesce(cx.number, '') <> '' then case when px.number = cx.number then 100 else 0 end end as s_number,
              case when length(coalesce(px.street, '')) >= 3 and length(coalesce(cx.street, '')) >= 3 then {d.edit_similarity('px.street', 'cx.street')} end as s_street,
              case when coalesce(px.city, '') <> '' and coalesce(cx.city, '') <> '' then {d.edit_similarity('px.city', 'cx.city')} end as s_city,
              case when coalesce(px.postal, '') <> '' and coalesce(cx.postal, '') <> '' then case when px.postal = cx.postal then 100 else 0 end end as s_postal from a1),
      a3 as (select *, {' + '.join(f"coalesce(s_{k} * {x}e0, 0e0)" for k, x in parts)} as atotal,
              {' + '.join(f"case when s_{k} is null then 0e0 else {x}e0 end" for k, x in parts)} as aweight, {d.edit_similarity('pa', 'ca')} as asim from a2),
      s1 as (select *, case when acase in ('raw', 'same') then 100 when acase <> 'compare' then 0 when aweight > 0 then {d.rounded('atotal / aweight')}
                when asim >= 70 then asim else 0 end as address_score,
              case when not (pco and cco) then 0 when dm <= 50 then 100 when dm <= {max_distance} then greatest(5, {d.rounded(f'95 - (dm - 50) / ({max_distance}e0 - 50) * 90')}) else 0 end as distance_score,
              case when pcat is null and ccat is null then 50 when pcat is null or ccat is null then 25 when pk = ck then 100
                   when exists (select 1 from rel where rel.x = pk and rel.y = ck) then 75 else 0 end as category_score from a3),
      s2 as (select *, name_score * {w[0]}e0 / 100 + address_score * {w[1]}e0 / 100 + distance_score * {w[2]}e0 / 100 + category_score * {w[3]}e0 / 100 as raw_score,
              case when pn <> '' then 25 else 0 end + case when pa <> '' then 20 else 0 end + case when pco then 15 else 0 end + case when pcat is not null then 10 else 0 end
              + case when coalesce(name, '') <> '' then 15 else 0 end + case when coalesce(cad, '') <> '' then 10 else 0 end
              + case when coalesce(clat, 0) <> 0 and coalesce(clng, 0) <> 0 then 5 else 0 end as completeness,
              case when not (pco and cco) then 0 when distance_score >= 90 then 95 when distance_score >= 70 then 80 when distance_score >= 50 then 60 else 30 end as geo_reliability,
              (name_score + address_score + distance_score + category_score) / 4e0 as mean from s1),
      s3 as (select *, sqrt(((name_score - mean) * (name_score - mean) + (address_score - mean) * (address_score - mean)
              + (distance_score - mean) * (distance_score - mean) + (category_score - mean) * (category_score - mean)) / 4e0) as spread from s2),
      c1 as (select *, cast(greatest(0, {d.rounded('100 - spread * 2')}) as bigint) as consistency,
              case when raw_score >= 50 and completeness < 20 then -{d.rounded('(20 - completeness) * 0.15e0')} end as j1,
              case when raw_score >= 70 and spread > 50 then -{d.rounded('(spread - 50) * 0.1e0')} when spread < 3 and raw_score > 85 then {d.rounded('(3 - spread) * 0.1e0')} end as j2,
              case when raw_score >= 50 and geo_reliability < 10 then -{d.rounded('(10 - geo_reliability) * 0.2e0')} end as j3,
              case when not (pco and cco) and not pco then 4 end as j4, case when raw_score >= 99 and completeness >= 95 then 1 end as j5 from s3),
      c2 as (select *, raw_score + coalesce(j1, 0) + coalesce(j2, 0) + coalesce(j3, 0) + coalesce(j4, 0) + coalesce(j5, 0) as sofar from c1),
      c3 as (select *, case when name_score = 100 and address_score = 100 and sofar < 85 then 85 - {d.rounded('sofar')} end as j6,
              case when raw_score >= 95 and completeness < 30 then -{d.rounded('(95 - completeness) * 0.05e0')} end as j7 from c2),
      final as (select *, greatest(0, least(100, {d.rounded('sofar + coalesce(j6, 0) + coalesce(j7, 0)')})) as confidence_score from c3)"""


def _full(select: str, **options) -> str:
    return f"with {full_sql(**options)}\n{select}"


@query("m2_m3_name_factor", _full("""
    select place_id, candidate_id, ncase as name_case, case when ncase = 'compare' then nsim end as name_similarity,
           case when ncase = 'compare' then nbonus end as name_bonus, name_score from final"""))
def _(t):
    return scored(t).select("place_id", "candidate_id", "name_case", "name_similarity",
                            F.when(F.col("name_case") == "compare", F.col("name_bonus")).alias("name_bonus"), "name_score")


@query("m4_address_factor", _full("""
    select place_id, candidate_id, address_score, case when acase = 'compare' then s_number end as number, case when acase = 'compare' then s_street end as street,
           case when acase = 'compare' then s_city end as city, case when acase = 'compare' then s_postal end as postal from final"""))
def _(t):
    return scored(t).select("place_id", "candidate_id", "address_score", "address_parts.*")


@query("m5_distance_factor", _full("select place_id, candidate_id, round(case when pco and cco then dm end, 3) as meters, distance_score from final", max_distance=2500))
def _(t):
    return scored(t, M.MatchOptions(max_distance=2500)).select(
        "place_id", "candidate_id", F.round("distance_m", 3).alias("meters"), "distance_score")


@query("m6_category_factor", _full("select place_id, candidate_id, category_score from final"))
def _(t):
    return scored(t).select("place_id", "candidate_id", "category_score")


@query("m1_m7_raw_score", _full("select place_id, candidate_id, round(raw_score, 6) as raw_score from final", weights=(30, 30, 30, 30)))
def _(t):
    equal = M.MatchOptions(weights=M.Weights(30, 30, 30, 30))
    return scored(t, equal).select("place_id", "candidate_id", F.round("raw_score", 6).alias("raw_score"))


@query("m8_quality_indicators", _full("select place_id, candidate_id, completeness, consistency, geo_reliability, round(spread, 6) as score_spread from final"))
def _(t):
    return scored(t).select("place_id", "candidate_id", "completeness", "consistency", "geo_reliability",
                            F.round("score_spread", 6).alias("score_spread"))


@query("m9_calibration", _full("""
    select place_id, candidate_id, confidence_score, concat_ws(',', 'data_completeness:' || j1, 'match_consistency:' || j2, 'geographic_reliability:' || j3,
        'missing_distance_neutral:' || j4, 'perfect_match_bonus:' || j5, 'exact_name_address_floor:' || j6, 'high_score_data_penalty:' || j7) as adjustments from final"""))
def _(t):
    text = F.transform("adjustments", lambda a: F.concat_ws(":", a["factor"], a["adjustment"].cast("string")))
    return scored(t).select("place_id", "candidate_id", "confidence_score", F.array_join(text, ",").alias("adjustments"))


@query("m10_confidence_level", _full("""
    select case when confidence_score >= 90 then 'high' when confidence_score >= 70 then 'medium' else 'low' end as level, count(*) as pairs, sum(confidence_score) as total
    from final group by 1"""))
def _(t):
    return scored(t).groupBy(F.col("confidence_level").alias("level")).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("confidence_score").alias("total"))


@query("m11_explanations", _full("""
    select place_id, candidate_id,
      case ncase when 'missing' then 'Missing name data' when 'raw' then 'Exact raw name match' when 'empty' then 'Empty names after normalization'
        when 'same' then 'Exact name match' else 'Name similarity: ' || nsim || '% (distance: ' || levenshtein(pn, cn) || ', bonus: ' || nbonus || ')' end as name,
      case acase when 'missing' then 'Missing address data' when 'raw' then 'Exact raw address match' when 'length' then 'Insufficient address data for reliable comparison'
        when 'content' then 'Insufficient address content for reliable comparison' when 'tokens' then 'Insufficient address tokens for reliable comparison'
        when 'same' then 'Exact address match' else case when aweight > 0 then 'Address component matching: ' || address_score || '%'
          when address_score > 0 then 'Full address similarity: ' || asim || '%' else 'No comparable address components' end end as address,
      case when not (pco and cco) then 'No coordinates available for distance calculation' when dm < 50 then 'Very close match (' || cast(floor(dm + 0.5) as bigint) || 'm)'
        when dm < 500 then 'Close match (' || cast(floor(dm + 0.5) as bigint) || 'm)' when dm < 2000 then 'Moderate distance (' || format('{{:.1f}}', dm / 1000) || 'km)'
        else 'Far distance (' || format('{{:.1f}}', dm / 1000) || 'km)' end as distance,
      case when pcat is null and ccat is null then 'No category information available' when pcat is null or ccat is null then 'Partial category information'
        when category_score = 100 then 'Exact category match' when category_score > 50 then 'Related category match' else 'Different categories' end as category
    from final"""))
def _(t):
    df = M.explain_factors(scored(t))
    text = lambda i: F.get("factors", F.lit(i))["explanation"]
    return df.select("place_id", "candidate_id", *[text(i).alias(f) for i, f in enumerate(M.FACTORS)])


_TOTAL = "(name_score * 0.4e0 + address_score * 0.3e0 + distance_score * 0.2e0 + category_score * 0.1e0)"


def _trust(f: str, high: int, mid: int) -> str:
    return f"case when {f}_score >= {high} then 'high' when {f}_score >= {mid} then 'medium' else 'low' end"


@query("m12_m13_contributions", _full(f"""
    , k1 as (select *, case when {_TOTAL} > 0 then [{', '.join(f"{f}_score * {w}e0 / 100 / (name_score * 40e0 / 100 + address_score * 30e0 / 100 + distance_score * 20e0 / 100 + category_score * 10e0 / 100) * 100" for f, w in zip(M.FACTORS, WEIGHTS))}]
        else [25e0, 25e0, 25e0, 25e0] end as shares from final),
    k2 as (select *, list_transform(shares, lambda x: cast(floor(x + 0.5) as bigint)) as r, list_position(shares, list_max(shares)) as top from k1),
    k3 as (select *, list_transform(range(1, 5), lambda i: r[i] + case when i = top then 100 - (r[1] + r[2] + r[3] + r[4]) else 0 end) as fixed from k2)
    select place_id, candidate_id, array_to_string(list_transform(fixed, lambda x: greatest(0, least(100, x))), ',') as contributions,
       concat_ws(',', {_trust('name', 90, 60)}, {_trust('address', 85, 50)}, {_trust('distance', 80, 40)}, {_trust('category', 75, 25)}) as reliability from k3""").replace("\n\n", "\n"))
def _(t):
    df = M.explain_factors(scored(t))
    return df.select(
        "place_id", "candidate_id",
        F.array_join(F.transform("factors", lambda f: f["contribution"].cast("string")), ",").alias("contributions"),
        F.array_join(F.transform("factors", lambda f: f["reliability"]), ",").alias("reliability"))


@query("m14_issues", _full("""
    , i as (select *, concat_ws(', ', case when name_score < 30 then 'name' end, case when address_score < 30 then 'address' end) as low from final)
    select place_id, candidate_id, concat_ws(';', case when completeness < 50 then 'Incomplete place data may affect match accuracy' end,
        case when spread > 30 then 'High variance between matching factors' end,
        case when not (pco and cco) then 'No geographic coordinates available for distance matching' end,
        case when low <> '' then 'Low scores in important factors: ' || low end,
        case when greatest(abs(coalesce(j1, 0)), abs(coalesce(j2, 0)), abs(coalesce(j3, 0)), abs(coalesce(j6, 0)), abs(coalesce(j7, 0))) > 5
             then 'Significant calibration adjustments applied to raw score' end) as issues,
        cast(completeness < 50 as int) + cast(spread > 30 as int) + cast(not (pco and cco) as int) + cast(low <> '' as int)
        + cast(greatest(abs(coalesce(j1, 0)), abs(coalesce(j2, 0)), abs(coalesce(j3, 0)), abs(coalesce(j6, 0)), abs(coalesce(j7, 0))) > 5 as int) as advice from i"""))
def _(t):
    df = M.issues_and_advice(scored(t))
    return df.select("place_id", "candidate_id", F.array_join("issues", ";").alias("issues"), F.size("recommendations").alias("advice"))


@query("f11_w1_ranked_matches", _full("""
    select place_id, candidate_id, confidence_score, row_number() over (partition by place_id order by confidence_score desc, candidate_id) as match_rank
    from final where confidence_score >= 30"""))
def _(t):
    return M.ranked_matches(scored(t)).select("place_id", "candidate_id", "confidence_score", "match_rank")


@query("w2_best_match", _full("""
    select place_id, arg_min(candidate_id, (-confidence_score, candidate_id)) as candidate_id, max(confidence_score) as confidence_score
    from final where confidence_score >= 30 group by place_id"""))
def _(t):
    return M.best_matches(scored(t)).select("place_id", "candidate_id", "confidence_score")


@query("a22_match_summary", _full("""
    select place_id, count(*) as total_candidates, count(case when confidence_score >= 30 then 1 end) as valid_matches,
           coalesce(cast(floor(avg(case when confidence_score >= 30 then confidence_score end) + 0.5) as bigint), 0) as average_confidence,
           arg_min(case when confidence_score >= 30 then candidate_id end, (-confidence_score, candidate_id)) filter (where confidence_score >= 30) as best_candidate_id
    from final group by place_id"""))
def _(t):
    return M.match_summary(scored(t))


_LIGHT = f"""
    a as (select p.place_id, p.candidate_id, x.title, y.name, x.address as pa, y.address as ca, {d.trimmed('lower(x.title)')} as tl, {d.trimmed('lower(y.name)')} as nl,
        {d.trimmed('lower(x.address)')} as al, {d.trimmed('lower(y.address)')} as bl, x.latitude as lat, x.longitude as lng, y.latitude as clat, y.longitude as clng,
        list_filter(string_split(coalesce(lower(x.tags_csv), ''), ','), lambda z: z <> '') as pt, list_filter(string_split(coalesce(lower(y.types_csv), ''), ','), lambda z: z <> '') as ct
        from {{pairs}} p join {{places}} x on x.id = p.place_id join {{candidates}} y on y.id = p.candidate_id
        where strip_accents(x.title || y.name) = x.title || y.name and not contains(x.title || y.name, 'ß')),
    b as (select *, case when coalesce(title, '') = '' or coalesce(name, '') = '' then 0 when tl = nl then 100 else {_sim('tl', 'nl')} end as ns,
        case when coalesce(pa, '') = '' or coalesce(ca, '') = '' then null when al = bl then 100 else {_sim('al', 'bl')} end as sa,
        case when lat <> 0 and lng <> 0 and clat <> 0 and clng <> 0 then greatest(0, {d.rounded(f"(1000e0 - {d.meters('lat', 'lng', 'clat', 'clng')}) / 1000e0 * 100")}) end as sd,
        len(list_filter(pt, lambda u: len(list_filter(ct, lambda v: contains(u, v) or contains(v, u))) > 0)) as shared from a),
    c as (select *, case when len(pt) = 0 or len(ct) = 0 then 50 when shared > 0 then {d.rounded('shared / greatest(len(pt), len(ct)) * 100')} else 0 end as sc from b)"""


@query("m15_light_profile", f"""
    with {_LIGHT}
    select place_id, candidate_id, ns as name_score, sa as address_score, sd as distance_score, sc as category_score,
        {d.rounded('ns * 40e0 / 100 + coalesce(sa * 30e0 / 100, 0) + coalesce(sd * 20e0 / 100, 0) + sc * 10e0 / 100')} as confidence_score from c""")
def _(t):
    # the comparison engine measures edits in bytes, so both sides keep plain-letter names
    df = M.score_light(t["pairs"], places(t), candidates(t))
    from waymerge.functions.text import strip_marks
    both = F.concat("p_title", "c_title")
    plain = (strip_marks(both) == both) & ~both.contains("ß")
    return df.where(plain).select("place_id", "candidate_id", "name_score", "address_score", "distance_score", "category_score", "confidence_score")


@query("m16_normalized_profile", f"""
    with src as (select id, category from {{places}} union all select id, category from {{candidates}}), {_canonical_sql('category', 'src', 'id')},
    v(k, terms) as (select k, string_split(x, '|') from (values {_VARIATIONS}) y(k, x)), special(a, b, score) as (values {_SPECIAL}),
    j as (select p.place_id, p.candidate_id, {d.canonical_name('x.title')} as pn, {d.canonical_name('y.name')} as cn, {d.canonical_address('x.address')} as pa, {d.canonical_address('y.address')} as ca,
        x.latitude is not null and x.longitude is not null and abs(x.latitude) <= 90 and y.longitude is not null as placed,
        {d.meters('x.latitude', 'x.longitude', 'y.latitude', 'y.longitude')} as dm, k1.canonical as kp, k2.canonical as kc, v1.terms as tp, v2.terms as tc
        from {{pairs}} p join {{places}} x on x.id = p.place_id join {{candidates}} y on y.id = p.candidate_id
        join canon k1 on k1.key = x.id join canon k2 on k2.key = y.id join v v1 on v1.k = k1.canonical join v v2 on v2.k = k2.canonical),
    s as (select *, {d.edit_similarity('pn', 'cn')} as name_score, {d.edit_similarity('pa', 'ca')} as address_score, case when placed then greatest(0, 100 - dm / 50) else 0 end as ds,
        case when kp = kc then 100 when list_contains(tp, kc) or list_contains(tc, kp) then 75
             when len(list_filter(list_intersect(tp, tc), lambda z: z <> 'establishment')) > 0 then 60
             else coalesce((select max(score) from special q where q.a = kp and q.b = kc), 0) end as category_score from j)
    select place_id, candidate_id, name_score, address_score, {d.rounded('ds')} as distance_score, category_score,
        {d.rounded('name_score * 0.4e0 + address_score * 0.3e0 + ds * 0.2e0 + category_score * 0.1e0')} as confidence_score from s""")
def _(t):
    df = M.score_normalized(t["pairs"], places(t), candidates(t))
    return df.select("place_id", "candidate_id", "name_score", "address_score", "distance_score", "category_score", "confidence_score")


@query("m17_provider_profile", f"""
    with j as (select p.place_id, p.candidate_id, {d.provider_name('x.title')} as pn, {d.provider_name('y.name')} as cn, {d.provider_address('x.address')} as pa, {d.provider_address('y.address')} as ca,
        coalesce(x.latitude, 0) <> 0 and coalesce(x.longitude, 0) <> 0 as placed, y.longitude is null as lost, y.category,
        {d.meters('x.latitude', 'x.longitude', 'y.latitude', 'y.longitude')} as dm
        from {{pairs}} p join {{places}} x on x.id = p.place_id join {{candidates}} y on y.id = p.candidate_id)
    select place_id, candidate_id, case when placed and lost then null else least(100, {d.rounded(f"({d.edit_similarity('pn', 'cn')} * 40 + {d.edit_similarity('pa', 'ca')} * 30 + case when placed then least(100, greatest(0, 100 - dm / 100)) * 20 else 0 end + case when coalesce(category, '') <> '' then 500 else 0 end) / case when placed then 100 else 80 end")}) end as confidence_score from j""")
def _(t):
    return M.score_provider(t["pairs"], places(t), candidates(t)).select("place_id", "candidate_id", "confidence_score")
