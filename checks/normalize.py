"""Text, address, coordinate, category, date and link columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymerge.functions import address as A, category as C, dates as D, geo as G, text as T, urls as U
from waymerge.functions.numbers import leading_number, pct_change, round_half_up
from waymerge.operators import filters
from waymerge.operators.records import normalize_records

from . import duck as d
from .registry import query
from .views import Tables


def _texts(t: Tables, **columns) -> DataFrame:
    return t["documents"].select("doc_id", *[c.alias(k) for k, c in columns.items()])


@query("g1_dedupe_key", f"select doc_id, {d.dedupe_key('text')} as key from documents")
def _(t):
    return _texts(t, key=T.dedupe_key(F.col("text")))


@query("g2_canonical_name", f"select doc_id, {d.canonical_name('text')} as name from documents")
def _(t):
    return _texts(t, name=T.canonical_name(F.col("text")))


@query("g3_matcher_name", f"select doc_id, {d.matcher_name('text')} as name from documents")
def _(t):
    return _texts(t, name=T.matcher_name(F.col("text")))


@query("g4_provider_name", f"select doc_id, {d.provider_name('text')} as name from documents")
def _(t):
    return _texts(t, name=T.provider_name(F.col("text")))


_FORMS = {"g5_canonical_address": (A.canonical_address, d.canonical_address),
          "g6_matcher_address": (A.matcher_address, d.matcher_address),
          "g7_provider_address": (A.provider_address, d.provider_address)}
for _name, (_spark, _duck) in _FORMS.items():
    @query(_name, "select id, {} as form from {{places}} union all select id, {} from {{candidates}}".format(_duck("address"), _duck("address")))
    def _(t, spark=_spark):
        both = t["places"].select("id", "address").unionAll(t["candidates"].select("id", "address"))
        return both.select("id", spark(F.col("address")).alias("form"))


@query("g8_plain_letters", f"select doc_id, {d.letters('lower(text)')} as plain from documents")
def _(t):
    return _texts(t, plain=T.plain_letters(F.lower("text")))


@query("g9_standard_symbols", """
    select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s*&\\s*', ' and ', 'g'),
        '\\s*\\+\\s*', ' and ', 'g'), '[–—]', '-', 'g'), '[™®©]', '', 'g'), '\\s+', ' ', 'g') as text from documents""")
def _(t):
    return _texts(t, text=T.standard_symbols(F.col("text")))


@query("g10_trailing_suffix", f"""
    select id, {d.trimmed(d.sub('lower(name)', rf'\b({d.SUFFIXES})\b\.?\s*$', ''))} as name from {{candidates}}""")
def _(t):
    return t["candidates"].select("id", T.drop_trailing_suffix(F.lower("name")).alias("name"))


@query("g11_name_words", """
    select p_partkey, regexp_replace(regexp_replace(case p_size % 4 when 0 then 'St. ' when 1 then 'Mt ' when 2 then 'Intl ' else 'St ' end || p_name,
        '\\bst\\b', 'saint', 'gi'), '\\bmt\\b|\\bintl\\b', case p_size % 4 when 1 then 'mount' else 'international' end, 'gi') as name from part""")
def _(t):
    lead = F.expr("case p_size % 4 when 0 then 'St. ' when 1 then 'Mt ' when 2 then 'Intl ' else 'St ' end || p_name")
    return t["part"].select("p_partkey", T.expand_name_words(lead).alias("name"))


@query("g12_search_tokens", f"""
    with a as (select id, {d.canonical_name('title')} as n from {{places}}),
    b as (select id, n, list_filter(string_split_regex(n, '\\s+'), lambda w: length(w) >= 2) as w from a),
    one as (select id, n as token from b union select id, unnest(w) from b
            union select id, array_to_string(w[i:j], ' ') from b, range(1, 60) r(i), range(1, 60) s(j)
                  where i < len(w) and j >= i and j <= len(w) and length(array_to_string(w[i:j], ' ')) >= 3)
    select id, count(*) as tokens, max(length(token)) as longest, string_agg(token, '|' order by token) as joined from one group by id""")
def _(t):
    tokens = t["places"].select("id", T.search_tokens(F.col("title")).alias("tokens"))
    return tokens.select("id", F.size("tokens").alias("tokens"), F.length(F.get("tokens", F.lit(0))).alias("longest"),
                         F.array_join(F.array_sort("tokens"), "|").alias("joined"))


@query("g13_address_parts", f"""
    with src as (select id, address from {{places}} union all select id, address from {{candidates}}),
    {d.address_parts('src', 'id', 'address', 'x')}
    select key as id, number, street, city, region, country, postal from xparts""")
def _(t):
    both = t["places"].select("id", "address").unionAll(t["candidates"].select("id", "address"))
    return A.with_address_parts(both, "address", "parts").select("id", "parts.*")


@query("g14_postal_code", f"select id, {d.postal('address')} as postal from {{places}}")
def _(t):
    return t["places"].select("id", A.postal_code(F.col("address")).alias("postal"))


@query("g15_edit_similarity", f"""
    with a as (select p.place_id, p.candidate_id, {d.matcher_name('x.title')} as m, {d.matcher_name('y.name')} as n
               from {{pairs}} p join {{places}} x on x.id = p.place_id join {{candidates}} y on y.id = p.candidate_id)
    select place_id, candidate_id, {d.edit_similarity('m', 'n')} as similarity from a""")
def _(t):
    p = t["places"].select(F.col("id").alias("place_id"), T.matcher_name(F.col("title")).alias("m"))
    c = t["candidates"].select(F.col("id").alias("candidate_id"), T.matcher_name(F.col("name")).alias("n"))
    return t["pairs"].join(p, "place_id").join(c, "candidate_id").select(
        "place_id", "candidate_id", T.edit_similarity(F.col("m"), F.col("n")).alias("similarity"))


@query("g16_jaro_winkler", f"""
    with names as (select distinct p_name, p_brand from part),
    src as (select distinct x.p_name as a, y.p_name as b from names x join names y on x.p_brand = y.p_brand where x.p_name < y.p_name),
    {d.jaro_winkler('src', 'k')}
    select a, b, round(score, 9) as similarity from ksim""")
def _(t):
    names = t["part"].select("p_name", "p_brand").distinct()
    pairs = names.select(F.col("p_name").alias("a"), "p_brand").join(
        names.select(F.col("p_name").alias("b"), "p_brand"), "p_brand").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(C.jaro_winkler_similarity("a", "b"), 9).alias("similarity"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _canonical_sql(column: str, source: str, key: str) -> str:
    """Direct, reverse, then fuzzy lookup over a list of (position, canonical, term)."""
    terms, pos = [], 0
    for name, listed in C.CANONICAL.items():
        for term in [name, *listed]:
            terms.append((pos, name, term))
            pos += 1
    return f"""
      terms(pos, canon, term) as (values {_values(terms)}),
      slugs as (select {key} as key, {column} as raw, regexp_replace(lower({column}), '\\s+', '_', 'g') as slug from {source}),
      fresh as (select distinct slug from slugs where slug <> '' and slug not in (select term from terms)),
      compared as (select distinct slug as a, term as b from fresh, terms),
      {d.jaro_winkler('compared', 'f')},
      fuzzy as (select a as slug, arg_max(canon, (score, -pos)) as canon
                from fsim join terms on term = b where score >= 0.7 group by a),
      canon as (select key, raw, slug, case when coalesce(slug, '') = '' then 'establishment' when slug = 'fast_food' then 'restaurant'
                  else coalesce((select min(canon) from terms where canon = slug),
                                (select arg_min(canon, pos) from terms where term = slug),
                                (select canon from fuzzy f where f.slug = slugs.slug), 'establishment') end as canonical from slugs)"""


@query("g17a_canonical_category", f"""
    with src as (select id, category from {{places}} union all select id, types_csv from {{candidates}}
                 union all select 'r' || cast(p_partkey as string), lower(p_type) || ' ' || p_name from part),
    {_canonical_sql('category', 'src', 'id')}
    select key as id, canonical from canon""")
def _(t):
    src = t["places"].select("id", "category").unionAll(t["candidates"].select("id", "types_csv")).unionAll(
        t["part"].select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")), F.concat_ws(" ", F.lower("p_type"), "p_name")))
    return C.with_canonical_category(src, "category", "canonical").select("id", "canonical")


@query("g17b_matcher_category", f"""
    with m(k, v) as (values {_values(list(C.MATCHER.items()))})
    select id, case when coalesce(category, '') = '' then 'establishment' else
        coalesce((select v from m where k = regexp_replace(lower(category), '\\s+', '_', 'g')), 'establishment') end as category from {{places}}""")
def _(t):
    return t["places"].select("id", C.matcher_category(F.col("category")).alias("category"))


@query("g17c_provider_category", f"""
    with m(k, v) as (values {_values(list(C.PROVIDER.items()))})
    select id, coalesce((select v from m where k = regexp_replace(lower(category), '\\s+', '_', 'g')), 'establishment') as category from {{places}}""")
def _(t):
    return t["places"].select("id", C.provider_category(F.col("category")).alias("category"))


_VARIATIONS = _values([(k, "|".join(v)) for k, v in C.CANONICAL.items()])


@query("g18_variations", f"""
    with src as (select id, category from {{places}}), {_canonical_sql('category', 'src', 'id')}, v(k, terms) as (values {_VARIATIONS})
    select key as id, (select terms from v where k = case canonical when 'fast_food' then 'restaurant' else canonical end) as terms from canon""")
def _(t):
    df = C.with_canonical_category(t["places"].select("id", "category"), "category", "canonical")
    return df.select("id", F.array_join(C.canonical_variations(F.col("canonical")), "|").alias("terms"))


_SPECIAL = _values([(a, b, s) for (a, b), s in C.CANONICAL_PAIRS.items()] + [(b, a, s) for (a, b), s in C.CANONICAL_PAIRS.items()])


@query("g19_category_similarity", f"""
    with v(k, terms) as (select k, string_split(x, '|') from (values {_VARIATIONS}) y(k, x)), special(a, b, score) as (values {_SPECIAL}),
    used as (select distinct regexp_replace(lower(category), ' ', '_') as c from {{places}} where category is not null),
    keys as (select k, terms from v where k in (select c from used))
    select x.k as a, y.k as b, case when x.k = y.k then 100 when list_contains(x.terms, y.k) or list_contains(y.terms, x.k) then 75
        when len(list_filter(list_intersect(x.terms, y.terms), lambda z: z <> 'establishment')) > 0 then 60
        else coalesce((select max(score) from special s where s.a = x.k and s.b = y.k), 0) end as similarity
    from keys x, keys y where x.k <> 'fast_food' and y.k <> 'fast_food'""")
def _(t):
    used = t["places"].select(C.slug(F.col("category")).alias("c")).where(
        F.col("c").isin(*C.CANONICAL) & (F.col("c") != "fast_food")).distinct()
    a = used.select(F.col("c").alias("a"), C.canonical_variations(F.col("c")).alias("ta"))
    # pairs of the fixed taxonomy only: at most 43 x 43
    every = F.array(*[F.lit(k) for k in C.CANONICAL if k != "fast_food"])
    pairs = a.withColumn("b", F.explode(every)).join(used.select(F.col("c").alias("b")), "b", "left_semi")
    pairs = pairs.withColumn("tb", C.canonical_variations(F.col("b")))
    return pairs.select("a", "b", C.canonical_similarity(F.col("a"), F.col("b"), F.col("ta"), F.col("tb")).alias("similarity"))


@query("g20_haversine", f"""
    select p.place_id, p.candidate_id, round({d.meters('x.latitude', 'x.longitude', 'y.latitude', 'y.longitude')}, 3) as meters
    from {{pairs}} p join {{places}} x on x.id = p.place_id join {{candidates}} y on y.id = p.candidate_id""")
def _(t):
    p = t["places"].select(F.col("id").alias("place_id"), F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    c = t["candidates"].select(F.col("id").alias("candidate_id"), F.col("latitude").alias("c"), F.col("longitude").alias("d"))
    return t["pairs"].join(p, "place_id").join(c, "candidate_id").select(
        "place_id", "candidate_id", F.round(G.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 3).alias("meters"))


@query("g21_coordinate_rounding", """
    select event_id, floor((value / 7) * 1000000 + 0.5) / 1000000 as up, floor((value / -7) * 1000000 + 0.5) / 1000000 as down from events""")
def _(t):
    return t["events"].select("event_id", G.round6(F.col("value") / 7).alias("up"), G.round6(F.col("value") / -7).alias("down"))


@query("g22_percentage_change", """
    with d as (select cast(ts as date) as day, event_type, count(case when value > 100 then 1 end) as n from events group by 1, 2),
    p as (select event_type, sum(case when day < date '2024-01-16' then n else 0 end) as old, sum(case when day >= date '2024-01-16' then n else 0 end) as new from d group by 1)
    select event_type, round(case when old = 0 then case when new > 0 then 100.0 else 0.0 end else (new - old) / old * 100.0 end, 6) as change from p""")
def _(t):
    early = F.col("ts").cast("date") < F.lit("2024-01-16").cast("date")
    sums = t["events"].where("value > 100").groupBy("event_type").agg(
        F.count_if(early).alias("old"), F.count_if(~early).alias("new"))
    every = t["events"].select("event_type").distinct().join(sums, "event_type", "left").fillna(0)
    return every.select("event_type", F.round(pct_change(F.col("old"), F.col("new")), 6).alias("change"))


@query("g23_day_and_minute_keys", """
    select event_id, strftime(ts, '%Y-%m-%d') as day_key, strftime(ts, '%Y-%m-%d_%H-%M') as minute_key,
           cast(greatest(ceil(86400 - (hour(ts) * 3600 + minute(ts) * 60 + (microsecond(ts) / 1000000.0))), 60) as int) as to_midnight from events""")
def _(t):
    return t["events"].select("event_id", D.day_key(F.col("ts")).alias("day_key"), D.minute_key(F.col("ts")).alias("minute_key"),
                              D.seconds_to_next_day(F.col("ts")).alias("to_midnight"))


@query("g24_safe_iso", """
    select event_id, coalesce(strftime(try_cast(case when event_id % 7 = 0 then 'not a date' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp),
        '%Y-%m-%dT%H:%M:%S.000Z'), '1970-01-01T00:00:00.000Z') as iso from events""")
def _(t):
    text = F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t["events"].select("event_id", D.safe_iso(text).alias("iso"))


@query("g26_url_coordinates", r"""
    select page_id,
        cast(coalesce(nullif(regexp_extract(url, '@(-?\d+\.?\d*),(-?\d+\.?\d*)', 1), ''), nullif(regexp_extract(url, '[?&]ll=(-?\d+\.?\d*),(-?\d+\.?\d*)', 1), ''),
             nullif(regexp_extract(url, 'query=(-?\d+\.?\d*),(-?\d+\.?\d*)', 1), '')) as double) as latitude,
        cast(coalesce(nullif(regexp_extract(url, '@(-?\d+\.?\d*),(-?\d+\.?\d*)', 2), ''), nullif(regexp_extract(url, '[?&]ll=(-?\d+\.?\d*),(-?\d+\.?\d*)', 2), ''),
             nullif(regexp_extract(url, 'query=(-?\d+\.?\d*),(-?\d+\.?\d*)', 2), '')) as double) as longitude
    from {links}""")
def _(t):
    return t["links"].select("page_id", U.coordinates_in_url(F.col("url")).alias("c")).select("page_id", "c.*")


@query("g27_record_json", """
    select id, case when targetPlaceData = 'not json' then 'Unknown place' else json_extract_string(targetPlaceData, '$.name') end as name,
           case when targetPlaceData = 'not json' then null else cast(json_extract_string(targetPlaceData, '$.latitude') as double) end as latitude,
           cast(json_extract_string(matchFactors, '$[1].score') as double) as address_score from {matches}""")
def _(t):
    from waymerge.functions.records import match_factors, target_place
    place = target_place(F.col("targetPlaceData"))
    return t["matches"].select("id", place["name"].alias("name"), place["latitude"].alias("latitude"),
                               F.get(match_factors(F.col("matchFactors")), F.lit(1))["score"].alias("address_score"))


@query("g28_tags", """
    select id, coalesce(array_to_string(list_filter(list_transform(string_split_regex(tags_csv, '[,;|]'), lambda x: trim(x)), lambda x: x <> ''), ';'), '') as joined,
           list_filter(list_transform(string_split_regex(tags_csv, '[,;|]'), lambda x: trim(x)), lambda x: x <> '')[1] as first from {places}""")
def _(t):
    tags = T.split_tags(F.col("tags_csv"))
    return t["places"].select("id", T.join_tags(tags).alias("joined"), T.first_tag(tags).alias("first"))


@query("f8_coordinate_check", """
    with a as (select id, latitude as lat, longitude as lng, cast(latitude as string) as ts, cast(longitude as string) as gs from {places}),
    b as (select *, lat is not null and lng is not null and lat between -90 and 90 and lng between -180 and 180 as ok,
        greatest(case when contains(ts, '.') and split_part(ts, '.', 2) <> '0' then length(split_part(ts, '.', 2)) else 0 end,
                 case when contains(gs, '.') and split_part(gs, '.', 2) <> '0' then length(split_part(gs, '.', 2)) else 0 end) as digits from a)
    select id, ok as is_valid, case when ok then floor(lat * 1000000 + 0.5) / 1000000 end as latitude, case when ok then floor(lng * 1000000 + 0.5) / 1000000 end as longitude,
        case when ok then case when digits >= 5 then 'exact' when digits >= 3 then 'approximate' when digits >= 1 then 'city' else 'region' end end as precision,
        case when lat is null or lng is null then 'Missing coordinate values' when ok then ''
             else 'Latitude must be between -90 and 90' end as errors from b""")
def _(t):
    check = G.check_coordinates(F.col("latitude"), F.col("longitude"))
    return t["places"].select("id", check.alias("c")).select(
        "id", "c.is_valid", "c.latitude", "c.longitude", "c.precision", F.array_join("c.errors", "; ").alias("errors"))


@query("f9_candidate_check", """
    select id, longitude is not null and coalesce(name, '') <> '' as valid,
        concat_ws('; ', case when coalesce(name, '') = '' then 'Place name is required' end,
            case when longitude is null then 'Valid longitude is required (-180 to 180)' end) as errors from {candidates}""")
def _(t):
    return filters.validate_candidates(t["candidates"]).select("id", "valid", F.array_join("errors", "; ").alias("errors"))


def _records_sql(source: str, title: str, category: str) -> str:
    return f"""
    with src as (select id, {title} as title, address, latitude as lat, longitude as lng, {category} as category from {source}), {_canonical_sql('category', 'src', 'id')},
    {d.address_parts('src', 'id', 'address', 'x')},
    w as (select id, {d.canonical_name('title')} as n, list_filter(string_split_regex({d.canonical_name('title')}, '\\s+'), lambda z: length(z) >= 2) as w from src),
    one as (select id, n as token from w union select id, unnest(w) from w
            union select id, array_to_string(w[i:j], ' ') from w, range(1, 60) r(i), range(1, 60) s(j)
                  where i < len(w) and j >= i and j <= len(w) and length(array_to_string(w[i:j], ' ')) >= 3),
    tok as (select id, count(*) as tokens, string_agg(token, '|' order by token) as joined from one group by id),
    p as (select s.*, lat is not null and lng is not null as given, lat between -90 and 90 and lng between -180 and 180 as ok,
        greatest(case when contains(cast(lat as string), '.') and split_part(cast(lat as string), '.', 2) <> '0' then length(split_part(cast(lat as string), '.', 2)) else 0 end,
                 case when contains(cast(lng as string), '.') and split_part(cast(lng as string), '.', 2) <> '0' then length(split_part(cast(lng as string), '.', 2)) else 0 end) as digits,
        {d.canonical_name('title')} as nm, {d.canonical_address('address')} as ad from src s)
    select p.id, nm as name, ad as address, case when given and ok then floor(lat * 1000000 + 0.5) / 1000000 end as latitude,
        case when given and ok then floor(lng * 1000000 + 0.5) / 1000000 end as longitude,
        case when given and ok then case when digits >= 5 then 'exact' when digits >= 3 then 'approximate' when digits >= 1 then 'city' else 'region' end end as precision,
        canonical as category, number, street, city, region, country, postal, tokens, joined,
        concat_ws(',', case when nm <> {d.trimmed('lower(title)')} then 'name_normalized' end, case when ad <> {d.trimmed('lower(address)')} then 'address_normalized' end,
            case when given and not ok then 'invalid_coordinates' end, case when coalesce(p.category, '') <> '' and canonical <> lower(p.category) then 'category_normalized' end) as flags,
        p.title as title, p.category as raw_category
    from p join canon on key = p.id join xparts x on x.key = p.id join tok on tok.id = p.id"""


def _flat(records):
    return records.select(
        "id", "name", "address", "coordinates.latitude", "coordinates.longitude", "coordinates.precision", "category", "components.*", F.size("tokens").alias("tokens"),
        F.array_join(F.array_sort("tokens"), "|").alias("joined"), F.array_join("flags", ",").alias("flags"), "original.title",
        F.col("original.category").alias("raw_category"))


@query("normalize_records", _records_sql("{places}", "title", "category"))
def _(t):
    return _flat(normalize_records(t["places"], "title", F.col("category")))


@query("normalize_candidate_records", _records_sql("{candidates}", "name", "category"))
def _(t):
    return _flat(normalize_records(t["candidates"], "name", F.col("category")))
