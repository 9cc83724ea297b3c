"""SQL fragments for the comparison side, written from the rules rather than from the jobs.

Braces are doubled where a fragment passes through ``str.format``.
"""

from __future__ import annotations

STREETS = [
    ("crescent", "crescent"), ("autoroute", "autoroute"), ("blvd", "boulevard"), ("pkwy", "parkway"), ("expy", "expressway"),
    ("walk", "walk"), ("path", "path"), ("mews", "mews"), ("gdns", "gardens"), ("cres", "crescent"), ("boul", "boulevard"),
    ("ave", "avenue"), ("hwy", "highway"), ("fwy", "freeway"), ("trl", "trail"), ("cir", "circle"), ("ter", "terrace"),
    ("way", "way"), ("row", "row"), ("est", "estate"), ("rue", "rue"), ("rte", "route"),
    ("st", "street"), ("dr", "drive"), ("rd", "road"), ("ln", "lane"), ("ct", "court"), ("pl", "place"), ("sq", "square"),
    ("pk", "park"), ("cl", "close"), ("av", "avenue"), ("ch", "chemin"), ("ne", "northeast"), ("se", "southeast"),
    ("sw", "southwest"), ("nw", "northwest"), ("n", "north"), ("e", "east"), ("s", "south"), ("w", "west"),
]
SUFFIXES = (
    "llc|inc|corp|ltd|co|company|corporation|limited|restaurant|cafe|coffee|shop|store|market|deli|bar|pub|grill|bistro|"
    "eatery|kitchen|house|center|centre|plaza|mall|outlet|emporium|services|service|group|associates|partners|"
    "solutions|systems|technologies|tech"
)
DROPPED = "llc|inc|corp|ltd|co|restaurant|cafe|coffee|shop|store|market"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, '{flags}')"


def trimmed(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def squeezed(x: str) -> str:
    return sub(x, r"\s+", " ")


def letters(x: str) -> str:
    out = f"strip_accents({x})"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def rounded(x: str) -> str:
    return f"cast(floor({x} + 0.5) as bigint)"


def dedupe_key(x: str) -> str:
    return trimmed(squeezed(sub(f"lower({x})", r"[^a-zA-Z0-9_\s]", "")))


def canonical_name(x: str) -> str:
    out = trimmed(squeezed(letters(f"lower({trimmed(x)})")))
    out = sub(sub(out, r"\s*&\s*", " and "), r"\s*\+\s*", " and ")
    out = squeezed(sub(sub(out, "[–—]", "-"), "[™®©]", ""))
    out = trimmed(sub(out, rf"\b({SUFFIXES})\b\.?\s*$", ""))
    out = sub(sub(out, r"[^a-zA-Z0-9_\s'-]", ""), "'", "")
    return trimmed(sub(sub(out, r"\s+-\s+", " "), "^-+|-+$", ""))


def matcher_name(x: str) -> str:
    out = squeezed(f"strip_accents({trimmed(f'lower({x})')})")
    out = sub(sub(out, rf"\b({DROPPED})\b\.?", ""), r"\s*&\s*", " and ")
    return trimmed(sub(sub(out, r"[^a-zA-Z0-9_\s'-]", ""), "'", ""))


def provider_name(x: str) -> str:
    out = squeezed(trimmed(x))
    out = sub(out, r"\b(llc|inc|corp|ltd|co)\b\.?", "", "gi")
    out = sub(out, r"\b(restaurant|cafe|coffee|shop|store|market)\b", "", "gi")
    out = sub(out, r"\s*&\s*", " and ")
    return trimmed(sub(out, r"[^a-zA-Z0-9_\s'-]", ""))


def canonical_address(x: str) -> str:
    out = trimmed(squeezed(letters(f"lower({trimmed(x)})")))
    for short, full in STREETS:
        out = sub(out, rf"\b{short}\.(\s|$)", rf"{full}\1")
        out = sub(out, rf"\b{short}\b", full)
    return trimmed(sub(out, "[,.]$", ""))


def matcher_address(x: str) -> str:
    out = squeezed(f"strip_accents({trimmed(f'lower({x})')})")
    for short, full in (("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("rd", "road"),
                        ("ln", "lane"), ("ct", "court"), ("pl", "place"), ("pkwy", "parkway"), ("hwy", "highway")):
        out = sub(out, rf"\b{short}\b\.?", full)
    return trimmed(sub(sub(out, r"\bste-", "sainte-"), "[,.]$", ""))


def provider_address(x: str) -> str:
    out = squeezed(trimmed(x))
    for short, full in (("st", "Street"), ("ave", "Avenue"), ("blvd", "Boulevard"), ("dr", "Drive"), ("rd", "Road"),
                        ("ln", "Lane"), ("ct", "Court"), ("pl", "Place")):
        out = sub(out, rf"\b{short}\b", full, "gi")
    return sub(out, "[,.]$", "")


US = r"\b\d{{5}}(-\d{{4}})?\b"
CA = r"\b[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d\b"
UK = r"\b[A-Za-z]{{1,2}}\d[A-Za-z\d]?\s?\d[A-Za-z]{{2}}\b"
AU = r"\b\d{{4}}\b"


def postal(x: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({x}, '{p}'), '')" for p in (US, CA, UK, AU))
    return sub(f"coalesce({found})", r"\s", "")


def looks_postal(x: str) -> str:
    return "coalesce(" + " or ".join(f"regexp_matches({x}, '{p}')" for p in (US, CA, UK, AU)) + ", false)"


REGION = r"^([A-Za-z]{{2,3}})\s+([A-Za-z0-9\s-]+)$"
NUMBER = r"^(\d+[a-zA-Z]?(-\d+[a-zA-Z]?)?)[\s,]+"
ENDINGS = "'street','avenue','boulevard','drive','road','lane','court','place','parkway','highway','trail','terrace','square','way'"


def address_parts(source: str, key: str, address: str, p: str) -> str:
    """CTEs ending in ``{p}parts(key, number, street, city, region, country, postal)``."""
    street = sub("split_part(a, ',', 1)", NUMBER, "", "")
    return f"""
      {p}a as (select distinct {key} as key, {address} as a from {source}),
      {p}b as (select *, nullif(regexp_extract(a, '{NUMBER}', 1), '') as number,
                 {trimmed(sub(canonical_address(trimmed(street)), r"\s+\d+[a-z]?$", ""))} as s,
                 list_filter(list_transform(string_split(a, ','), lambda x: {trimmed('x')}), lambda x: x <> '') as parts
               from {p}a),
      {p}c as (select *, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') as w, parts[2:] as loc from {p}b),
      {p}d as (select *, coalesce(list_position(list_transform(w, lambda x: x in ({ENDINGS})), true), 0) as cut,
                 loc[len(loc)] as last, case when len(loc) >= 2 then loc[len(loc) - 1] end as second from {p}c),
      {p}e as (select *, cut > 0 and cut < len(w) as split_here,
                 coalesce({looks_postal(f"nullif(regexp_extract(second, '{REGION}', 2), '')")}, false) as by_second,
                 coalesce({looks_postal(f"nullif(regexp_extract(last, '{REGION}', 2), '')")}, false) as by_last,
                 {looks_postal('last')} as tail_postal from {p}d),
      {p}parts as (select key, number,
                 coalesce(nullif(case when split_here then array_to_string(w[1:cut], ' ') else s end, ''),
                          nullif({canonical_address('loc[1]')}, '')) as street,
                 case when by_second then loc[1]
                      when by_last then case when len(loc) >= 2 then loc[1] end
                      else coalesce(case when tail_postal then case when len(loc) >= 3 then loc[len(loc) - 2] when len(loc) = 2 then loc[1] end
                                    else loc[1] end,
                                    case when split_here then array_to_string(w[cut + 1:], ' ') end) end as city,
                 case when by_second then regexp_extract(second, '{REGION}', 1)
                      when by_last then regexp_extract(last, '{REGION}', 1)
                      when tail_postal then case when len(loc) >= 3 then second end
                      else loc[2] end as region,
                 case when by_second then last end as country,
                 case when by_second then {sub(f"regexp_extract(second, '{REGION}', 2)", r"\s", "")}
                      when by_last then {sub(f"regexp_extract(last, '{REGION}', 2)", r"\s", "")}
                      else {postal('a')} end as postal
               from {p}e)"""


def edit_similarity(a: str, b: str) -> str:
    longest = f"cast(greatest(length({a}), length({b})) as double)"
    return (f"case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 0 when {a} = {b} then 100 "
            f"else {rounded(f'({longest} - levenshtein({a}, {b})) / {longest} * 100')} end")


def meters(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lng2} - {lng1}) / 2), 2))")
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def jaro_winkler(source: str, p: str) -> str:
    """CTEs from ``source(a, b)`` of distinct pairs to ``{p}sim(a, b, score)``; half a
    transposition counts, unlike the engine's own function."""
    w = "greatest(length(a), length(b)) // 2 - 1"
    hit = (f"list_filter(range(greatest(1, i - ({w})), least(length(b), i + ({w})) + 1), "
           "lambda j: b[j] = a[i] and not list_contains(st.taken, j))[1]")
    return f"""
      {p}m as (select a, b, list_reduce(range(1, length(a) + 1),
          lambda st, i: case when {hit} is null then st
                             else {{{{'taken': list_append(st.taken, {hit}), 'kept': list_append(st.kept, a[i])}}}} end,
          {{{{'taken': cast([] as bigint[]), 'kept': cast([] as string[])}}}}) as st from {source}),
      {p}j as (select a, b, len(st.taken) as m, st.kept as kept, list_sort(st.taken) as taken,
          len(list_filter(range(1, 5), lambda k: k <= least(length(a), length(b)) and left(a, k) = left(b, k))) as prefix from {p}m),
      {p}t as (select a, b, m, prefix, len(list_filter(range(1, m + 1), lambda k: kept[k] <> b[taken[k]])) as swapped from {p}j),
      {p}s as (select a, b, prefix, case when a = b then 1.0e0 when m = 0 or {w} < 0 then 0.0e0 else
          (cast(m as double) / length(a) + cast(m as double) / length(b) + (m - swapped / 2e0) / m) / 3e0 end as jaro from {p}t),
      {p}sim as (select a, b, jaro + 0.1e0 * prefix * (1e0 - jaro) as score from {p}s)"""
