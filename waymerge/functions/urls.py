"""Reading and building map links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import first_present, is_finite, nonzero, present
from .text import trim

# --- fixed values -----------------------------------------------------------
APPLE_BASE = "https://maps.apple.com/"
GOOGLE_SEARCH_BASE = "https://www.google.com/maps/search/"
GOOGLE_BASE = "https://www.google.com/maps"
GOOGLE_ZOOM = "15z"
# ----------------------------------------------------------------------------

_PAIR = r"(-?\d+\.?\d*),(-?\d+\.?\d*)"


def number_text(c: Column) -> Column:
    """A double as people write it: ``40`` rather than ``40.0``, no exponent."""
    plain = c.try_cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def form_encode(c: Column) -> Column:
    """Query-string encoding: space is ``+``; ``~`` is escaped and ``*`` is not."""
    return F.url_encode(c)


def component_encode(c: Column) -> Column:
    """Path/query component encoding: space is ``%20``; ``~!*()'`` stay."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%27", "'")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def provider_of(url: Column) -> Column:
    h = host(url)
    return (
        F.when(h.contains("maps.apple.com"), F.lit("apple"))
        .when(h.contains("google.com") | h.contains("goo.gl"), F.lit("google"))
    )


def query_value(url: Column, key: str) -> Column:
    """First value of a query parameter, decoded."""
    raw = F.regexp_extract(F.try_parse_url(url, F.lit("QUERY")), rf"(?:^|&){key}=([^&]*)", 1)
    return present(F.coalesce(F.try_url_decode(raw), raw))


def coordinates_in_url(url: Column) -> Column:
    """Struct latitude, longitude from ``@lat,lng``, else ``ll=``, else ``query=``."""
    patterns = ["@" + _PAIR, "[?&]ll=" + _PAIR, "query=" + _PAIR]
    lat = F.coalesce(*[present(F.regexp_extract(url, p, 1)) for p in patterns])
    lng = F.coalesce(*[present(F.regexp_extract(url, p, 2)) for p in patterns])
    return F.struct(lat.cast("double").alias("latitude"), lng.cast("double").alias("longitude"))


def parse_map_url(url: Column) -> Column:
    """Struct source, title, address, latitude, longitude; NULL for other hosts."""
    provider = provider_of(url)
    apple_q, ll = query_value(url, "q"), query_value(url, "ll")
    parts = F.split(ll, ",")
    apple_lat = trim(F.get(parts, F.lit(0))).try_cast("double")
    apple_lng = trim(F.get(parts, F.lit(1))).try_cast("double")
    apple_ok = apple_lat.isNotNull() & apple_lng.isNotNull()
    query = query_value(url, "query")
    whole_pair = rf"^{_PAIR}$"
    query_is_pair = query.rlike(whole_pair)
    path = F.try_parse_url(url, F.lit("PATH"))
    named = present(F.regexp_extract(path, r"/place/([^/@]+)", 1))
    named = F.try_url_decode(F.replace(named, F.lit("+"), F.lit(" ")))
    at = "@" + _PAIR
    number = lambda text: present(text).cast("double")
    google_lat = F.coalesce(number(F.regexp_extract(path, at, 1)), F.when(query_is_pair, number(F.regexp_extract(query, whole_pair, 1))))
    google_lng = F.coalesce(number(F.regexp_extract(path, at, 2)), F.when(query_is_pair, number(F.regexp_extract(query, whole_pair, 2))))
    query_text = F.when(~query_is_pair, query)
    return (
        F.when(provider == "apple", F.struct(
            F.lit("apple").alias("source"), apple_q.alias("title"), apple_q.alias("address"),
            F.when(apple_ok, apple_lat).alias("latitude"), F.when(apple_ok, apple_lng).alias("longitude"),
        ))
        .when(provider == "google", F.struct(
            F.lit("google").alias("source"), F.coalesce(named, query_text).alias("title"),
            query_text.alias("address"), google_lat.alias("latitude"), google_lng.alias("longitude"),
        ))
    )


def source_of(url: Column) -> Column:
    """Attribution of an imported row from its link."""
    return (
        F.when(url.contains("google"), F.lit("google"))
        .when(url.contains("apple"), F.lit("apple"))
        .otherwise(F.lit("manual"))
    )


def _usable(lat: Column, lng: Column) -> Column:
    return is_finite(lat) & is_finite(lng) & lat.between(-90, 90) & lng.between(-180, 180)


def apple_link(title: Column, address: Column, lat: Column, lng: Column) -> Column:
    query = F.coalesce(first_present(trim(address), trim(title)), F.lit("Location"))
    pair = F.concat(number_text(lat), F.lit(","), number_text(lng))
    return F.when(
        _usable(lat, lng),
        F.concat(F.lit(APPLE_BASE + "?ll="), form_encode(pair), F.lit("&q="), form_encode(title)),
    ).otherwise(F.concat(F.lit(APPLE_BASE + "?q="), form_encode(query)))


def google_link(title: Column, address: Column, lat: Column, lng: Column) -> Column:
    query = F.coalesce(first_present(trim(address), trim(title)), F.lit("Location"))
    pair = F.concat(number_text(lat), F.lit(","), number_text(lng))
    return F.concat(
        F.lit(GOOGLE_SEARCH_BASE + "?api=1&query="),
        F.when(_usable(lat, lng), pair).otherwise(component_encode(query)),
    )


def apple_transfer_link(place: Column) -> Column:
    """Link from a target-place struct; NULL when it holds nothing to search for."""
    name, address = present(place["name"]), present(place["address"])
    pair = F.concat(number_text(place["latitude"]), F.lit(","), number_text(place["longitude"]))
    return (
        F.when(
            nonzero(place["latitude"]) & nonzero(place["longitude"]),
            F.concat(
                F.lit(APPLE_BASE + "?ll="), form_encode(pair),
                F.coalesce(F.concat(F.lit("&q="), form_encode(name)), F.lit("")),
            ),
        )
        .when(address.isNotNull(), F.concat(F.lit(APPLE_BASE + "?address="), form_encode(address)))
        .when(name.isNotNull(), F.concat(F.lit(APPLE_BASE + "?q="), form_encode(name)))
    )


def google_transfer_link(place: Column) -> Column:
    name, address = present(place["name"]), present(place["address"])
    place_id = present(place["placeId"])
    return (
        F.when(place_id.isNotNull(), F.concat(F.lit(GOOGLE_BASE + "/place/"), component_encode(place_id)))
        .when(
            nonzero(place["latitude"]) & nonzero(place["longitude"]),
            F.concat(
                F.lit(GOOGLE_BASE + "/@"), number_text(place["latitude"]), F.lit(","),
                number_text(place["longitude"]), F.lit("," + GOOGLE_ZOOM),
            ),
        )
        .when(
            name.isNotNull() | address.isNotNull(),
            F.concat(F.lit(GOOGLE_BASE + "/search/"), component_encode(F.concat_ws(", ", name, address))),
        )
    )
