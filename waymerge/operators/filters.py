"""Predicates and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import match_factors, target_place

ACTIVE_STATUSES = ("processing", "verifying", "paused")


def missing_coordinates(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNull() | F.col("longitude").isNull())


def search_library(places: DataFrame, text: str = "", only_missing_coordinates: bool = False) -> DataFrame:
    """Case-insensitive substring of title, address or any tag."""
    if only_missing_coordinates:
        places = missing_coordinates(places)
    if not text:
        return places
    q = text.lower()
    in_tags = F.exists("tags", lambda t: F.lower(t).contains(q))
    return places.where(
        F.lower("title").contains(q) | F.coalesce(F.lower("address").contains(q), F.lit(False))
        | F.coalesce(in_tags, F.lit(False))
    )


def _target_contains(text: str) -> Column:
    q = text.lower()
    field_has = lambda k: F.coalesce(F.lower(F.get_json_object("targetPlaceData", f"$.{k}")).contains(q), F.lit(False))
    return field_has("name") | field_has("address")


def review_matches(matches: DataFrame, status: str = "all", level: str = "all", search: str = "") -> DataFrame:
    """Cheap column tests first; JSON is read only for a text search."""
    if status != "all":
        matches = matches.where(F.col("verificationStatus") == status)
    if level != "all":
        matches = matches.where(F.col("confidenceLevel") == level)
    if search:
        matches = matches.where(_target_contains(search))
    return matches


@dataclass(frozen=True)
class MatchFilter:
    """Conjunction of facets; every default accepts all rows.

    Distances are kilometres between the original place and the target and need
    columns ``latitude``/``longitude`` of the place; a facet that is set rejects rows
    that lack the value it tests. An upper distance at its default (50) is open.
    """

    search: str = ""
    status: str = "all"
    level: str = "all"
    score: tuple[float, float] | None = None
    has_coordinates: bool | None = None
    has_address: bool | None = None
    has_rating: bool | None = None
    distance_km: tuple[float, float] | None = None
    verified_after: str | None = None
    verified_before: str | None = None
    name_floor: float = 0
    address_floor: float = 0
    categories: Sequence[str] = field(default_factory=tuple)
    exclude_categories: Sequence[str] = field(default_factory=tuple)


def filter_matches(matches: DataFrame, f: MatchFilter) -> DataFrame:
    from ..functions.geo import haversine_km

    df = review_matches(matches, f.status, f.level, f.search)
    if f.score is not None:
        df = df.where(F.col("confidenceScore").between(*f.score))
    target = target_place(F.col("targetPlaceData"))
    factors = match_factors(F.col("matchFactors"))
    facets: list[Column] = []
    yes_no = lambda test, wanted: F.coalesce(test, F.lit(False)) == F.lit(wanted)
    if f.has_coordinates is not None:
        facets.append(yes_no(target["latitude"].isNotNull() & target["longitude"].isNotNull(), f.has_coordinates))
    if f.has_address is not None:
        facets.append(yes_no(target["address"] != "", f.has_address))
    if f.has_rating is not None:
        facets.append(yes_no(target["rating"].isNotNull(), f.has_rating))
    if f.distance_km is not None:
        km = haversine_km(F.col("latitude"), F.col("longitude"), target["latitude"], target["longitude"])
        facets.append(km.between(*f.distance_km))
    if f.verified_after is not None:
        facets.append(F.col("verifiedAt") >= F.lit(f.verified_after).cast("timestamp"))
    if f.verified_before is not None:
        facets.append(F.col("verifiedAt") <= F.lit(f.verified_before).cast("timestamp"))
    reaches = lambda kind, floor: F.exists(factors, lambda x: (x["type"] == kind) & (x["score"] >= floor))
    if f.name_floor > 0:
        facets.append(reaches("name", f.name_floor))
    if f.address_floor > 0:
        facets.append(reaches("address", f.address_floor))
    if f.categories:
        facets.append(target["category"].isin(*f.categories))
    if f.exclude_categories:
        facets.append(~F.coalesce(target["category"], F.lit("")).isin(*f.exclude_categories))
    for facet in facets:
        df = df.where(facet)
    return df


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("status").isin(*ACTIVE_STATUSES))


def in_range(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Both ends inclusive."""
    return df.where((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) <= F.lit(end).cast("timestamp")))


def matches_in_range(matches: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Matches whose session was created in the range."""
    wanted = in_range(sessions, "createdAt", start, end).select(F.col("id").alias("sessionId"))
    return matches.join(wanted, "sessionId", "left_semi")


def candidate_errors() -> Column:
    """Array of problems of a candidate row; empty when it is valid."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    off = lambda c, limit: F.coalesce(~F.col(c).between(-limit, limit) | F.isnan(c), F.lit(True))
    return F.array_compact(F.array(
        F.when(blank("id"), "Place ID is required"),
        F.when(blank("name"), "Place name is required"),
        F.when(blank("address"), "Place address is required"),
        F.when(off("latitude", 90), "Valid latitude is required (-90 to 90)"),
        F.when(off("longitude", 180), "Valid longitude is required (-180 to 180)"),
        F.when(blank("source"), "Place source is required"),
    ))


def validate_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("errors", candidate_errors()).withColumn("valid", F.size("errors") == 0)


# --- fixed values -----------------------------------------------------------
HTTP_CODES = {
    400: "BAD_REQUEST", 401: "UNAUTHORIZED", 403: "FORBIDDEN", 404: "NOT_FOUND",
    429: "RATE_LIMITED", 500: "SERVER_ERROR", 503: "SERVICE_UNAVAILABLE",
}
# ----------------------------------------------------------------------------


def classify_outcomes(log: DataFrame) -> DataFrame:
    """Error code and retryable flag of each API call; NULL and false for success.

    Status 0 stands for no answer: a time-out when the call took at least 30 s.
    """
    status = F.col("responseStatus")
    named = F.create_map(*[F.lit(x) for pair in HTTP_CODES.items() for x in pair])
    code = (
        F.when(status == 0, F.when(F.col("responseTimeMs") >= 30000, "TIMEOUT").otherwise("NETWORK_ERROR"))
        .when(status >= 400, F.coalesce(F.element_at(named, status), F.concat(F.lit("HTTP_"), status.cast("string"))))
    )
    return log.withColumns({"errorCode": code, "retryable": (status == 0) | (status == 429) | (status >= 500)})


def open_at(periods: Column, at: Column) -> Column:
    """Open at an instant? NULL without periods; false without one that day; the
    day's first period counts; a close before the open runs past midnight."""
    day = F.dayofweek(at) - 1
    now = F.hour(at) * 100 + F.minute(at)
    today = F.get(F.filter(periods, lambda p: p["open"]["day"] == day), F.lit(0))
    clock = lambda t: F.replace(t, F.lit(":"), F.lit("")).try_cast("int")
    opens, closes = clock(today["open"]["time"]), clock(today["close"]["time"])
    return (
        F.when(periods.isNull() | (F.size(periods) == 0), F.lit(None).cast("boolean"))
        .when(today.isNull(), F.lit(False))
        .when(closes < opens, (now >= opens) | (now <= closes))
        .otherwise((now >= opens) & (now <= closes))
    )
