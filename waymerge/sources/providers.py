"""Canonical candidates from landed provider JSON (one response per row, column ``body``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.category import provider_category
from ..functions.numbers import first_present, round_half_up
from ..operators.filters import open_at

_MARK = "struct<day:int,time:string>"
_PERIODS = f"array<struct<open:{_MARK},close:{_MARK}>>"
_GOOGLE_PLACE = (
    "struct<place_id:string,name:string,formatted_address:string,"
    "geometry:struct<location:struct<lat:double,lng:double>>,types:array<string>,rating:double,"
    "business_status:string,price_level:int,formatted_phone_number:string,international_phone_number:string,"
    "website:string,vicinity:string,"
    "photos:array<struct<photo_reference:string,height:int,width:int,html_attributions:array<string>>>,"
    "reviews:array<struct<author_name:string,rating:double,text:string,time:bigint>>,"
    f"opening_hours:struct<open_now:boolean,periods:{_PERIODS},weekday_text:array<string>>>"
)
GOOGLE_BODY = f"struct<status:string,results:array<{_GOOGLE_PLACE}>,result:{_GOOGLE_PLACE}>"
_APPLE_PLACE = (
    "struct<name:string,coordinate:struct<latitude:double,longitude:double>,formattedAddressLines:array<string>,"
    "categories:array<string>,telephone:string,website:string,rating:double,mapsUrl:string,"
    f"businessHours:struct<periods:{_PERIODS}>,photos:array<struct<url:string,width:int,height:int>>>"
)
APPLE_BODY = f"struct<results:array<{_APPLE_PLACE}>,place:{_APPLE_PLACE}>"

# --- fixed values -----------------------------------------------------------
OPEN_STATES = ("OPERATIONAL", "CLOSED_TEMPORARILY", "CLOSED_PERMANENTLY")
PHOTO_BASE = "https://maps.googleapis.com/maps/api/place/photo"
# ----------------------------------------------------------------------------


def _exploded(responses: DataFrame, schema: str, many: str, one: str) -> DataFrame:
    """One row per place of a search or details body; keeps the other columns and ``pos``."""
    parsed = responses.withColumn("__b", F.from_json("body", schema))
    items = F.coalesce(F.col("__b")[many], F.when(F.col("__b")[one].isNotNull(), F.array(F.col("__b")[one])))
    rest = [c for c in responses.columns if c != "body"]
    return parsed.select(*rest, F.posexplode(items).alias("pos", "r"))


def ingest_google(responses: DataFrame, photo_key: str = "") -> DataFrame:
    rows = _exploded(responses, GOOGLE_BODY, "results", "result")
    r, hours = F.col("r"), F.col("r.opening_hours")
    rest = [c for c in responses.columns if c != "body"]
    photo = lambda p: F.struct(
        F.concat(F.lit(f"{PHOTO_BASE}?maxwidth="), p["width"].cast("string"), F.lit("&photoreference="),
                 p["photo_reference"], F.lit(f"&key={photo_key}")).alias("url"),
        p["width"].alias("width"), p["height"].alias("height"),
        F.array_join(p["html_attributions"], ", ").alias("attribution"))
    review = lambda v: F.struct(
        v["rating"].alias("rating"), v["text"].alias("text"), v["author_name"].alias("author"),
        F.timestamp_seconds(v["time"]).alias("time"))
    return rows.select(
        *rest, "pos", r["place_id"].alias("id"), r["name"].alias("name"), r["formatted_address"].alias("address"),
        r["geometry"]["location"]["lat"].alias("latitude"), r["geometry"]["location"]["lng"].alias("longitude"),
        F.get(r["types"], F.lit(0)).alias("category"),
        first_present(r["formatted_phone_number"], r["international_phone_number"]).alias("phoneNumber"),
        r["website"].alias("website"), r["rating"].alias("rating"), hours["open_now"].alias("isOpen"),
        F.lit("google_maps").alias("source"), r["website"].alias("url"),
        F.when(r["business_status"].isin(*OPEN_STATES), r["business_status"]).alias("businessStatus"),
        r["price_level"].alias("priceLevel"), F.transform(r["types"], provider_category).alias("types"),
        F.transform(r["photos"], photo).alias("photos"), F.transform(r["reviews"], review).alias("reviews"),
        F.when(hours.isNotNull(), F.struct(
            hours["open_now"].alias("isOpen"),
            F.coalesce(hours["periods"], F.array().cast(_PERIODS)).alias("periods"),
            hours["weekday_text"].alias("weekdayText"))).alias("openingHours"),
    )


def apple_id(name: Column, lat: Column, lng: Column) -> Column:
    grid = lambda c: round_half_up(c * 100000.0).cast("string")
    return F.concat_ws("_", F.lit("apple"), F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", "")), grid(lat), grid(lng))


def ingest_apple(responses: DataFrame, at: Column) -> DataFrame:
    """``at`` is the instant for the open-now status."""
    rows = _exploded(responses, APPLE_BODY, "results", "place")
    rest = [c for c in responses.columns if c != "body"]
    r = F.col("r")
    lat, lng = r["coordinate"]["latitude"], r["coordinate"]["longitude"]
    rows = rows.withColumn("__open", open_at(r["businessHours"]["periods"], at))
    category = F.get(r["categories"], F.lit(0))
    return rows.select(
        *rest, "pos", apple_id(r["name"], lat, lng).alias("id"), r["name"].alias("name"),
        F.coalesce(F.array_join(r["formattedAddressLines"], ", "), F.lit("")).alias("address"),
        lat.alias("latitude"), lng.alias("longitude"), category.alias("category"), r["telephone"].alias("phoneNumber"),
        r["website"].alias("website"), r["rating"].alias("rating"), F.col("__open").alias("isOpen"),
        F.lit("apple_maps").alias("source"), r["mapsUrl"].alias("url"),
        F.when(F.col("__open"), "OPERATIONAL").when(~F.col("__open"), "CLOSED_TEMPORARILY").alias("businessStatus"),
        F.lit(None).cast("int").alias("priceLevel"),
        F.when(category != "", F.array(provider_category(category))).alias("types"),
        F.transform(r["photos"], lambda p: F.struct(
            p["url"].alias("url"), p["width"].alias("width"), p["height"].alias("height"),
            F.lit(None).cast("string").alias("attribution"))).alias("photos"),
        F.lit(None).cast("array<struct<rating:double,text:string,author:string,time:timestamp>>").alias("reviews"),
        F.when(r["businessHours"].isNotNull(), F.struct(
            F.col("__open").alias("isOpen"), r["businessHours"]["periods"].alias("periods"),
            F.lit(None).cast("array<string>").alias("weekdayText"))).alias("openingHours"),
    )
