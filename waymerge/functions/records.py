"""JSON held in string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TARGET_PLACE = (
    "id string, placeId string, name string, address string, latitude double, longitude double, "
    "category string, rating double, website string"
)
MATCH_FACTORS = "array<struct<type:string,score:double,weight:double,weightedScore:double,explanation:string>>"


def is_object(text: Column) -> Column:
    """True for text that parses as a JSON object."""
    return F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")


def target_place(text: Column) -> Column:
    """Target place struct; unparsable text gives the placeholder place."""
    parsed = F.from_json(text, TARGET_PLACE)
    fallback = F.from_json(F.lit('{"name":"Unknown place","address":"","category":"","website":""}'), TARGET_PLACE)
    return F.when(F.try_parse_json(text).isNull(), fallback).otherwise(parsed)


def match_factors(text: Column) -> Column:
    return F.coalesce(F.from_json(text, MATCH_FACTORS), F.from_json(F.lit("[]"), MATCH_FACTORS))


def data_number(data: Column, field: str) -> Column:
    """A numeric field of a JSON payload; strings and other types do not count."""
    raw = F.get_json_object(data, f"$.{field}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), f"$.{field}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), raw.try_cast("double"))


def data_truthy(data: Column, field: str) -> Column:
    """True when a payload field is set to something other than false, 0 or ''."""
    raw = F.get_json_object(data, f"$.{field}")
    return F.coalesce(~raw.isin("false", "0", "0.0", "", "null"), F.lit(False))


def data_text(data: Column, field: str) -> Column:
    return F.get_json_object(data, f"$.{field}")
