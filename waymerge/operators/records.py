"""Whole records in one of the three normal forms, which disagree and are never mixed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.address import canonical_address, matcher_address, provider_address, with_address_parts
from ..functions.category import matcher_category, provider_category, with_canonical_category
from ..functions.geo import check_coordinates
from ..functions.numbers import shuffle_width
from ..functions.text import canonical_name, matcher_name, provider_name, search_tokens, trim

FLAGS = ("name_normalized", "address_normalized", "invalid_coordinates", "category_normalized")


def _canonical(df: DataFrame) -> DataFrame:
    return with_canonical_category(df, "category", "normal_category")


def _by(rule: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("normal_category", rule(F.col("category")))


@dataclass(frozen=True)
class Profile:
    name: Callable[[Column], Column]
    address: Callable[[Column], Column]
    category: Callable[[DataFrame], DataFrame]


PROFILES = {
    "canonical": Profile(canonical_name, canonical_address, _canonical),
    "matcher": Profile(matcher_name, matcher_address, _by(matcher_category)),
    "provider": Profile(provider_name, provider_address, _by(provider_category)),
}


def normalize_records(df: DataFrame, title: str, category: Column, profile: str = "canonical") -> DataFrame:
    """One row per record (id, title, address, latitude, longitude): id, name, address, coordinates, category, components, tokens, flags, original.

    ``coordinates`` is null unless both are given and valid. ``components`` are read from the address as given, ``tokens`` from the title. ``flags`` lists, in the order
    of FLAGS, what the normal form changed (beyond case and outer white space; for the category, case) and coordinates that are given but
    not valid. ``original`` holds title, address and category as they came. A null title or address counts as empty; a null or empty category raises no
    flag. Works alike for places and candidates: name the title column, and the category (a place's is its first tag).
    """
    how = PROFILES[profile]
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select("id", F.col(title).alias("title"), "address", "latitude", "longitude", category.alias("category"))
    # cleaning costs far more than moving, and is done before the category's join, which run-time merging would leave with one task
    rows = rows.repartition(shuffle_width(rows), "id")
    rows = how.category(with_address_parts(rows, "address", "components").withColumns({
        "normal_name": how.name(F.col("title")), "normal_address": how.address(F.col("address")),
        "check": check_coordinates(F.col("latitude"), F.col("longitude")), "tokens": search_tokens(F.col("title")),
    }))
    given = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    changed = {
        "name_normalized": F.col("normal_name") != trim(F.lower(blank("title"))),
        "address_normalized": F.col("normal_address") != trim(F.lower(blank("address"))),
        "invalid_coordinates": given & ~F.col("check.is_valid"),
        "category_normalized": (blank("category") != "") & (F.col("normal_category") != F.lower(blank("category"))),
    }
    point = F.struct("check.latitude", "check.longitude", "check.precision")
    return rows.select(
        "id", F.col("normal_name").alias("name"), F.col("normal_address").alias("address"),
        F.when(given & F.col("check.is_valid"), point).alias("coordinates"), F.col("normal_category").alias("category"), "components",
        "tokens",
        F.array_compact(F.array(*[F.when(changed[f], F.lit(f)) for f in FLAGS])).alias("flags"),
        F.struct("title", F.col("address").alias("address"), F.col("category").alias("category")).alias("original"),
    )
