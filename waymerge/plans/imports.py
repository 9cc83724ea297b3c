"""Import: files -> new places, memberships and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.dedupe import import_outcome, import_summary
from .storage import written


def import_places(
    incoming: DataFrame, existing: DataFrame, now: Column, rejects: DataFrame | None = None, ordinal: str = "ord",
) -> dict[str, DataFrame]:
    """Tables ``places``, ``collections``, ``memberships`` and ``summary`` of one import.

    Rows dedupe against the library and among themselves, first one wins over lists
    in order. The judged rows are written once; every output reads that table.
    """
    outcome = written(import_outcome(incoming, existing, ordinal), "import")
    fresh = outcome.where("imported")
    places = fresh.select(
        F.sha2(F.concat_ws("|", "normalizedTitle", "normalizedAddress"), 256).alias("id"), "title", "address",
        "latitude", "longitude", "notes", "tags", "source", "sourceUrl", "normalizedTitle", "normalizedAddress",
        now.alias("createdAt"), now.alias("updatedAt"), "listName",
    )
    named = outcome.where(F.col("listName").isNotNull()).select("listName").distinct()
    collections = named.select(
        F.sha2("listName", 256).alias("id"), F.col("listName").alias("name"), now.alias("createdAt"), now.alias("updatedAt"))
    memberships = places.where(F.col("listName").isNotNull()).select(
        F.concat_ws("_", "id", F.sha2("listName", 256)).alias("id"), F.col("id").alias("placeId"),
        F.sha2("listName", 256).alias("collectionId"))
    return {
        "places": places.drop("listName"), "collections": collections, "memberships": memberships,
        "summary": import_summary(outcome, rejects),
    }
