"""Import deduplication and likely duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import cells_around, grid_cell, has_coordinates, haversine_m
from ..functions.text import dedupe_key
from ..functions.urls import source_of
from .windows import first_per_key

KEY = ["normalizedTitle", "normalizedAddress"]


def with_dedupe_keys(df: DataFrame, title: str = "title", address: str = "address") -> DataFrame:
    return df.withColumns({
        "normalizedTitle": dedupe_key(F.coalesce(F.col(title), F.lit(""))),
        "normalizedAddress": dedupe_key(F.coalesce(F.col(address), F.lit(""))),
    })


def new_rows(incoming: DataFrame, existing: DataFrame, ordinal: str) -> DataFrame:
    """Rows to insert: the first of each normalized (title, address) in the batch,
    unless the library already has it. Copies collapse before the anti join."""
    firsts = first_per_key(with_dedupe_keys(incoming), KEY, ordinal)
    return firsts.join(existing.select(*KEY), KEY, "left_anti").select(*incoming.columns, *KEY)


def import_outcome(incoming: DataFrame, existing: DataFrame, ordinal: str) -> DataFrame:
    """Every incoming row with ``imported`` (else it is a duplicate) and its source.

    Each key's first ordinal is an aggregate with a fixed-width buffer, so a key
    holding a large share of the batch is reduced before it moves.
    """
    keyed = with_dedupe_keys(incoming)
    firsts = (
        keyed.groupBy(*KEY).agg(F.min(ordinal).alias("__first"))
        .join(existing.select(*KEY), KEY, "left_anti")
        .select(F.col("__first").alias("__ord"))
    )
    return (
        keyed.join(firsts, F.col(ordinal) == F.col("__ord"), "left")
        .withColumn("imported", F.col("__ord").isNotNull())
        .withColumn("source", source_of(F.coalesce("sourceUrl", F.lit(""))))
        .drop("__ord")
    )


def import_summary(outcome: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Counts per list and a total row (listName NULL)."""
    rows = outcome.select(
        F.coalesce("listName", F.lit("Imported")).alias("listName"),
        F.col("imported"), (F.col("latitude").isNull() | F.col("longitude").isNull()).alias("bare"),
        F.lit(0).alias("error"),
    )
    if rejects is not None:
        rows = rows.unionByName(rejects.select(
            F.coalesce("listName", F.lit("Imported")).alias("listName"), F.lit(None).cast("boolean").alias("imported"),
            F.lit(False).alias("bare"), F.lit(1).alias("error"),
        ))
    return rows.rollup("listName").agg(
        F.count_if(F.col("imported")).alias("importedCount"),
        F.count_if(~F.col("imported")).alias("skippedCount"),
        F.count_if(~F.col("imported")).alias("duplicateCandidatesCount"),
        F.count_if(F.col("imported") & F.col("bare")).alias("missingCoordinatesCount"),
        F.sum("error").cast("bigint").alias("errorCount"),
    )


def are_likely_duplicates(a: str, b: str):
    """Predicate over a pair row with prefixed columns (``{a}normalizedTitle`` ...)."""
    same = (F.col(a + "normalizedTitle") == F.col(b + "normalizedTitle")) & (
        F.col(a + "normalizedAddress") == F.col(b + "normalizedAddress")
    )
    placed = F.col(a + "latitude").isNotNull() & F.col(a + "longitude").isNotNull() \
        & F.col(b + "latitude").isNotNull() & F.col(b + "longitude").isNotNull()
    near = haversine_m(
        F.col(a + "latitude"), F.col(a + "longitude"), F.col(b + "latitude"), F.col(b + "longitude")
    ) < 100
    return same | F.coalesce(placed & near, F.lit(False))


def likely_duplicates(places: DataFrame, meters: float = 100.0) -> DataFrame:
    """For each place with an earlier likely duplicate, the earliest one (lowest id).

    A pair is a duplicate when the normalized title and address agree or the points
    are closer than ``meters``. No group's pairs are enumerated: equal text and equal
    points reduce to a minimum id; points in one fine cell are all closer than
    ``meters`` and reduce the same way; only neighbouring cells compare points, and
    only with points earlier than everything in the asking cell.
    """
    base = with_dedupe_keys(places).select("id", *KEY, "latitude", "longitude")
    by_text = base.groupBy(*KEY).agg(F.min("id").alias("first_text"))

    edge = meters * 0.999 / 3 ** 0.5
    points = (
        base.where(has_coordinates(F.col("latitude"), F.col("longitude")))
        .groupBy("latitude", "longitude").agg(F.min("id").alias("pid"))
        .withColumn("cell", grid_cell(F.col("latitude"), F.col("longitude"), edge))
    )
    cells = points.groupBy("cell").agg(F.min("pid").alias("cell_first"))
    around = cells.select(
        F.col("cell").alias("from_cell"), "cell_first",
        F.explode(cells_around(F.col("cell"), edge, reach=2)).alias("to_cell"),
    ).where(F.col("from_cell") != F.col("to_cell"))
    wanted = around.groupBy("to_cell").agg(F.max("cell_first").alias("bound"))
    earlier = (
        points.join(wanted, F.col("cell") == F.col("to_cell")).where(F.col("pid") < F.col("bound"))
        .select(F.col("cell").alias("e_cell"), F.col("pid").alias("e_pid"),
                F.col("latitude").alias("e_lat"), F.col("longitude").alias("e_lng"))
    )
    offered = (
        around.join(earlier, (F.col("to_cell") == F.col("e_cell")) & (F.col("e_pid") < F.col("cell_first")))
        .select("from_cell", "e_pid", "e_lat", "e_lng")
    )
    across = (
        points.join(offered, F.col("cell") == F.col("from_cell"))
        .where(haversine_m(F.col("latitude"), F.col("longitude"), F.col("e_lat"), F.col("e_lng")) < meters)
        .groupBy("latitude", "longitude").agg(F.min("e_pid").alias("first_across"))
    )
    by_point = (
        points.join(cells, "cell").join(across, ["latitude", "longitude"], "left")
        .select("latitude", "longitude", F.least("cell_first", "first_across").alias("first_near"))
    )
    linked = base.join(by_text, KEY).join(by_point, ["latitude", "longitude"], "left")
    same_text = F.when(F.col("first_text") < F.col("id"), F.col("first_text"))
    near = F.when(F.col("first_near") < F.col("id"), F.col("first_near"))
    return linked.select(
        F.col("id").alias("place_id"), same_text.alias("same_text_as"), near.alias("near"),
        F.least(same_text, near).alias("duplicate_of"),
    ).where(F.col("duplicate_of").isNotNull())
