"""Registered queries: name -> (job over Tables, comparison SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views


@dataclass(frozen=True)
class Query:
    job: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(job: Callable[[Tables], DataFrame]):
        REGISTRY[name] = Query(job, with_views(sql) if sql else None)
        return job

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY[name].job(Tables(spark, sf_dir))
