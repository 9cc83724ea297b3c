"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import compare as X
from checks.registry import REGISTRY

SF = "/root/testdata/sf0.001"
SAMPLE = ["g13_address_parts", "m9_calibration", "w2_best_match", "a5_usage_insights", "a12_processing_latency", "j6_likely_duplicates",
          "j17_place_delete_lists", "w11_quota_verdicts", "io10_transfer_urls", "t3_usage_per_minute"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    ok, note = X.compare(name, spark, X.connect(SF), SF)
    assert ok, note


def test_contract_shape(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(REGISTRY)
    assert entry.entry(spark).count() > 0
