"""The registered queries against their SQL checks on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from verification import catalog, compare as C

SF = "/root/testdata/sf0.001"
QUICK = ["scan_forecast_messages", "local_hour_bucket", "fetch_ranges", "time_weighted_avg_locf", "asof_forecast",
         "clean_audit", "engineer_features", "hourly_energy"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    good, note = C.compare(spark, C.duck(SF), name, SF)
    assert good, note


def test_entry_returns_parameters(spark):
    out = entry_points.entry(spark)
    assert "energy_ratio" in out.columns and out.count() == 1
