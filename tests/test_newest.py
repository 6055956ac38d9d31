"""The newest time of a table as text."""

import pytest

from wayfunnel.sources import readers as rd


@pytest.mark.parametrize("times, want", [
    (["2024-01-30 10:00:00.123456", "2024-01-30 10:00:00.5"], "2024-01-30 10:00:00.500000"),
    (["2024-01-30 10:00:00.25", "2024-01-30 11:00:00"], "2024-01-30 11:00:00.000000"),
    (["2024-01-30 10:00:00", None], "2024-01-30 10:00:00"),
    ([None], None),
])
def test_fraction_keeps_its_zeros(spark, times, want):
    df = spark.createDataFrame([(x,) for x in times], "s string").selectExpr("cast(s as timestamp_ntz) as ts")
    assert df.agg(rd.newest("ts").alias("m")).first()[0] == want
