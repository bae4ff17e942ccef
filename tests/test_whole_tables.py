"""The queries named ..._all read whole tables."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from skytrace.plans.catalog import QUERIES
from skytrace.plans.encodings import pixels, table


def test_all_pixels_and_events(spark):
    assert QUERIES["b7_project_frame_all"](spark, SF).count() == pixels(spark, SF).count() > QUERIES["b7_project_frame"](spark, SF).count()
    total = QUERIES["a13_frame_quality_all"](spark, SF).agg(F.sum("n")).first()[0]
    last = "(SELECT date_trunc('hour', max(ts)) + INTERVAL 15 MINUTES FROM seen)"  # the last slot's end
    table(spark, SF, "events").createOrReplaceTempView("seen")
    assert total == spark.sql(f"SELECT count(value) FROM seen WHERE ts < {last}").first()[0]


@pytest.mark.parametrize("name", ["a6_month_coverage", "c5_common_times"])
def test_all_orders(spark, name):
    rows = lambda n: sorted(map(tuple, QUERIES[n](spark, SF).collect()))
    assert rows(name) != rows(f"{name}_all")
