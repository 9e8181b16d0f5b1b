"""Spans of rows around titles on long pages."""

import time

from pyspark.sql import functions as F

from folioforge.operators import coordinates


def test_spans_of_long_pages(spark):
    n = 600
    row = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("row"), (i % 5 != 4).alias("tabular"), (i % 50 == 0).alias("title"), F.lit(True).alias("goes_on")))
    pages = spark.range(40).select(F.col("id").alias("page"), row.alias("rows"))
    began = time.time()
    found = coordinates.titled_spans(pages, ["page"]).where("page = 7").collect()
    counted = coordinates.titled_spans(pages, ["page"]).count()
    assert time.time() - began < 30
    assert {(r.title_row, r["first"], r.end) for r in found if r.below} == {(t, t + 1, t + 50) for t in range(0, n, 50)}
    assert {(r.title_row, r["first"], r.end) for r in found if not r.below} == {(t, t - 49, t - 1) for t in range(50, n, 50)}
    assert counted == 40 * len(found)
