"""Queries that are to read their tables whole."""

import pytest

from rasterflow.plans import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["gradient_pixels", "grayscale_pixels", "color_layouts"])
def test_every_part_has_pixels(spark, name):
    parts = spark.read.parquet(f"{SMALL}/part.parquet").count()
    assert Q.QUERIES[name](spark, SMALL).select("asset_id").distinct().count() == parts


def test_whole_pages_are_sniffed(spark, tmp_path):
    rows = [(3 + 11 * k, "http://a", tail) for k, tail in enumerate(["<html>" + " " * 200 + "<svg>", "<html>"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["format"] for r in Q.QUERIES["sniffed_formats"](spark, str(tmp_path)).collect()}
    assert got == {3: "svg", 14: None}
