"""Pixels are dealt out by image once, before they are made."""

import re

import pytest
from pyspark.sql import functions as F

from rasterflow.operators import pixels, rawfiles
from rasterflow.plans import queries as Q

SMALL = "/root/testdata/sf0.001"
#: Queries whose pixels come of a table of few bytes.
IN_PARTS = ["gradient_pixels", "color_layouts", "grayscale_pixels"]
BIG = [(i, 300 + i % 5, 200 + i % 3) for i in range(25)]


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\w+\(\w*)", plan.split("== Initial Plan ==")[0])


def sizes(spark, rows):
    return spark.createDataFrame(rows, "asset_id int, w int, h int")


def test_parts_grow_with_the_pixels(spark):
    n = sum(w * h for _, w, h in BIG) // pixels.PART + 1
    px = pixels.gradient(sizes(spark, BIG))
    assert n > 2 and px.rdd.getNumPartitions() == n
    assert px.select("asset_id", F.spark_partition_id().alias("part")).distinct().groupBy("asset_id").count().where("count > 1").count() == 0
    assert pixels.gradient(sizes(spark, [(1, 3, 2), (2, None, 4)])).count() == 6 and pixels.gradient(sizes(spark, [])).count() == 0


def test_resizing_shuffles_no_pixels(spark, monkeypatch):
    monkeypatch.setattr(pixels, "PART", 1000)
    px = pixels.gradient(sizes(spark, [(i, 9 + i % 4, 7 + i % 3) for i in range(40)]))
    small = pixels.downscale(px, F.when(F.col("asset_id") % 2 == 0, "Scale75").otherwise("CustomMax"), F.lit(5))
    assert exchanges(small) == ["hashpartitioning(asset_id"]


@pytest.mark.parametrize("name", IN_PARTS)
def test_pixels_are_made_in_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(pixels, "PART", 5000)
    px = Q.QUERIES[name](spark, SMALL)
    assert px.rdd.getNumPartitions() == px.count() // 5000 + 1 > 10


@pytest.mark.parametrize("name", ["raw_files", "raw_pixels"])
def test_files_are_put_together_where_their_pixels_are(spark, monkeypatch, name):
    monkeypatch.setattr(pixels, "PART", 5000)
    made = Q.QUERIES[name](spark, SMALL)
    assert exchanges(made) == ["hashpartitioning(asset_id"]
    assert "kind" not in made.columns or {r[0] for r in made.select("kind").distinct().collect()} == {"bmp", "netpbm", "farbfeld"}


def test_code_of_a_pixel_is_compiled(spark):
    """The JVM leaves methods beyond 8000 bytes to its interpreter."""
    rows = spark.createDataFrame([(bytearray(b"P6 1 1 255 abc"), 7)], "content binary, id int")
    plan = rawfiles.pixels(rows)._jdf.queryExecution().executedPlan()
    found = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
    assert 0 < max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())) < 8000
