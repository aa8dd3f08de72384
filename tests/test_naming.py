from pyspark.sql import functions as F

from rasterflow.plans import naming


def test_more_rows_than_the_last_number_get_names_of_their_own(spark):
    rows = spark.range(10_020).select(F.col("id").alias("input"), F.lit("/o/x.png").alias("path"))
    there = spark.createDataFrame([("/o/x(10005).png",), ("/o/x(03).png",)], "path string")
    got = {r["output"] for r in naming.unique_paths(rows, there).collect()}
    assert got == {"/o/x.png"} | {f"/o/x({n}).png" for n in range(1, 10_021) if n != 10_005}
