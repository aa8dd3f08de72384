"""Stand-ins: image-shaped tables derived from the star-schema test tables, with the same SQL.

The test tables hold no images. History rows come from events, outcomes from line items, paths
from documents, 8 x 8 rasters from embeddings and image sizes from parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HISTORY = """h AS (
  SELECT event_id AS seq, ts AS timestamp, event_type <> 'error' AS success, 'C:/in/' || event_type || '_' || event_id || '.bmp' AS input,
    CASE WHEN event_type = 'error' THEN '' ELSE 'C:/out/' || event_type || '_' || event_id || '.qoi' END AS output,
    CASE WHEN event_type = 'error' THEN NULL ELSE 'bmp' END AS source_format, 'qoi' AS target_format,
    CASE WHEN event_type = 'error' THEN 0 ELSE 8 END AS width, CASE WHEN event_type = 'error' THEN 0 ELSE 4 END AS height,
    CAST(floor(value * 1024) AS BIGINT) AS source_bytes, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 512) AS BIGINT) END AS output_bytes,
    user_id * 37 AS elapsed_ms, CASE WHEN event_type = 'error' THEN '数据损坏:' || event_type ELSE '转换成功' END AS message
  FROM events)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    name = F.concat("event_type", F.lit("_"), F.col("event_id").cast("string"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("timestamp"), (~bad).alias("success"),
        F.concat(F.lit("C:/in/"), name, F.lit(".bmp")).alias("input"), F.when(bad, "").otherwise(F.concat(F.lit("C:/out/"), name, F.lit(".qoi"))).alias("output"),
        F.when(~bad, "bmp").alias("source_format"), F.lit("qoi").alias("target_format"),
        F.when(bad, 0).otherwise(8).cast("long").alias("width"), F.when(bad, 0).otherwise(4).cast("long").alias("height"),
        F.floor(F.col("value") * 1024).alias("source_bytes"), F.when(bad, 0).otherwise(F.floor(F.col("value") * 512)).cast("long").alias("output_bytes"),
        (F.col("user_id") * 37).alias("elapsed_ms"), F.when(bad, F.concat(F.lit("数据损坏:"), "event_type")).otherwise("转换成功").alias("message"),
    )


#: Source and target formats take turns with the line number; every seventh line has half transparent pixels.
OUTCOMES = """o AS (
  SELECT l_orderkey, l_linenumber, ['bmp', 'png', 'gif', 'jpeg', 'webp'][1 + l_linenumber % 5] AS source_format, ['png', 'jpeg', 'gif', 'qoi'][1 + (l_orderkey % 4)::INT] AS target_format, l_suppkey % 7 = 0 AS semi_transparent,
    CAST(floor(l_extendedprice) AS BIGINT) AS source_bytes, CAST(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS BIGINT) AS output_bytes, l_partkey AS elapsed_ms
  FROM lineitem)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pick(("bmp", "png", "gif", "jpeg", "webp"), c("l_linenumber") % 5).alias("source_format"), pick(("png", "jpeg", "gif", "qoi"), c("l_orderkey") % 4).alias("target_format"), (c("l_suppkey") % 7 == 0).alias("semi_transparent"),
        F.floor(c("l_extendedprice")).alias("source_bytes"), F.floor(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("output_bytes"), c("l_partkey").alias("elapsed_ms"),
    )


_EXT = ("bmp", "PGM", "jpeg", "svgz", "heic", "txt", "tar.gz", "Tga", "ff", "")
PATHS = f"""p AS (
  SELECT doc_id AS pos, '/' || source || '/' || CASE doc_id % 13 WHEN 0 THEN '.hidden' WHEN 1 THEN 'a.b' ELSE '' END || (doc_id % 50) || CASE WHEN doc_id % 10 = 9 THEN '' ELSE '.' END || {list(_EXT)}[1 + (doc_id % 10)::INT] AS path FROM documents)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXT]), (d % 10 + 1).cast("int"))
    head = F.when(d % 13 == 0, ".hidden").when(d % 13 == 1, "a.b").otherwise("")
    return table(spark, sf_dir, "documents").select(d.alias("pos"), F.concat(F.lit("/"), "source", F.lit("/"), head, (d % 50).cast("string"), F.when(d % 10 == 9, "").otherwise("."), ext).alias("path"))


RASTER = """px AS (
  SELECT vec_id AS asset_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, 8 AS w, 8 AS h, CAST(greatest(0, least(255, floor((embedding[i]::DOUBLE + 1) * 127.5))) AS INT) AS c0
  FROM embeddings, range(1, 65) AS r(i))"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.posexplode("embedding").alias("i", "v"))
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 1) * 127.5))).cast("int")
    return e.select("asset_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.lit(8).alias("w"), F.lit(8).alias("h"), value.alias("c0"))


SIZES = "s AS (SELECT p_partkey AS asset_id, (20 + p_partkey % 11)::INT AS w, (12 + p_partkey % 7)::INT AS h FROM part)"
GRADIENT = f"""{SIZES}, g AS (
  SELECT asset_id, w, h, y, x, CAST(x * 255 // greatest(w, 1) AS INT) AS c0, CAST(y * 255 // greatest(h, 1) AS INT) AS c1, CAST((x + y) * 255 // greatest(w + h, 1) AS INT) AS c2
  FROM s, LATERAL (SELECT unnest(range(h)) AS y) AS a, LATERAL (SELECT unnest(range(w)) AS x) AS b)"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("asset_id"), (20 + k % 11).cast("int").alias("w"), (12 + k % 7).cast("int").alias("h"))
