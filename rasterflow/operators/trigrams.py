"""Search of the history over an index of trigrams.

The index is a table of postings (gram, key): every three characters in a row of a row's lowered text, once. Its files are in
order of gram, so a search reads the row groups of its own grams alone, counts for each key how many of them it
has, and verifies only rows that have all. Keywords of fewer than three characters are found by scanning, as every text
may hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import trim
from . import history

#: Postings of a part of the index: some 60 MB on the way there.
PART = 1 << 22


def grams(text: Column) -> Column:
    """The different trigrams of a text; none of a null or shorter one."""
    # a look ahead matches at every character, in one pass over the text
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)), F.array().cast("array<string>")))


def postings(rows: DataFrame, key: str = "seq") -> DataFrame:
    """(gram, key) of every row of a history; a hot gram has as many postings as rows hold it and is dealt out by key too."""
    return rows.select(F.explode(grams(history.searched())).alias("gram"), F.col(key).alias("key"))


def build(rows: DataFrame, path: str, parts: int = 32, key: str = "seq", mode: str = "overwrite") -> None:
    """Writes the postings, each file in order of gram; ``mode`` append adds those of new rows as further files.

    Postings are dealt out by gram and key, so one that stands in every row fills no file alone, and nothing is sampled first.
    ``parts`` is the least number of files; there are more where the texts' characters, no fewer than their postings, ask for them.
    """
    n = rows.agg(F.sum(F.length(history.searched()).cast("long"))).first()[0] or 0
    parts = max(parts, n // PART + 1)
    postings(rows, key).repartition(parts, "gram", "key").sortWithinPartitions("gram", "key").write.mode(mode).parquet(path)


def keyword_grams(spark: SparkSession, keyword: str) -> list[str]:
    """The trigrams that a keyword's rows must have, lowered as the rows are."""
    return spark.range(1).select(F.array_sort(grams(F.lower(trim(F.lit(keyword)))))).first()[0]


def candidates(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Keys that have all of the wanted grams."""
    some = index.where(F.col("gram").isin(*wanted)).groupBy("key").agg(F.count_distinct("gram").alias("n"))
    return some.where(F.col("n") == len(wanted)).select("key")


def search(rows: DataFrame, path: str, keyword: str, key: str = "seq") -> DataFrame:
    """As ``history.search``, over the index of ``rows`` at ``path``."""
    spark = rows.sparkSession
    wanted = keyword_grams(spark, keyword)
    if wanted:
        found = candidates(spark.read.schema(f"gram string, key {rows.schema[key].dataType.simpleString()}").parquet(path), wanted)
        rows = rows.join(found, rows[key] == found["key"], "left_semi")
    return history.search(rows, keyword)
