"""Output names without collisions, decided for all files of a job at once.

A taken name gets the lowest free number in brackets. Numbers are dealt out in two
levels, so that a name which a third of all files share is not numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Fixed value: the last number tried for one file; beyond it the name itself is used.
MOST = 9999
SALTS = 64
#: A name that has a number, as ``numbered`` gives it; longer ones are no rank of a row.
_NUMBERED = r"\(([1-9]\d{0,8})\)(\.[^./]*)?$"


def numbered(path: Column, n: Column, most: int | None = MOST) -> Column:
    """The path with (n) behind its stem; n of 0 or beyond ``most``, if there is a last, is the path itself."""
    folder, ext, stem = S.parent(path), S.extension_of(path), S.file_stem(path)
    name = F.concat(stem, F.lit("("), n.cast("string"), F.lit(")"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return F.when(n <= 0 if most is None else (n <= 0) | (n > most), path).otherwise(S.join_path(F.coalesce(folder, F.lit("")), name))


def unique_paths(rows: DataFrame, existing: DataFrame, order: str = "input") -> DataFrame:
    """``rows`` (path, ...) with output: a path that neither exists nor is given twice.

    ``existing`` has the paths that are there (path). A path that is neither taken nor repeated is its own output; the
    others, as a rule few, are numbered by ``order`` inside salted parts, however many they are: a last number would
    give one path to all rows beyond it. The result is the same under any partitioning.
    """
    there = existing.select("path").distinct()
    wanted = rows.groupBy("path").agg(F.count("*").alias("_n"))
    busy = wanted.where("_n > 1").select("path").unionByName(wanted.select("path").join(there, "path", "left_semi")).distinct()
    single = rows.join(busy, "path", "left_anti").withColumn("output", F.col("path"))
    rows = rows.join(busy, "path", "left_semi")

    salt = F.pmod(F.xxhash64(F.col(order)), F.lit(SALTS))
    salted = rows.withColumn("_salt", salt)
    salted = salted.withColumn("_within", F.row_number().over(W.partitionBy("path", "_salt").orderBy(order)) - 1)
    parts = rows.select("path", salt.alias("_salt")).groupBy("path", "_salt").count()
    parts = parts.withColumn("_before", F.sum("count").over(W.partitionBy("path").orderBy("_salt")) - F.col("count")).drop("count")
    # names like stem(3).ext that exist or are some other row's own name are not free
    inner = there.unionByName(wanted.select("path")).distinct()
    inner = inner.select(F.regexp_replace("path", _NUMBERED, "$2").alias("base"), F.regexp_extract("path", _NUMBERED, 1).alias("n"), "path").where("n <> ''")
    own = busy.join(there, "path", "left_semi").select("path", F.lit(0).alias("n"))
    taken = own.unionByName(inner.select(F.col("base").alias("path"), F.col("n").cast("int").alias("n"))).groupBy("path").agg(F.sort_array(F.collect_set("n")).alias("_taken"))
    # both are joined by path and salt, so no part of a hot name waits for another
    before = parts.join(taken, "path", "left")
    out = salted.join(before, ["path", "_salt"])
    rank = (F.col("_within") + F.col("_before")).cast("int")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), rank, lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return single.unionByName(out.withColumn("output", numbered(F.col("path"), free, None)).drop("_salt", "_within", "_before", "_taken"))
