"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

Each normalised text is cut where its own content says (a line or sentence end after
at least ``least`` characters, at most ``most``), so a chunk does not depend on what
lies far before it. A text is then a recipe: the ordered list of its chunks' 64-bit
keys. Only keys and digests leave the scan, never the text:

* chunk table: every key with the SHA-256 digests it stands for; a key that stands for
  more than one is not verified, and recipes that use it carry digests as well;
* texts are equal when their ordered identifier lists are equal.

Recipes are pre-aggregated before the shuffle, so a group that holds a third of all
rows sends one row for each task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, documents

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  coalesce(doc_id = max(doc_id) OVER (PARTITION BY t), max(doc_id) OVER (PARTITION BY t) IS NULL) AS kept, sha256(t) AS text_sha256
FROM d
"""


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty.

    Where lower() changes no other letter it gives the same result in one pass; the
    letters outside ASCII decide that.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(rest) == rest, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def chunks(text: Column, least: int, most: int) -> Column:
    """Content-defined chunks of a text, in order; they join to the whole text again."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?(?:\n|[.!?] )|.{{1,{most}}}"), F.lit(0))


def exact_groups(docs: DataFrame, least: int = 1024, most: int = 8192, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. Texts
    are equal when identical after lower-casing A-Z. keep_id is the greatest doc_id of
    the group; kept marks it. Null and empty texts are one group. A row repeated under
    one doc_id counts in group_size each time and gets the same answer. Null doc_ids lose
    to any other; a group of them alone has a null keep_id and all kept. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # fewer bits than all make keys collide, for tests of what follows then
    key = (lambda c: F.xxhash64(c)) if key_bits == 64 else lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - key_bits)
    # the normalised text is bound once: chunks and digest would each compute it again
    parts = F.transform(
        F.array(normalised(F.col("text"))),
        lambda t: F.struct(F.sha2(t, 256).alias("sha"), F.transform(chunks(t, least, most), lambda c: F.struct(key(c).alias("key"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("parts")),
    )[0]
    recipes = docs.select(F.col("doc_id"), parts.alias("r")).select("doc_id", F.unhex("r.sha").alias("sha"), F.col("r.parts.key").alias("keys"), F.col("r.parts.digest").alias("digests"))
    recipes = scratch.cut(recipes, "recipes")

    chunk = recipes.select(F.explode(F.arrays_zip("keys", "digests")).alias("c")).select("c.keys", "c.digests")
    table = chunk.groupBy("keys").agg(F.min("digests").alias("lo"), F.max("digests").alias("hi"))
    unverified = scratch.cut(table.where("lo <> hi").select(F.col("keys").alias("key")), "unverified")
    if unverified.isEmpty():
        listed = recipes.withColumn("extra", F.lit(None).cast("array<binary>"))
    else:
        mixed = recipes.select("keys", F.explode("keys").alias("key")).join(unverified, "key", "left_semi").select("keys").distinct().withColumn("mixed", F.lit(True))
        listed = recipes.join(mixed, "keys", "left").withColumn("extra", F.when(F.col("mixed"), F.col("digests"))).drop("mixed")
    listed = listed.withColumn("extra", F.coalesce("extra", F.array().cast("array<binary>")))
    groups = listed.groupBy("keys", "extra").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = listed.join(groups, ["keys", "extra"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return out


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over the whole of documents."""
    return exact_groups(documents(spark, sf_dir))
