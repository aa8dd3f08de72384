"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) get weights in turn and share a budget;
a target stops at ``most`` times its source's size, what is over is shared again by weight
(one closed form over the table of sources, which has a row for each source).

Samples: a document's expected copies are its source's rate times its own weight. Whole
copies are certain. For the fraction p left, documents are ranked by the odds of a random
number over the odds of p, and those with the least ranks are taken until the source's
size in words is reached; what ranks last is one unit whose size closes the gap best.
Inclusion probabilities differ between sources and, with ``weight``, inside them.

The cut through a source is found from sums over fixed ranges of the rank, so a source
with a third of all rows is never sorted in one task; only its boundary range is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import WORD, Scratch, documents

#: Ranges of the rank for each unit of it.
RANGES = 4096

#: The registered query: what _running and the ranges of ranks sum in parts is one window each here.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST(1 / ln(exp(1) + length(coalesce(text, '')) / 100) AS DECIMAL(18, 6)) AS own
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST(sum(size * own) AS DOUBLE) AS mass FROM d GROUP BY source
), weighed AS (
  SELECT *, 2 * source_size AS top, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM per
), stopped AS (
  SELECT *, top / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - (sum(top) OVER o - top)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM weighed WINDOW o AS (ORDER BY top / w, source NULLS LAST)
), water AS (
  SELECT level AS held FROM stopped WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, mass, CASE WHEN held IS NULL OR ratio <= held THEN top ELSE held * w END AS target
  FROM stopped LEFT JOIN water ON true
), e AS (
  SELECT doc_id, d.source, size, CAST(source_size AS BIGINT) AS source_size, target,
    CASE WHEN mass > 0 THEN least(2.0::DOUBLE, target / mass * CAST(own AS DOUBLE)) ELSE 0 END AS e,
    (CAST('0x' || md5('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p, (u / (1 - u)) / (p / (1 - p)) AS odds FROM e
), open AS (
  SELECT source, CAST(round(any_value(target)) AS BIGINT) - sum(whole * size) AS open FROM p GROUP BY source
), units AS (
  SELECT source, doc_id, size, CASE WHEN p > 0 THEN odds / (1 + odds) ELSE 1 + u END AS z FROM p WHERE whole < 2 AND size > 0
  UNION ALL
  SELECT source, doc_id, size, 2 + u FROM p WHERE whole < 1 AND size > 0
), ranked AS (
  SELECT u.*, open, sum(size) OVER (PARTITION BY u.source ORDER BY z, doc_id) AS upto FROM units u JOIN open o ON u.source IS NOT DISTINCT FROM o.source
), gaps AS (
  SELECT *, open - coalesce(max(upto) FILTER (upto <= open) OVER (PARTITION BY source), 0) AS gap FROM ranked
), closer AS (
  SELECT source, doc_id FROM gaps WHERE upto > open AND abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), z, doc_id) = 1
), copies AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM gaps WHERE upto <= open UNION ALL SELECT doc_id FROM closer) GROUP BY doc_id
)
SELECT p.doc_id, size, source_size, target, CAST((whole + coalesce(n, 0)) * size AS BIGINT) AS taken FROM p LEFT JOIN copies USING (doc_id)
"""


def _running(rows: DataFrame, by: list[Column], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """rows with, for each name of ``sums``, the sum of that column up to and with the row in the order ``by``.

    Ranges of rows are summed by themselves; one row for each range, as many as there are partitions, is
    summed over all.
    """
    rows = scratch.cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), name)
    inside = W.partitionBy("_range").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    ranges = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    out = rows.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()}).join(F.broadcast(ranges), "_range")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_range", *[f"_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int, scratch: Scratch) -> DataFrame:
    """(source, source_size, target) from (source, size); a row for each source, null included.

    Sources may be many (hosts, addresses): they are numbered and summed by ranges. All sums are of whole numbers.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")).withColumn("one", F.lit(1))
    per = _running(per, [F.col("source").asc_nulls_last()], {"number": "one"}, scratch, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("w", weight).withColumn("top", F.col("source_size") * float(most)).withColumn("ratio", F.col("top") / F.col("w"))
    per = _running(per, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], {"tops": "top", "ws": "w"}, scratch, "levels")
    total, weight = per.agg(F.sum("source_size"), F.sum("w")).first()
    # the first level at which a source isn't stopped holds for all behind it
    per = per.withColumn("level", (F.lit(float(total or 0) * share) - (F.col("tops") - F.col("top"))) / (F.lit(float(weight or 0)) - (F.col("ws") - F.col("w"))))
    first = per.where("ratio > level").agg(F.min(F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level")).alias("first")).first()["first"]
    level = F.lit(first["level"] if first else None).cast("double")
    return per.select("source", "source_size", F.when(level.isNull() | (F.col("ratio") <= level), F.col("top")).otherwise(level * F.col("w")).alias("target"))


def favour_short(text: Column) -> Column:
    """1 for an empty text, falling with the logarithm of its length: 0.4 at a thousand code points, 0.15 at a hundred thousand."""
    return 1 / F.log(F.lit(math.e) + F.coalesce(F.char_length(text.cast("string")), F.lit(0)) / 100)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, weight: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``.

    ``docs`` needs doc_id, text and source, and the column named by ``weight`` if given;
    other columns are ignored, whatever their names. size counts words, 0 for a null or blank
    text. taken is a multiple of size, at most ``most`` times it. The same rows, seed
    and parameters give the same result under any partitioning; rows repeated under one doc_id
    are ranked alike and so taken alike. A null source is a source of its own; null doc_ids
    share one rank. Weights count to six decimals; a missing or negative one, or one of 10^12 or more, counts as 0. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # decimals, so that sums do not depend on the order of rows
    own = F.greatest(F.coalesce(F.col(weight).cast("double").try_cast("decimal(18,6)"), F.lit(0)), F.lit(0)).cast("decimal(18,6)") if weight else F.lit(1).cast("decimal(18,6)")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size"), own.alias("own"))
    rows = scratch.cut(rows, "sizes")
    targets = source_targets(rows, weights, share, most, scratch)
    mass = rows.groupBy("source").agg(F.sum((F.col("size").cast("decimal(18,0)") * F.col("own")).cast("decimal(28,6)")).cast("double").alias("mass"))
    targets = scratch.cut(targets.join(mass.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "targets")

    def with_source(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        return left.join(right.select(F.col("source").alias("of"), *columns), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    # expected copies; a flat weight gives target / source_size for every document of a source
    expected = F.when(F.col("mass") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("mass") * F.col("own").cast("double"))).otherwise(0.0)
    digits = F.substring(F.md5(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)  # 52 bits
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    placed = with_source(rows, targets, "source_size", "target", "mass").withColumn("e", expected).withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("whole")).withColumn("u", u)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    first = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1 + F.col("u"))
    # further copies, one by one, rank behind every first one
    ranks = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(k > most - F.col("whole"), None).when(k == 1, first).otherwise(k.cast("double") + F.col("u")))
    placed = placed.withColumn("ranks", F.filter(ranks, lambda z: z.isNotNull()))
    placed = scratch.cut(placed.select("doc_id", "source", "size", "source_size", "target", "whole", "ranks"), "placed")

    left_over = placed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("certain")).select("source", (F.round("target") - F.col("certain")).cast("long").alias("open"))
    units = placed.where("size > 0").select("doc_id", "source", "size", F.explode("ranks").alias("z")).withColumn("range", F.floor(F.col("z") * RANGES).cast("long"))
    sums = units.groupBy("source", "range").agg(F.sum("size").alias("words"))
    up_to = W.partitionBy("source").orderBy("range")
    cuts = with_source(sums.withColumn("upto", F.sum("words").over(up_to)), left_over, "open")
    cuts = cuts.where("upto > open").groupBy("source").agg(F.min("range").alias("edge"), F.min_by(F.col("upto") - F.col("words"), F.col("range")).alias("before"), F.first("open").alias("open"))
    cuts = scratch.cut(with_source(left_over.select("source"), cuts, "edge", "before", "open"), "cuts")

    edge = with_source(units, cuts, "edge", "before", "open").where("range = edge")
    in_rank = W.partitionBy("source").orderBy("z", "doc_id")
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(in_rank)).where("upto <= open")
    last = edge.groupBy("source").agg(F.max(F.struct("z", "doc_id")).alias("last"), F.max("upto").alias("reached"))
    cuts = with_source(cuts, last, "last", "reached").withColumn("gap", F.col("open") - F.coalesce("reached", "before"))
    cuts = scratch.cut(cuts, "edges")
    taken = lambda z: F.coalesce((F.floor(z * RANGES) < F.col("edge")) | ((F.floor(z * RANGES) == F.col("edge")) & (F.struct(z.alias("z"), F.col("doc_id")) <= F.col("last"))), F.col("edge").isNull())
    rest = with_source(units, cuts, "edge", "last", "gap").where(~taken(F.col("z")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    closer = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "z", "doc_id")).alias("closer"))
    cuts = scratch.cut(with_source(cuts, closer, "closer").select("source", "edge", "last", "closer"), "final")

    hit = lambda z: F.when(taken(z) | F.coalesce((z == F.col("closer.z")) & F.col("doc_id").eqNullSafe(F.col("closer.doc_id")), F.lit(False)), 1).otherwise(0)
    copies = F.col("whole") + F.aggregate("ranks", F.lit(0), lambda n, z: n + hit(z))
    out = with_source(placed, cuts, "edge", "last", "closer").select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))
    scratch.drop("sizes", "targets", "edges", "sources", "levels")
    return out


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole of documents: weights 3, 1, 2 and 150 % of all words.

    Inside a source short documents are likelier: a document's weight is 1 / ln(e + code points / 100).
    """
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", favour_short(F.col("text")).alias("favour"))
    return mix(docs, weight="favour").select("doc_id", "size", "source_size", "target", "taken")
