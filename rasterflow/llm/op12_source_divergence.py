"""How the sources of a language differ in their words: symmetric divergences of pairs and each source's leading terms.

Texts are counted once: a task adds up occurrences and documents by (language, source, term) and only those sums are
shuffled. Terms in enough of a language's documents are kept; a posting is a kept term's count in one group.

Leading terms come from an upper-bound search. The postings of a group fall into buckets by count, of which there are at
most ``8 * 64``; a bucket knows its greatest share p and the least share q that any of its terms has in the whole language.
The value grows with p and falls with q, so the value at these extremes bounds the bucket. Buckets are evaluated best
bound first, in batches for all groups at once, until the bounds of those left are strictly below the tenth value found.

Pairs come from postings. A term that neither source has adds one constant, a term that only one has adds what depends on
that source's count alone, so histograms of counts give the sums of both kinds; what terms in both add beyond that is
accumulated over slices of terms, in a task, from each term's posting list. Values are whole numbers, and all arithmetic
is exact.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, documents

#: Fixed value: shares are whole numbers of this many parts.
UNIT = 1_000_000_000
#: Terms that a counting task holds before it hands out sums; postings of a slice; pairs accumulated at a time; groups of a language paired in one task.
HELD, SLICE, AT_ONCE, PAIRED = 500_000, 100_000, 1 << 21, 512
#: Of the first 256 bytes: A-Z to lower case, what is no part of a term to a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
s AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c, k.c AS all_c FROM g JOIN k USING (lang) LEFT JOIN s USING (lang, source, term)),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM t GROUP BY ALL),
p AS (SELECT t.lang, t.source, t.term, t.c, 1 + {UNIT} * (t.c + 2) // (n.n + 2 * l.v) AS p, 1 + {UNIT} * (t.all_c + 2) // (l.n + 2 * l.v) AS q
  FROM t JOIN n USING (lang, source) JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10
"""


def _counted(batches):
    """Sums of occurrences and documents by language, source and term; a row without a term tells that a group is there."""
    held, size = {}, 0
    names = ["lang", "source", "term", "occ", "docs"]

    def out():
        for (lang, source), (occ, docs) in held.items():
            n = len(occ)  # both counters met their terms in the same order
            columns = [pa.array([*occ, None], pa.binary()).cast(pa.string()), pa.array([*occ.values(), 0], pa.int64()), pa.array([*docs.values(), 0], pa.int64())]
            whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(v, pa.string()), n + 1) for v in (lang, source)] + columns, names)
            for at in range(0, n + 1, 50_000):
                yield whole.slice(at, 50_000)

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
                size += 1
            occ, docs = held[lang, source]
            size -= len(occ)
            found = Counter(text.encode().translate(_BYTES).split())
            occ.update(found)
            docs.update(found.keys())
            size += len(occ)
            if size > HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly; null where there is no kept term."""
    dec = lambda c: c.cast("decimal(19,0)")
    below = dec(total) + 2 * dec(terms)
    return F.when(terms > 0, 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (dec(count) + 2), F.nullif(below, F.lit(0).cast("decimal(22,0)"))).cast("long"))


def value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so this stays within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _bucket(count: str) -> Column:
    """Counts up to 15 by themselves, larger ones by their leading 4 bits: 8 buckets a power of two."""
    return F.expr(f"CASE WHEN {count} < 16 THEN {count} ELSE length(bin({count})) * 8 + shiftright({count}, length(bin({count})) - 4) - 8 END")


def _postings(docs: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(postings: lang, source, term, p, q, p0, bucket; groups: lang, source, v, p0), written."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    sums = docs.select(*blank).mapInArrow(_counted, "lang string, source string, term string, occ long, docs long")
    counts = scratch.cut(sums.groupBy("lang", "source", "term").agg(F.sum("occ").alias("c"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("c").alias("all_c"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = scratch.cut(kept, "kept")
    found = scratch.cut(counts.drop("docs").join(kept, ["lang", "term"]), "found")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_c").alias("all_n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(found.groupBy("lang", "source").agg(F.sum("c").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.cut(groups.fillna(0, ["n", "v", "all_n"]).withColumn("p0", share(F.lit(0), F.col("n"), F.col("v"))), "groups")
    rows = found.join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "term", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), share(F.col("all_c"), F.col("all_n"), F.col("v")).alias("q"), "p0", _bucket("c").alias("bucket"))
    rows = scratch.cut(rows, "postings")
    scratch.drop("counts", "kept", "found")
    return rows, groups


def _leading(postings: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """(lang, source, term, value, rank): each group's ``top`` terms with p > q, by an upper-bound search over its buckets."""
    group = ["lang", "source"]
    order = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    buckets = postings.groupBy(*group, "bucket").agg(F.max("p").alias("high"), F.min("q").alias("low"), F.count("*").alias("n")).where("high > low")
    buckets = buckets.withColumn("bound", value(F.col("high"), F.col("low"))).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buckets = scratch.cut(buckets.select(*group, "bucket", "bound", "before"), "buckets")
    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    best, begin, end, turn = None, 0, top, 0
    while True:
        open_ = buckets.where(F.col("before") >= begin)
        if best is not None:  # of a group with fewer terms so far, nothing is left out
            kth = best.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
            open_ = open_.join(kth, group, "left").where("kth IS NULL OR bound >= kth")
            if open_.isEmpty():
                break
        found = postings.join(open_.where(F.col("before") < end).select(*group, "bucket"), [*group, "bucket"]).where("p > q").select(*group, "term", value(F.col("p"), F.col("q")).alias("value"))
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = scratch.cut(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top), f"best{turn}")
        scratch.drop(f"best{turn - 1}")
        begin, end, turn = end, end * 16, turn + 1
    scratch.drop("buckets")
    return best


def _index_pairs(m: int):
    """Positions (i, j), i < j, of a list of m, some AT_ONCE at a time."""
    step = max(1, AT_ONCE // m)
    for at in range(0, m, step):
        i = np.arange(at, min(at + step, m))
        i, j = np.repeat(i, m), np.tile(np.arange(m), len(i))
        yield i[j > i], j[j > i]


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, sums)
    return found, total


def _joint(rows: pa.Table) -> pa.Table:
    """For two sources with terms in common, what those add beyond the sums over each source's own counts."""
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p, p0 = rows.column("p").to_numpy(), rows.column("p0").to_numpy()
    langs, lang = np.unique(rows.column("lang").to_numpy(zero_copy_only=False), return_inverse=True)
    sources, source = np.unique(rows.column("source").to_numpy(zero_copy_only=False), return_inverse=True)
    term = np.unique(rows.column("term").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.lexsort((source, term, lang))
    starts = np.flatnonzero(np.r_[True, (np.diff(term[order]) != 0) | (np.diff(lang[order]) != 0)])
    lengths = np.diff(np.r_[starts, len(order)])
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for m in np.unique(lengths[lengths > 1]):
        lists = starts[lengths == m]
        for i, j in _index_pairs(int(m)):
            step = max(1, AT_ONCE // max(1, len(i)))
            for at in range(0, len(lists), step):
                a, b = (order[(lists[at : at + step, None] + x).ravel()] for x in (i, j))
                more = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                key = (lang[a] * len(sources) + source[a]) * len(sources) + source[b]
                keys, sums = _summed(np.concatenate([keys, key]), np.concatenate([sums, more]))
    rest, b = np.divmod(keys, len(sources))
    which, a = np.divmod(rest, len(sources))
    return pa.table([pa.array(langs[which], pa.string()), pa.array(sources[a], pa.string()), pa.array(sources[b], pa.string()), pa.array(sums)], ["lang", "a", "b", "more"])


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways."""
    counts = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("counts"))
    side = groups.join(counts, ["lang", "source"], "left").select("lang", "source", "v", F.coalesce("p0", F.lit(1).cast("long")).alias("p0"), F.coalesce("counts", F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("counts"))
    parts = -(-groups.count() // PAIRED) or 1
    a = side.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts)))
    b = side.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"), F.col("counts").alias("item_counts"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    none = value(F.col("p0"), F.col("item_p0"))
    own = lambda counts, other: F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x["n"] * (value(x["p"], F.col(other)) - none))
    base = a.join(b, ["lang", "part"]).where("source < item").select("lang", F.col("source").alias("a"), F.col("item").alias("b"), (F.col("v") * none + own("counts", "item_p0") + own("item_counts", "p0")).alias("base"))
    slices = max(64, -(-postings.count() // SLICE))
    joint = postings.select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("lang", "term"), F.lit(slices)).alias("slice")).groupBy("slice").applyInArrow(_joint, "lang string, a string, b string, more long")
    joint = joint.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    both = base.join(joint, ["lang", "a", "b"], "left").select("lang", "a", "b", (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return both.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of lang and source that occurs.

    ``docs`` needs text, lang and source; other columns are ignored, whatever their names. Null text, lang or source counts as empty. A
    term is a run of letters of ASCII and of any characters beyond it, A-Z in lower case; a language keeps those in at least
    ``min_docs`` of its documents (rows; repeated rows count each). Part ``pair`` has each other source of the language with the sum over
    all kept terms (0 without any), part ``term`` the group's ``top`` kept terms that are more frequent in it than in the language.
    Ranks go by descending value, then by item in order of UTF-8. Texts of any length are counted whole. A group without
    kept terms has shares of its own, those of counts of 0. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    postings, groups = _postings(docs, min_docs, scratch)
    terms = _leading(postings, top, scratch).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = scratch.cut(_pairs(postings, groups), "pairs")
    scratch.drop("postings", "groups")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences and leading terms of all sources of documents."""
    return divergence(documents(spark, sf_dir))
