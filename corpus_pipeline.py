"""The corpus pipeline: five stages over documents, each a training-data operator.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and
returns the columns of documents; the last returns packed pieces.

The same holds for all stages but the last: rows travel as one struct, so further columns
pass through unchanged, whatever their names. Null and empty texts are documents without words.
A null doc_id, or one that several rows have, is told apart by its text. Texts are read
whole at any length. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm import op1_ngram_jaccard, op2_packing, op3_exact_dedup, op7_mixing, op8_quality_rules
from rasterflow.llm._shared import Scratch, delete, documents, paths_made

#: Packing and sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels.

    Each row is judged by its text alone, so repeated rows and ties share their verdict; a text with
    fewer than 20 words (a null or empty one too) goes. Without labels the base rules alone decide.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = op8_quality_rules.learn(op8_quality_rules.labelled(docs, labels))
    judged = op8_quality_rules.measured(docs)
    return judged.where(~op8_quality_rules.base_failed() & op8_quality_rules.verdict(rules)).select("row.*")


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, source): each row as a struct beside what the operators read."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """_rows(docs) with key: the doc_id where one row alone has it, else (null or repeated) a 64-bit hash of doc_id and text.

    So different texts under one doc_id, or under none, are documents of their own; rows equal in both are one.
    """
    rows = _rows(docs)
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    again = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("again")).where("again is not null").groupBy("again").count().where("count > 1").select("again"), "again")
    if again.isEmpty():
        return rows.withColumn("key", F.coalesce("doc_id", own))
    marked = rows.join(again, F.col("doc_id") == F.col("again"), "left")
    return marked.withColumn("key", F.when(F.col("again").isNull(), F.coalesce("doc_id", own)).otherwise(own)).drop("again")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) one row, that with the largest doc_id; null counts as the least.

    Null and empty texts are equal. Where several rows have both, the first of them in the order of their
    columns' JSON stays. Few rows go, so these are what is joined: by doc_id where one row alone has it, else by
    doc_id and the text's digest. Written first, their size is known to the planner, which broadcasts them or not
    before any text is moved.
    """
    scratch = Scratch(spark)
    judged = op3_exact_dedup.exact_groups(docs).select(F.col("doc_id").cast("long").alias("of"), "kept", F.unhex("text_sha256").alias("sha"))
    judged = scratch.cut(judged, "judged")
    ids = judged.groupBy("of").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"))
    gone = scratch.cut(ids.where("of is not null and n = 1 and not kept").select("of"), "gone")
    odd = scratch.cut(ids.where("of is null or n > 1").select(F.col("of").alias("odd")), "odd")
    rows = _rows(docs).join(gone, F.col("doc_id") == F.col("of"), "left_anti")
    if odd.isEmpty():
        return rows.select("row.*")
    judged = judged.join(odd, F.col("of").eqNullSafe(F.col("odd")), "left_semi").groupBy("of", "sha").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"))
    gone = scratch.cut(judged.where("not kept").select("of", "sha"), "gone-texts")
    more = scratch.cut(judged.where("kept and n > 1").select("of", "sha"), "more")
    rows = rows.withColumn("digest", F.unhex(F.sha2(op3_exact_dedup.normalised(F.col("text")), 256)))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("sha"))
    rows = rows.join(gone, same, "left_anti")
    one = rows.join(more, same, "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(more, same, "left_anti").select("row.*").unionByName(one.select("row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least key, of each group of near copies (five words, 0.8).

    The key is the doc_id, but of rows whose doc_id is null or repeated a hash (see _keyed), so that each text
    is judged by itself; rows equal in doc_id and text stay or go together. Texts without words have no
    copies and stay.
    """
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    found = op1_ngram_jaccard.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"), n=5, num=80, den=100)
    gone = scratch.cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("key")), "gone")
    return keyed.join(gone, "key", "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 rows each; short ones are likelier (as in op7_mixing).

    Rows are drawn by key (see _keyed) and joined by key and source, so a null or repeated doc_id with
    other texts is drawn for each text; rows equal in doc_id, text and source are taken alike. Null sources are
    a source of their own. Texts without words have no size and are not taken.
    """
    keyed = _keyed(docs, Scratch(spark))
    drawn = op7_mixing.mix(keyed.select(F.col("key").alias("doc_id"), "text", "source", op7_mixing.favour_short(F.col("text")).alias("favour")), weight="favour")
    taken = drawn.where("taken > 0").select(F.col("doc_id").alias("of"), F.col("source").alias("from"), F.expr("cast(taken div size as int)").alias("copies")).distinct()
    rows = keyed.join(taken, (F.col("key") == F.col("of")) & F.col("source").eqNullSafe(F.col("from")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces of sequences of at most 4096 ids; null texts are one end mark, repeated rows are packed each."""
    return op2_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is written to the shared folder and read again.

    A stage's own tables, and what it read, are deleted when its result is written; those that the last one's
    rows come from stay for their reader.
    """
    docs, scratch, before = documents(spark, sf_dir), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        with paths_made() as made:
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
        for path in made:
            if path != scratch.paths[name]:
                delete(spark, path)
        if before:
            scratch.drop(before)
        before = name
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop(before)  # its pieces are written
    return out
