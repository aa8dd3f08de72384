"""The history of conversions as a table: retention, search, totals and display columns.

Rows are ordered by ``seq``, the place at which they were appended; nothing sorts by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.formats import trim

SCHEMA = "seq long, timestamp timestamp, timestamp_raw string, input string, output string, source_format string, target_format string, width long, height long, source_bytes long, output_bytes long, elapsed_ms long, success boolean, message string"
#: Rows kept, log lines kept, and the message of a plain success.
KEPT, LOG_LINES, SUCCESS = 500, 2000, "转换成功"


def retain_recent(rows: DataFrame, count: int = KEPT, order: str = "seq") -> DataFrame:
    """The newest ``count`` rows, oldest first. A top-k, so no full sort is made."""
    return rows.orderBy(F.desc(order)).limit(count).orderBy(order)


def recent(rows: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` rows, newest first."""
    return rows.orderBy(F.desc("seq")).limit(count)


def append(rows: DataFrame, new: DataFrame, count: int = KEPT) -> DataFrame:
    """``new`` behind ``rows``, renumbered from the last seq on, and no more than ``count`` rows kept."""
    last = rows.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    low = new.agg(F.min("seq").alias("_low"))
    moved = new.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(low)).withColumn("seq", F.col("_last") + 1 + F.col("seq") - F.col("_low")).drop("_last", "_low")
    return retain_recent(rows.unionByName(moved), count)


def clear(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def remove_at(rows: DataFrame, position: int, order: str = "pos") -> DataFrame:
    return rows.where(F.col(order) != position)


def searched() -> Column:
    """What a keyword is looked for in: input, output and message, joined by single blanks and lowered."""
    return F.lower(F.concat(F.coalesce("input", F.lit("")), F.lit(" "), F.coalesce("output", F.lit("")), F.lit(" "), F.coalesce("message", F.lit(""))))


def matches(keyword: str) -> Column:
    """Rows whose searched text holds the keyword in any case."""
    return F.contains(searched(), F.lower(trim(F.lit(keyword))))


def search(rows: DataFrame, keyword: str) -> DataFrame:
    """Matching rows, newest first; all for a blank keyword."""
    return rows.where(matches(keyword)).orderBy(F.desc("seq"))


def successes(rows: DataFrame) -> DataFrame:
    return rows.where("success")


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("not success")


def totals(rows: DataFrame) -> DataFrame:
    """One row: n, succeeded, failed, source and output bytes (failed rows' sources too), is_empty."""
    out = rows.agg(
        F.count("*").alias("n"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("total_source_bytes"),
        F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("total_output_bytes"),
    )
    return out.withColumn("is_empty", F.col("n") == 0)


def summary(rows: DataFrame) -> DataFrame:
    """One row with the history in a line."""
    t = totals(rows)
    number = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("共 "), number("n"), F.lit(" 条记录,成功 "), number("succeeded"), F.lit(" 条,失败 "), number("failed"), F.lit(" 条,累计输出 "), S.human_size(F.col("total_output_bytes")))
    return t.select(F.when(F.col("n") == 0, "暂无转换记录").otherwise(text).alias("summary"))


def displayed(rows: DataFrame) -> DataFrame:
    """The columns of the history grid, and the size text that nothing shows."""
    c = F.col
    return rows.select(
        "seq",
        S.time_text(c("timestamp")).alias("time"),
        S.format_text(c("source_format"), c("target_format")).alias("formats"),
        S.size_text(c("width"), c("height")).alias("size"),
        F.concat(c("width").cast("string"), F.lit("×"), c("height").cast("string")).alias("grid_size"),
        S.volume_text(c("success"), c("source_bytes"), c("output_bytes")).alias("volume"),
        S.elapsed_text(c("elapsed_ms")).alias("elapsed"),
        S.status_text(c("success")).alias("status"),
    )


def from_outcomes(outcomes: DataFrame, stamp: Column) -> DataFrame:
    """History rows of successful outcomes (input, output, source_format, ..., notes)."""
    message = F.when(F.size("notes") == 0, SUCCESS).otherwise(F.array_join("notes", ";"))
    return _rows(outcomes, stamp, output=F.col("output"), source_format=F.col("source_format"), width=F.col("width"), height=F.col("height"), source_bytes=F.col("source_bytes"), output_bytes=F.col("output_bytes"), elapsed_ms=F.col("elapsed_ms"), success=F.lit(True), message=message)


def from_failures(failed: DataFrame, stamp: Column) -> DataFrame:
    """History rows of failures (input, target_format, length or null, message): the size from disk counts."""
    return _rows(failed, stamp, source_bytes=F.coalesce("length", F.lit(0)), message=F.col("message"))


def from_errors(failed: DataFrame, stamp: Column) -> DataFrame:
    """History rows of errors (input, target_format, elapsed_ms, error_kind, error_message): no sizes."""
    return _rows(failed, stamp, elapsed_ms=F.col("elapsed_ms"), message=S.error_text(F.col("error_kind"), F.col("error_message")))


def _rows(df: DataFrame, stamp: Column, **known: Column) -> DataFrame:
    none = {"output": F.lit(""), "source_format": F.lit(None).cast("string"), "width": F.lit(0), "height": F.lit(0), "source_bytes": F.lit(0), "output_bytes": F.lit(0), "elapsed_ms": F.lit(0), "success": F.lit(False)}
    values = {"seq": F.col("seq"), "timestamp": stamp, "timestamp_raw": stamp.cast("string"), "input": F.col("input"), "target_format": F.col("target_format")} | none | known
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    return df.select([values[k].cast(t).alias(k) for k, t in kinds.items()])


def compression_totals(outcomes: DataFrame) -> DataFrame:
    """One row over successful outcomes: bytes before and after, bytes saved (never below 0) and change in percent."""
    t = outcomes.agg(F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"))
    s, o = F.col("source_bytes"), F.col("output_bytes")
    return t.select(s, o, F.greatest(s - o, F.lit(0)).alias("saved_bytes"), S.size_change_percent(s, o).alias("change_percent"))


def batch_summary(events: DataFrame, seconds: Column, cancelled: Column) -> DataFrame:
    """One row of a batch from (success, null where not run): counts, progress and the text."""
    t = events.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
    t = t.withColumn("processed", F.col("succeeded") + F.col("failed")).withColumn("seconds", seconds).withColumn("cancelled", cancelled)
    return t.select("*", S.progress(F.col("processed"), F.col("total")).alias("progress"), S.shown_progress(F.col("processed"), F.col("total")).alias("shown_progress"), S.batch_text(F.col("succeeded"), F.col("failed"), F.col("seconds"), F.col("cancelled")).alias("text"))


def dedupe_inputs(paths: DataFrame) -> DataFrame:
    """(path, pos): the first place of each path, in order; paths are compared exactly."""
    return paths.groupBy("path").agg(F.min("pos").alias("pos"))


def first_parent(paths: DataFrame) -> DataFrame:
    return paths.agg(F.min_by("path", "pos").alias("p")).select(S.parent(F.col("p")).alias("folder"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
