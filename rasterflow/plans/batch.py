"""Batches of files as streams: rounds of files, progress events, cancellation and one summary.

The list of files is a table in files of one round each, read as a stream with one file a micro-batch. A round is converted and
its outcomes and events become a part of a table of their own, so nothing grows with the rounds: names given before are
one table, joined once. The cancel flag is looked at before each round; files of a round that runs are finished,
later ones are not begun. A batch that was cut off or cancelled goes on from its checkpoint when it is run again in the same
folder; a round that runs again writes the same parts.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.formats import REGISTRY
from ..functions.options import CompressOptions, ConvertOptions, default_workers
from ..operators import history
from ..sources import files
from ..sources.shared import shared_folder
from ..streaming.progress import EVENT, ProgressRows, progress
from . import convert

#: Files of a round at most, and rounds that a batch is cut in where that makes no round smaller than the workers can share.
ROUND, ROUNDS = 4096, 32


_OUTCOME = f"{convert.CODED.replace(' encoded binary,', '')}, output string, notes array<string>, shown string, place long"


class _Cancelled(Exception):
    """Ends a stream before a round that is not to begin."""


@dataclass(frozen=True)
class Event:
    """kind: started, file_started, file_done, file_failed or finished."""

    kind: str
    index: int = -1
    input: str = ""
    output: str = ""
    message: str = ""
    total: int = 0


@dataclass
class Summary:
    total: int = 0
    succeeded: int = 0
    failed: int = 0
    cancelled: bool = False
    seconds: float = 0.0

    @property
    def processed(self) -> int:
        return self.succeeded + self.failed

    @property
    def progress(self) -> float:
        return 1.0 if not self.total else min(1.0, max(0.0, self.processed / self.total))

    def text(self) -> str:
        return f"成功 {self.succeeded} 个,失败 {self.failed} 个,用时 {self.seconds:.2f} 秒" + ("(已取消)" if self.cancelled else "")


@dataclass
class Batch:
    """A batch over paths, a list or a table (path): order kept, repeats dropped. ``folder`` holds its tables, by default one in the shared folder."""

    spark: SparkSession
    paths: list[str] | DataFrame
    options: ConvertOptions | CompressOptions
    workers: int = 0
    enabled: tuple[str, ...] = REGISTRY
    existing: DataFrame | None = None
    write: bool = True
    cancel: threading.Event = field(default_factory=threading.Event)
    summary: Summary = field(default_factory=Summary)
    folder: str = ""

    def __post_init__(self) -> None:
        self.name = self.folder.rstrip("/").rpartition("/")[2] or f"batch-{uuid.uuid4().hex}"
        self.folder = self.folder.rstrip("/") or f"{shared_folder(self.spark)}/{self.name}"

    def _inputs(self) -> int:
        """Writes the paths with their places, a file for each round, unless an earlier run has; the count of paths."""
        at = f"{self.folder}/inputs"
        if not files.there(at):
            if isinstance(self.paths, DataFrame):
                rows = history.dedupe_inputs(self.paths.select("path", F.monotonically_increasing_id().alias("pos"))).withColumnRenamed("pos", "place")
            else:
                rows = self.spark.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(self.paths))], "path string, place long")
            n = rows.count()
            least = max(1, self.workers or default_workers()) * 4
            rounds = max(1, -(-n // min(ROUND, max(least, -(-n // ROUNDS)))))
            rows.repartitionByRange(rounds, "place").sortWithinPartitions("place").write.parquet(at)
        return self.spark.read.parquet(at).count()

    def run(self, on_event: Callable[[Event], None] | None = None) -> Summary:
        """Runs what isn't done yet. ``on_event`` gets the events of each round when it is done, else none is collected."""
        spark, began = self.spark, time.monotonic()
        tell = on_event or (lambda e: None)
        total = self._inputs()
        self.summary = Summary(total=total)
        tell(Event("started", total=total))
        self._events([(self.name, 0, "started", -1, "", "", "", total)], "start")
        rows = ProgressRows(f"{self.folder}/progress")

        def each(some: DataFrame, number: int) -> None:
            if self.cancel.is_set():
                raise _Cancelled
            some.persist()  # paths alone; read twice, counted once
            self._round(some, number, on_event)
            some.unpersist()

        spark.streams.addListener(rows)
        try:
            stream = spark.readStream.schema("path string, place long").option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/inputs")
            query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        except StreamingQueryException:
            if not self.cancel.is_set():
                raise
        finally:
            spark.streams.removeListener(rows)
        done = self.outcomes.agg(F.count_if(F.col("error_kind").isNull()), F.count_if(F.col("error_kind").isNotNull())).first()
        # the flag as it is at the end counts, even behind the last file
        self.summary = Summary(total, done[0], done[1], self.cancel.is_set(), time.monotonic() - began)
        self._events([(self.name, 1 << 62, "finished", -1, "", "", self.summary.text(), total)], "finish")
        tell(Event("finished", total=total, message=self.summary.text()))
        return self.summary

    def _round(self, some: DataFrame, number: int, on_event: Callable[[Event], None] | None) -> None:
        given = self.given().where(F.col("round") < number).select("path")
        known = given if self.existing is None else given.unionByName(self.existing.select("path"))
        parts = max(1, self.spark.sparkContext.defaultParallelism * 4)
        places = some.select(F.col("path").alias("input"), "place")
        rows = convert.planned(convert.coded(files.read_paths(some.select("path").repartition(parts)), self.options, self.enabled), self.options, known, F.current_timestamp())
        if self.write:
            put = convert.write(rows, self.options.overwrite, f"{self.folder}/writes", f"round-{number}").select(F.col("wanted").alias("output"), F.col("path").alias("_path"), F.col("error_kind").alias("_kind"), F.col("error_message").alias("_message")).dropDuplicates(["output"])
            rows = rows.join(put, "output", "left").withColumns({"output": F.when(F.col("_kind").isNull(), F.coalesce("_path", "output")).otherwise(""), "error_kind": F.coalesce("error_kind", "_kind"), "error_message": F.coalesce("error_message", "_message")}).drop("_path", "_kind", "_message")
        shown = rows.drop("encoded").withColumn("shown", scalars.error_text(F.col("error_kind"), F.col("error_message"))).join(places, "input")
        shown.write.mode("overwrite").parquet(f"{self.folder}/outcomes/round={number}")
        done = self.spark.read.schema(_OUTCOME).parquet(f"{self.folder}/outcomes/round={number}")
        ok = F.col("error_kind").isNull()
        told = F.when(ok, F.when(F.size("notes") > 0, F.array_join("notes", ";")).otherwise(history.SUCCESS)).otherwise(F.col("shown"))
        begun = done.select(F.lit(self.name).alias("batch"), (2 * F.col("place") + 1).alias("seq"), F.lit("file_started").alias("kind"), F.col("place").alias("index"), "input", F.lit("").alias("output"), F.lit("").alias("message"), F.lit(0).cast("long").alias("total"))
        ended = done.select(F.lit(self.name).alias("batch"), (2 * F.col("place") + 2).alias("seq"), F.when(ok, "file_done").otherwise("file_failed").alias("kind"), F.col("place").alias("index"), "input", "output", told.alias("message"), F.lit(0).cast("long").alias("total"))
        begun.unionByName(ended).write.mode("overwrite").parquet(f"{self.folder}/events/part={number}")
        if on_event:  # a round's events, without bytes
            for r in self.spark.read.schema(EVENT).parquet(f"{self.folder}/events/part={number}").orderBy("seq").collect():
                on_event(Event(r["kind"], r["index"], r["input"], r["output"], r["message"]))

    def _events(self, rows: list[tuple], part: str) -> None:
        self.spark.createDataFrame(rows, EVENT).write.mode("overwrite").parquet(f"{self.folder}/events/part={part}")

    def given(self) -> DataFrame:
        """(path, round) of the names that rounds gave so far."""
        return self.outcomes.where("output <> ''").select(F.col("output").alias("path"), "round")

    @property
    def outcomes(self) -> DataFrame:
        """Outcomes so far without their bytes; place is the file's in the list, round its micro-batch."""
        at = f"{self.folder}/outcomes"
        if not files.there(at):
            return self.spark.createDataFrame([], f"{_OUTCOME}, round long")
        return self.spark.read.schema(f"{_OUTCOME}, round long").parquet(at)

    def progress(self) -> DataFrame:
        """A row for each micro-batch that ran."""
        return progress(self.spark, f"{self.folder}/progress")

    def history(self, start: int = 0) -> DataFrame:
        """The batch's files as history rows, in the order in which they were given."""
        target = self.options.target if isinstance(self.options, ConvertOptions) else "png"
        ok, c = F.col("error_kind").isNull(), F.col
        told = F.when(F.size("notes") > 0, F.array_join("notes", ";")).otherwise(history.SUCCESS)
        now = F.current_timestamp()
        return self.outcomes.select(
            (c("place") + start).alias("seq"), now.alias("timestamp"), now.cast("string").alias("timestamp_raw"), "input", "output", "source_format",
            F.coalesce("target_format", F.lit(target)).alias("target_format"), "width", "height", F.coalesce("source_bytes", F.lit(0)).cast("long").alias("source_bytes"), "output_bytes",
            F.when(ok, c("elapsed_ms")).otherwise(0).cast("long").alias("elapsed_ms"), ok.alias("success"), F.when(ok, told).otherwise(c("shown")).alias("message"),
        )


@dataclass
class Fold:
    """What a reader of the events knows at any time: counts, a capped log and whether it ended."""

    total: int = 0
    succeeded: int = 0
    failed: int = 0
    finished: bool = False
    log: list[str] = field(default_factory=list)

    def apply(self, e: Event) -> None:
        if e.kind == "started":
            self.total, self.succeeded, self.failed, self.finished = e.total, 0, 0, False
        elif e.kind == "file_done":
            self.succeeded += 1
        elif e.kind == "file_failed":
            self.failed += 1
        elif e.kind == "finished":
            self.finished = True
        if e.kind != "file_started" and e.message:
            self.log = [*self.log, e.message][-history.LOG_LINES :]

    @property
    def shown_progress(self) -> float:
        return (self.succeeded + self.failed) / self.total if self.total else 0.0
