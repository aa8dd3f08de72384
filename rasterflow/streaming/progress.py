"""Batches as streams: their events folded to a state for each batch, and progress as rows of a table.

The fold is keyed streaming state: counts, whether a batch has ended, and the newest lines of its log, in the state
store of the executors, so that it lives as long as the stream and survives its restarts. Events of a batch may come in any
order, inside a micro-batch and across several; what counts is their ``seq``. A batch that is started again begins its counts
anew, provided that the events of its earlier run came before.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators import history
from ..sources.assets import opened

#: batch: key of the batch; seq: place of the event in it; kind: started, file_started, file_done, file_failed or finished.
EVENT = "batch string, seq long, kind string, index long, input string, output string, message string, total long"
FOLDED = "batch string, total long, succeeded long, failed long, finished boolean, shown_progress double, lines long, log array<string>"
#: The store that keeps large state outside the memory of tasks.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# built by hand, as a processor is set up where there is no session to parse DDL
_COUNTS = StructType([StructField(n, BooleanType() if n == "finished" else LongType()) for n in ("started", "first", "last", "total", "succeeded", "failed", "finished", "lines")])
_SEQ, _MESSAGE = StructType([StructField("seq", LongType())]), StructType([StructField("message", StringType())])


class FoldBatches(StatefulProcessor):
    """Counts in one value, log lines in a map by seq, of which the newest ``keep`` stay."""

    def __init__(self, keep: int = history.LOG_LINES, shown: int = 5):
        self.keep, self.shown = keep, shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", _COUNTS)
        self.log = handle.getMapState("log", _SEQ, _MESSAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, first, last, total, succeeded, failed, finished, lines = self.counts.get() if self.counts.exists() else (-1, -1, -1, 0, 0, 0, False, 0)
        fresh: dict[int, str] = {}
        for some in rows:  # a key's rows come in pieces, none of which is kept
            begun = some[some["kind"] == "started"]
            if len(begun) and begun["seq"].max() > started:
                at = begun["seq"].idxmax()
                started, total = int(begun.loc[at, "seq"]), int(begun.loc[at, "total"])
                if first < started:  # what was counted belongs to an earlier run, or nothing was
                    first, last, succeeded, failed, finished = -1, -1, 0, 0, False
            told = some[(some["kind"] != "file_started") & some["message"].notna() & (some["message"] != "")]
            fresh.update(zip(told["seq"].tolist(), told["message"].tolist(), strict=True))
            if len(fresh) > 2 * self.keep:
                fresh = dict(sorted(fresh.items())[-self.keep :])
            after = some[(some["seq"] > started) & (some["kind"] != "started")]
            if len(after):
                first, last = int(after["seq"].min()) if first < 0 else min(first, int(after["seq"].min())), max(last, int(after["seq"].max()))
            kinds = after["kind"].value_counts()
            succeeded, failed = succeeded + int(kinds.get("file_done", 0)), failed + int(kinds.get("file_failed", 0))
            finished = finished or "finished" in kinds
        for seq, message in fresh.items():
            lines += not self.log.containsKey((seq,))
            self.log.updateValue((seq,), (message,))
        kept = sorted(seq for (seq,) in self.log.keys())
        for seq in kept[: max(0, lines - self.keep)]:
            self.log.removeKey((seq,))
        kept, lines = kept[max(0, lines - self.keep) :], min(lines, self.keep)
        self.counts.update((started, first, last, total, succeeded, failed, finished, lines))
        newest = [self.log.getValue((seq,))[0] for seq in kept[-self.shown :]]
        yield pd.DataFrame({"batch": [key[0]], "total": [total], "succeeded": [succeeded], "failed": [failed], "finished": [finished], "shown_progress": [(succeeded + failed) / total if total else 0.0], "lines": [lines], "log": [newest]})

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, keep: int = history.LOG_LINES, shown: int = 5) -> DataFrame:
    """The state of each batch (``FOLDED``) whenever events (``EVENT``) of it came; for an output mode of update."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return events.groupBy("batch").transformWithStateInPandas(FoldBatches(keep, shown), FOLDED, "Update", "None")


def folded(spark: SparkSession, events: str, work: str, keep: int = history.LOG_LINES, shown: int = 5, files_per_trigger: int = 64) -> DataFrame:
    """The last state of each batch over all files of events in a folder; what came since the last call is folded in.

    ``work`` holds the stream's checkpoint and the states of each micro-batch; a micro-batch that runs again writes the same part.
    """
    stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(events)

    def each(states: DataFrame, number: int) -> None:
        states.write.mode("overwrite").parquet(f"{work}/states/micro={number}")

    query = fold_stream(stream, keep, shown).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema(FOLDED + ", micro long").parquet(f"{work}/states")
    return states.groupBy("batch").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("batch", "micro")]), "micro").alias("s")).select("batch", "s.*")


class ProgressRows(StreamingQueryListener):
    """Writes a row for each micro-batch of the streams of a session: a small file each, put in place by a rename."""

    def __init__(self, folder: str):
        self.folder, self.seen, self.lock = folder, 0, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"run": str(p.runId), "micro": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": dict(p.durationMs).get("triggerExecution")}
        system, at = opened(self.folder)
        system.create_dir(at, recursive=True)
        name = f"{row['run']}-{row['micro']}"
        with system.open_output_stream(f"{at}/.{name}.part", compression=None) as f:
            f.write(json.dumps(row).encode())
        system.move(f"{at}/.{name}.part", f"{at}/{name}.json")
        with self.lock:
            self.seen += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


PROGRESS = "run string, micro long, at string, rows long, rows_per_second double, ms long"


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """What ``ProgressRows`` wrote."""
    return spark.read.schema(PROGRESS).json(folder)
