import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterflow.functions.options import ConvertOptions
from rasterflow.operators import raster
from rasterflow.plans.batch import Batch, Event, Fold
from rasterflow.sources import codecs
from rasterflow.streaming import progress


def events(rnd, name, files, restarted=False):
    """A batch's events in order, and the fold of them on the driver."""
    rows, fold = [], Fold()

    def add(kind, message="", total=0):
        rows.append((name, len(rows), kind, -1, "i", "o", message, total))
        fold.apply(Event(kind, message=message, total=total))

    for run in range(1 + restarted):
        add("started", total=files)
        for i in range(files):
            add("file_started", "never shown")
            add(rnd.choice(["file_done", "file_failed"]), rnd.choice(["", f"{name} {run} {i}"]))
        if run == restarted:
            add("finished", f"{name} ended", files)
    return rows, fold


def check(states, folds, keep):
    got = {r["batch"]: r for r in states.collect()}
    assert set(got) == set(folds)
    for name, fold in folds.items():
        r = got[name]
        assert (r["total"], r["succeeded"], r["failed"], r["finished"]) == (fold.total, fold.succeeded, fold.failed, fold.finished), name
        assert r["lines"] == min(len(fold.log), keep) and r["log"] == fold.log[-min(5, keep) :] and r["shown_progress"] == fold.shown_progress


@pytest.mark.parametrize("keep", [2000, 7])
def test_state_equals_the_fold_of_all_events(spark, tmp_path, keep):
    """Files of events in any order over several micro-batches, and a second call that goes on from the first."""
    rnd = random.Random(keep)
    made = {f"b{i}": events(rnd, f"b{i}", rnd.choice([0, 1, 30])) for i in range(6)}
    rows = [r for part, _ in made.values() for r in part]
    rnd.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], progress.EVENT).coalesce(1).write.parquet(str(tmp_path / "events" / str(i)))
    work = str(tmp_path / "work")
    check(progress.folded(spark, str(tmp_path / "events"), work, keep, files_per_trigger=1), {k: f for k, (_, f) in made.items()}, keep)
    more, fold = events(rnd, "later", 4)
    spark.createDataFrame(more, progress.EVENT).write.parquet(str(tmp_path / "events" / "later"))
    check(progress.folded(spark, str(tmp_path / "events"), work, keep), {k: f for k, (_, f) in made.items()} | {"later": fold}, keep)


def test_a_second_start_begins_anew(spark, tmp_path):
    rows, fold = events(random.Random(1), "twice", 5, restarted=True)
    again = next(i for i, r in enumerate(rows) if i and r[2] == "started")
    for i, part in enumerate((rows[:again], rows[again:])):
        spark.createDataFrame(part, progress.EVENT).coalesce(1).write.parquet(str(tmp_path / "events" / str(i)))
        states = progress.folded(spark, str(tmp_path / "events"), str(tmp_path / "work"))
    check(states, {"twice": fold}, 2000)


def test_a_batch_that_fails_goes_on(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.bmp").write_bytes(codecs.encode(raster.gradient(4, 4), "bmp"))
    paths = spark.createDataFrame([(str(tmp_path / f"{i % 12}.bmp"),) for i in range(20)], "path string")
    batch = Batch(spark, paths, ConvertOptions("qoi", str(tmp_path / "out")), workers=1)
    started = []

    def fails(e):
        started.append(e.index) if e.kind == "file_started" else None
        if len(started) == 5:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        batch.run(fails)
    again = Batch(spark, paths, ConvertOptions("qoi", str(tmp_path / "out")), workers=1, folder=batch.folder)
    summary = again.run()
    assert (summary.total, summary.succeeded, summary.failed) == (12, 12, 0) and len(list((tmp_path / "out").iterdir())) == 12
    state = progress.folded(spark, f"{batch.folder}/events", str(tmp_path / "work")).first()
    assert (state["total"], state["succeeded"], state["finished"], state["shown_progress"]) == (12, 12, True, 1.0)
    assert state["lines"] == 13 and "成功 12 个" in state["log"][-1]
    rows = batch.progress()
    assert rows.agg(F.sum("rows")).first()[0] >= 12 and isinstance(rows.toPandas(), pd.DataFrame)
