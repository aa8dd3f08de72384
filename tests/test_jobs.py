import json

import pytest
from pyspark.sql import functions as F

from rasterflow.functions.formats import BY_ID, REGISTRY
from rasterflow.functions.options import CompressOptions, ConvertOptions, TransformOptions
from rasterflow.operators import history, raster, sniff
from rasterflow.plans import convert, naming
from rasterflow.plans.batch import Batch, Event, Fold
from rasterflow.sources import codecs, files, history_json
from rasterflow.streaming import intake


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for i in range(5):
        (at / f"in{i}.bmp").write_bytes(codecs.encode(raster.gradient(20 + i, 12 + i), "bmp"))
    (at / "broken.bmp").write_bytes(b"not an image at all")
    (at / "lying.png").write_bytes(codecs.encode(raster.gradient(9, 9), "qoi"))
    (at / "notes.txt").write_text("x")
    return at


def listed(folder):
    return sorted(str(p) for p in folder.iterdir() if p.suffix != ".txt") + [str(folder / "missing.bmp")]


def test_convert_job_with_errors_as_rows(spark, folder, tmp_path):
    paths = spark.createDataFrame([(p,) for p in listed(folder)], "path string")
    options = ConvertOptions("qoi", str(tmp_path / "out" / "deep"), transform=TransformOptions(rotate="Deg90"))
    rows = convert.run_job(spark, paths, options).cache()
    by = {r["input"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert by["in3.bmp"]["width"] == 15 and by["in3.bmp"]["height"] == 23 and by["in3.bmp"]["notes"] == ["输出体积比原文件大约 24%"]
    assert by["lying.png"]["source_format"] == "qoi" and by["lying.png"]["notes"][0] == "源格式与目标格式相同,文件已被重新编码"
    assert by["broken.bmp"]["error_kind"] == "Corrupt" and by["broken.bmp"]["output"] == ""
    assert by["missing.bmp"]["error_kind"] == "InvalidPath" and by["missing.bmp"]["error_message"].startswith("文件不存在:")
    assert convert.write(rows).where("error_kind is null").count() == 6
    back = codecs.decode_as((tmp_path / "out" / "deep" / "in0.qoi").read_bytes(), "qoi")
    assert (back == raster.rotate(raster.gradient(20, 12), "Deg90")).all()
    assert "20×12" not in convert.summaries(rows.where("error_kind is null")).first()["summary"]
    rows.unpersist()


def test_a_damaged_file_of_each_format_is_an_error_row(spark, tmp_path):
    """Bytes behind the first mark are replaced, so that decoders get past their first check; the good file beside it converts."""
    import random

    rnd = random.Random(3)
    for name in REGISTRY:
        good = codecs.encode(raster.gradient(9, 7), name)
        (tmp_path / f"good.{BY_ID[name].primary}").write_bytes(good)
        for k in range(4):
            bad = bytearray(good)
            for _ in range(6):
                bad[rnd.randrange(min(8, len(bad) - 1), len(bad))] = rnd.randrange(256)
            (tmp_path / f"bad{k}.{BY_ID[name].primary}").write_bytes(bytes(bad[: len(bad) - rnd.choice([0, 5])]))
    scan = codecs.encode(raster.gradient(9, 7), "jpeg")
    at = scan.index(b"\xff\xda")
    (tmp_path / "scan.jpg").write_bytes(scan[: at + 5] + b"\x77" + scan[at + 6 :])
    paths = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.iterdir())], "path string")
    by = {r["input"].rsplit("/", 1)[1]: r for r in convert.run_job(spark, paths, ConvertOptions("qoi", "/out")).drop("encoded").collect()}
    assert len(by) == 5 * len(REGISTRY) + 1
    assert all(r["error_kind"] is None for n, r in by.items() if n.startswith("good"))
    assert by["scan.jpg"]["error_kind"] == "Corrupt" and "119" in by["scan.jpg"]["error_message"]


def test_compression_targets_and_notes(spark, folder, tmp_path):
    paths = spark.createDataFrame([(str(folder / "in4.bmp"),)], "path string")
    row = convert.run_job(spark, paths, CompressOptions(format_strategy="Webp", output_dir=str(tmp_path))).first()
    assert row["target_format"] == "webp" and row["output"].endswith("in4_converted.webp") and any(n.startswith("压缩已节省 ") for n in row["notes"])
    with pytest.raises(codecs.Unsupported):
        convert.convert_bytes(codecs.encode(raster.gradient(300, 300), "bmp"), ConvertOptions("ico"))
    assert codecs.detect(convert.convert_bytes(codecs.encode(raster.gradient(3, 3), "bmp"), ConvertOptions("png"))) == "png"


def test_names_are_unique_and_stable(spark):
    rows = spark.createDataFrame([(f"/a/{i}", "/o/x.png") for i in range(30)] + [("/b", "/o/x(2).png"), ("/c", "/o/x(2).png"), ("/d", "/o/y")], "input string, path string")
    there = spark.createDataFrame([("/o/x.png",), ("/o/x(5).png",), ("/o/y",)], "path string")
    got = {r["input"]: r["output"] for r in naming.unique_paths(rows, there).collect()}
    outs = list(got.values())
    assert len(set(outs)) == len(outs) and not set(outs) & {"/o/x.png", "/o/x(5).png", "/o/y"}
    assert got["/d"] == "/o/y(1)" and "/o/x(2).png" in (got["/b"], got["/c"]) and "/o/x(1).png" in outs
    assert {r["input"]: r["output"] for r in naming.unique_paths(rows.repartition(7), there).collect()} == got
    assert spark.range(1).select(naming.numbered(F.lit("/o/x.png"), F.lit(10000))).first()[0] == "/o/x.png"


def test_batch_counts_events_and_history(spark, folder, tmp_path):
    batch = Batch(spark, [*listed(folder), listed(folder)[0]], ConvertOptions("png", str(tmp_path / "o")), workers=1)
    events, fold = [], Fold()
    summary = batch.run(lambda e: (events.append(e), fold.apply(e)))
    assert (summary.total, summary.succeeded, summary.failed, summary.cancelled) == (8, 6, 2, False)
    assert summary.progress == 1.0 and fold.finished and fold.shown_progress == 1.0 and (fold.succeeded, fold.failed) == (6, 2)
    assert events[0].kind == "started" and events[-1].kind == "finished" and "成功 6 个,失败 2 个" in events[-1].message
    rows = batch.history()
    t = history.totals(rows).first()
    assert (t["n"], t["succeeded"], t["failed"]) == (8, 6, 2) and t["total_source_bytes"] > 19
    assert len(list((tmp_path / "o").iterdir())) == 6
    again = Batch(spark, [listed(folder)[1]], ConvertOptions("png", str(tmp_path / "o")), existing=spark.createDataFrame([(str(p),) for p in (tmp_path / "o").iterdir()], "path string"))
    again.run()
    assert again.outcomes.first()["output"].endswith("(1).png")


def test_cancelled_batch_begins_no_more(spark, folder):
    batch = Batch(spark, [str(folder / "in0.bmp")] * 1 + [f"/nowhere/{i}" for i in range(9)], ConvertOptions("png"), workers=1, write=False)
    summary = batch.run(lambda e: batch.cancel.set() if e.kind in ("file_done", "file_failed") else None)
    assert summary.cancelled and 0 < summary.processed <= 5 and summary.text().endswith("(已取消)")
    # run again in the same folder, it goes on with the files that were not begun
    seen = []
    rest = Batch(spark, [], ConvertOptions("png"), write=False, folder=batch.folder)
    assert rest.run(lambda e: seen.append(e.index) if e.kind == "file_started" else None).processed == 10 and not rest.summary.cancelled
    assert len(seen) == 10 - summary.processed and rest.outcomes.select("place").distinct().count() == 10
    empty = Batch(spark, [], ConvertOptions("png")).run()
    assert empty.total == 0 and empty.progress == 1.0 and Fold().shown_progress == 0.0
    fold = Fold()
    for i in range(2100):
        fold.apply(Event("file_failed", i, message=str(i)))
    assert len(fold.log) == 2000 and fold.log[-1] == "2099"


def test_files_are_coded_once(spark, folder, tmp_path):
    from rasterflow.sources.shared import written

    paths = spark.createDataFrame([(p,) for p in listed(folder)], "path string")
    plan = convert.run_job(spark, paths, ConvertOptions("qoi", str(tmp_path)))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan.split("== Physical Plan ==")[1]
    spent = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            spent.add(b.num_rows)
            yield b

    rows = convert.coded(files.read_paths(paths), ConvertOptions("qoi", str(tmp_path)))
    done = convert.planned(rows.mapInArrow(count, rows.schema), ConvertOptions("qoi", str(tmp_path)), spark.createDataFrame([], "path string"), F.current_timestamp())
    assert done.count() == 8 and done.where("output <> ''").count() == 6 and spent.value == 8
    assert written(done, "t").count() == 8


def test_rounds_of_a_batch_give_no_name_twice(spark, folder, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    for i in range(5):
        (other / f"in{i}.bmp").write_bytes((folder / f"in{i}.bmp").read_bytes())
    batch = Batch(spark, [str(d / f"in{i}.bmp") for d in (folder, other) for i in range(5)], ConvertOptions("png", str(tmp_path / "o")), workers=1)
    assert batch.run().succeeded == 10 and batch.outcomes.select("round").distinct().count() > 1
    assert batch.progress().agg(F.sum("rows")).first()[0] == 10
    assert len(list((tmp_path / "o").iterdir())) == 10 and [r["seq"] for r in batch.history(3).orderBy("seq").collect()] == list(range(3, 13))


def test_stream_gives_no_name_twice(spark, tmp_path):
    for d in "ab":
        for i in range(3):
            (tmp_path / "in" / d).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / d / f"x{i}.bmp").write_bytes(codecs.encode(raster.gradient(4, 4), "bmp"))
    seen = []
    stream = intake.incoming(spark, str(tmp_path / "in" / "*"), files_per_trigger=2)
    query = intake.convert_stream(stream, ConvertOptions("qoi", str(tmp_path / "out")), str(tmp_path / "cp"), lambda df, n: seen.extend(r["output"] for r in df.collect()))
    query.awaitTermination(120)
    assert query.exception() is None and len(seen) == 6 == len(set(seen))


def test_history_file_round_trip(spark, tmp_path):
    at = str(tmp_path / "d" / "history.json")
    rows = spark.createDataFrame([(i, None, f"2024-01-02T03:04:{i % 60:02d}+00:00", f"/i{i}", "", "bmp" if i % 2 else None, "qoi", 8, 4, 100, 50, 12, bool(i % 2), "m") for i in range(510)], history.SCHEMA)
    history_json.write(rows, at)
    saved = json.load(open(at, encoding="utf-8"))["entries"]
    assert len(saved) == 500 and saved[1]["source_format"] == "Bmp" and saved[0]["target_format"] == "Qoi"
    back = history_json.read(spark, at)
    assert back.count() == 500 and back.where("source_format = 'bmp' and success").count() == 250
    assert history.displayed(back).orderBy("seq").first()["time"] == "2024-01-02 03:04:10"
    (tmp_path / "bad.json").write_text("{")
    assert history_json.read(spark, str(tmp_path / "bad.json")).count() == 0
    assert history_json.read(spark, str(tmp_path / "none.json")).count() == 0


def test_history_operations(spark):
    rows = spark.createDataFrame([(i, f"/in/A{i}", "", "x" if i else "说明") for i in range(6)], "seq long, input string, output string, message string")
    assert [r["seq"] for r in history.recent(rows, 2).collect()] == [5, 4]
    assert [r["seq"] for r in history.retain_recent(rows, 2).collect()] == [4, 5]
    assert [r["seq"] for r in history.search(rows, " a3  x ").collect()] == [3]
    assert history.search(rows, "说明").count() == 1 and history.search(rows, " \t").count() == 6
    new = rows.limit(2).withColumn("input", F.lit("n"))
    assert [(r["seq"], r["input"]) for r in history.append(rows, new, 3).collect()] == [(5, "/in/A5"), (6, "n"), (7, "n")]
    assert history.totals(history.empty(spark)).first()["is_empty"]


def test_folder_scan_and_sniffing(spark, folder):
    scan = files.scan_folder(spark, str(folder))
    assert scan.count() == 7
    plan = scan.where("length > 50").select("path", "length")._jdf.queryExecution().toString()
    assert "GreaterThan(length,50)" in plan
    found = {r["path"].rsplit("/", 1)[1]: r["detected_format"] for r in sniff.detected(scan).select("path", "detected_format").collect()}
    assert found["in1.bmp"] == "bmp" and found["lying.png"] == "qoi" and found["broken.bmp"] is None
    packed = spark.createDataFrame([(bytearray(__import__("gzip").compress(b"<svg/>")),), (bytearray(b"\x1f\x8bxx"),), (None,)], "content binary")
    assert [r[0] for r in packed.select(sniff.is_svg(F.col("content"))).collect()] == [True, False, False]


def test_streaming_intake(spark, folder, tmp_path):
    seen = []
    stream = intake.incoming(spark, str(folder), files_per_trigger=3)
    query = intake.convert_stream(stream, ConvertOptions("qoi", str(tmp_path)), str(tmp_path / "cp"), lambda df, n: seen.extend((n, r["input"], r["error_kind"]) for r in df.collect()))
    query.awaitTermination(120)
    assert query.exception() is None and len(seen) == 7 and len({n for n, _, _ in seen}) == 3 and sum(k is not None for _, _, k in seen) == 1
    totals = intake.totals_stream(intake.incoming(spark, str(folder))).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    totals.awaitTermination(120)
    assert {r["format"]: r["files"] for r in spark.table("totals").collect()} == {"bmp": 6, "png": 1}
