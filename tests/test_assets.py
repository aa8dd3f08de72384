import os
import signal
import subprocess
import sys
import textwrap
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rasterflow.operators import raster, sniff
from rasterflow.sources import assets, codecs


@pytest.fixture
def folder(tmp_path):
    for i in range(40):
        at = tmp_path / "in" / str(i % 3)
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{i}.bmp").write_bytes(codecs.encode(raster.gradient(3 + i, 3), "bmp"))
    (tmp_path / "in" / "large.bin").write_bytes(b"x" * 5_000_000)
    (tmp_path / "in" / "empty.bin").write_bytes(b"")
    return tmp_path / "in"


def test_scan_packs_by_size_and_reads_what_is_asked_for(spark, folder):
    rows = assets.scan(spark, str(folder), "path string, length long, head binary, content binary", head=16, partition_bytes=1 << 20)
    by = {r["path"]: r for r in rows.collect()}
    assert len(by) == 42
    for p, r in by.items():
        data = Path(p).read_bytes()
        assert (r["length"], bytes(r["head"]), bytes(r["content"])) == (len(data), data[:16], data)
    parts = rows.select(F.spark_partition_id().alias("p"), "length").groupBy("p").agg(F.max("length").alias("most"), F.count("*").alias("n")).collect()
    assert len(parts) > 4 and min(r["n"] for r in parts if r["most"] == 5_000_000) == 1
    assert assets.scan(spark, str(folder), "path string").count() == 42
    assert assets.scan(spark, f"file://{folder}", "path string").first()["path"].startswith(f"file://{folder}")
    assert assets.scan(spark, str(folder / "none"), "path string").count() == 0


def test_heads_are_ranged_reads(spark, folder, monkeypatch):
    """A reader without content opens files but reads the head alone; one without head opens none."""
    from pyspark.sql.types import StructType

    of = lambda ddl: assets.AssetReader(StructType.fromDDL(ddl), {"path": str(folder), "head": "8"})
    opened, real = [], assets.opened

    class Counting:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, at):
            f = self.system.open_input_file(at)
            opened.append(f)
            return f

    monkeypatch.setattr(assets, "opened", lambda p: (Counting(real(p)[0]), real(p)[1]) if os.path.isfile(p) else real(p))
    reader = of("path string, head binary")
    read = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in read) == 42 and len(opened) == 42 and all(len(h or b"") <= 8 for b in read for h in b.column("head").to_pylist())
    reader = of("path string, length long")
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 42 and len(opened) == 42


def test_conditions_are_settled_on_the_listing(spark, folder):
    rows = assets.scan(spark, str(folder), "path string, length long, head binary").where("length > 1000000 and path like '%.bin'")
    assert [r["length"] for r in rows.collect()] == [5_000_000]
    reader = assets.AssetReader(rows.schema, {"path": str(folder)})
    assert list(reader.pushFilters([assets.GreaterThan(("length",), 1_000_000), assets.StringEndsWith(("path",), ".bin"), assets.EqualTo(("head",), b"x")])) == [assets.EqualTo(("head",), b"x")]
    assert [len(p.found) for p in reader.partitions()] == [1]
    assert rows.where("path is null").count() == 0 and rows.where("length in (0, 5000000)").count() == 1


def test_sniffing_by_heads(spark, folder):
    found = assets.scan(spark, str(folder)).select("path", sniff.detect(F.col("head")).alias("format")).groupBy("format").count().collect()
    assert {r["format"]: r["count"] for r in found} == {"bmp": 40, None: 2}


def test_unreadable_files_are_error_rows(spark, folder):
    (folder / "gone.bmp").symlink_to(folder / "nowhere")
    reader = assets.AssetReader(assets.scan(spark, str(folder)).schema, {"path": str(folder)})
    row = next(reader.read(assets.Files([(str(folder / "gone.bmp"), 4)]))).to_pylist()[0]
    assert row["head"] is None and row["length"] == 4


def test_write_and_read_again(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "folder").mkdir()
    rows = [(str(out / f"{i % 5}" / f"{i}.bin"), bytes([i]) * i) for i in range(200)] + [(str(out / "folder"), b"x"), (None, b"x"), (str(out / "null.bin"), None), ("", b"x")]
    got = {r["path"]: r for r in assets.write(spark.createDataFrame(rows, "path string, content binary").repartition(7)).collect()}
    assert len(got) == 204 and sum(r["error_kind"] is None for r in got.values()) == 200
    assert all(got[p]["error_kind"] == "Io" for p in (str(out / "folder"), None, str(out / "null.bin"), ""))
    back = assets.scan(spark, str(out), "path string, content binary")
    assert {r["path"]: bytes(r["content"]) for r in back.collect()} == dict(rows[:200])
    assert assets.write(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_jobs_at_once_share_no_name(spark, tmp_path):
    """Four jobs write the same names; a file that is there before keeps its own."""
    import threading

    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "3.bin").write_bytes(b"before")
    results, errors = {}, []

    def job(k):
        try:
            rows = spark.createDataFrame([(str(tmp_path / "out" / f"{i}.bin"), b"%d-%d" % (k, i)) for i in range(12)] + [(str(tmp_path / "out" / "same"), b"%d-a" % k), (str(tmp_path / "out" / "same"), b"%d-b" % k)], "path string, content binary")
            results[k] = {(r["wanted"], r["path"]) for r in assets.write(rows.repartition(3), exclusive=True).collect()}
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=job, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    given = [p for r in results.values() for _, p in r]
    assert not errors and len(given) == len(set(given)) == 4 * 14
    assert (tmp_path / "out" / "3.bin").read_bytes() == b"before"
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"3.bin", *(f"{i}{n}.bin" for i in range(12) for n in ("", "(1)", "(2)", "(3)")), "3(4).bin", "same", *(f"same({n})" for n in range(1, 8))}
    assert {p.read_bytes() for p in (tmp_path / "out").iterdir()} == {b"before", *(b"%d-%d" % (k, i) for k in range(4) for i in range(12)), *(b"%d-%s" % (k, x) for k in range(4) for x in (b"a", b"b"))}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    def fail(batches):
        for i, b in enumerate(batches):
            yield b
        raise RuntimeError("lost")

    rows = spark.createDataFrame([(str(tmp_path / "out" / f"{i}"), b"x" * 1000) for i in range(50)], "path string, content binary")
    with pytest.raises(Exception, match="lost"):
        assets.write(rows.mapInArrow(fail, rows.schema), str(tmp_path))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assets.recover(str(tmp_path))  # tasks that still ran when the write was given up may have begun another attempt file
    assert not list(tmp_path.glob("staging-*/*"))


KILLED = """
import sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from rasterflow.sources import assets
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
def slow(batches):
    for b in batches:
        yield b
        time.sleep(60)
rows = spark.createDataFrame([({out!r} + "/%d.bin" % i, b"x" * 100000) for i in range(40)], "path string, content binary").repartition(4)
assets.write(rows.mapInArrow(slow, rows.schema), {staging!r})
"""


def test_a_killed_write_leaves_no_file(spark, tmp_path):
    """The driver and its JVM are killed while tasks hold attempt files; what stays is deleted by recover."""
    code = textwrap.dedent(KILLED).format(root=str(Path(__file__).resolve().parents[1]), shared=f"file://{tmp_path}/shared", out=str(tmp_path / "out"), staging=str(tmp_path))
    run = subprocess.Popen([sys.executable, "-c", code], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        until = time.time() + 90
        while time.time() < until and not any(p.is_file() and p.stat().st_size for p in tmp_path.glob("staging-*/*/*")):
            time.sleep(0.2)
    finally:
        os.killpg(run.pid, signal.SIGKILL)
        run.wait()
    assert list(tmp_path.glob("staging-*/*/*")) and not list((tmp_path / "out").glob("*"))
    assert list(assets.recover(str(tmp_path)).values()) == [False]
    assert not list(tmp_path.glob("staging-*")) and not list((tmp_path / "out").glob("*"))


@pytest.mark.parametrize("exclusive", [False, True])
def test_a_write_killed_behind_its_commit_is_completed(tmp_path, monkeypatch, exclusive):
    import pyarrow as pa

    staging = str(tmp_path / "staging-x")
    rows = pa.RecordBatch.from_arrays([pa.array([str(tmp_path / "out" / f"{i}") for i in range(9)]), pa.array([b"abc"] * 9, pa.binary())], ["path", "content"])
    writer, place = assets.AssetWriter(staging, ["path", "content"], exclusive), assets._place

    def dies(at, row, exclusive):
        if int(row["path"][-1]) >= 4:
            raise KeyboardInterrupt
        return place(at, row, exclusive)

    monkeypatch.setattr(assets, "_place", dies)
    with pytest.raises(KeyboardInterrupt):
        writer.commit([writer.write(iter([rows])), None])
    assert len(list((tmp_path / "out").iterdir())) == 4
    monkeypatch.setattr(assets, "_place", place)
    assert assets.recover(str(tmp_path)) == {"staging-x": True}
    assert sorted(p.read_bytes() for p in (tmp_path / "out").iterdir()) == [b"abc"] * 9
    assert assets.recover(str(tmp_path)) == {"staging-x": True} and len(list((tmp_path / "out").iterdir())) == 9
