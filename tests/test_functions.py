import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from rasterflow.functions import formats, scalars as S
from rasterflow.functions.options import CompressOptions, Config, ConvertOptions, Downscale, EncodeOptions, Startup, TransformOptions, default_workers, parse_arguments


def test_fixed_shows_the_stored_value(spark):
    rnd = random.Random(1)
    values = [0.125, 1.125, 0.15, 0.25, 0.35, 2.675, 1.005, -0.05, -0.15, -0.04, 99.95, 0.0, 1e9 + 0.005, 12.5, 13.5, 0.5, 1.5] + [rnd.uniform(-200, 200) for _ in range(500)] + [rnd.randrange(10**6) / 1024 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        for (v, got) in df.select("v", S.fixed(F.col("v"), digits)).collect():
            want = format(Decimal(v).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN), "f")
            assert got == want, (v, digits)


@pytest.mark.parametrize(("size", "shown"), [(0, "0 B"), (512, "512 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (2048, "2.00 KB"), (5 << 20, "5.00 MB"), (1 << 40, "1.00 TB"), (3000 << 40, "3000.00 TB")])
def test_human_size(spark, size, shown):
    assert spark.range(1).select(S.human_size(F.lit(size))).first()[0] == shown


@pytest.mark.parametrize(
    ("path", "name", "stem", "ext", "folder"),
    [
        ("/a/b.tar.GZ", "b.tar.GZ", "b.tar", "gz", "/a"),
        ("/a/.hidden", ".hidden", ".hidden", "", "/a"),
        ("x.png", "x.png", "x", "png", ""),
        ("/x", "x", "x", "", "/"),
        ("/a/b/", "b", "b", "", "/a"),
        ("/", "/", "未命名", "", None),
        ("a.", "a.", "a", "", ""),
    ],
)
def test_paths(spark, path, name, stem, ext, folder):
    p = F.lit(path)
    assert tuple(spark.range(1).select(S.file_name(p), S.file_stem(p), S.extension_of(p), S.parent(p)).first()) == (name, stem, ext, folder)


@pytest.mark.parametrize(("kind", "limit", "size", "to"), [("Max1920", 1, (4000, 3000), (1920, 1440)), ("Max2560", 1, (3000, 4000), (1920, 2560)), ("Max1920", 1, (800, 600), (800, 600)), ("Scale50", 1, (1000, 800), (500, 400)), ("Scale75", 1, (1, 1), (1, 1)), ("CustomMax", 0, (9, 3), (1, 1)), ("Max1920", 1, (2816, 297), (1920, 202)), ("Original", 1, (9, 9), (9, 9)), ("Scale50", 1, (0, 5), (0, 5))])
def test_target_size_on_both_sides(spark, kind, limit, size, to):
    w, h = (F.lit(x).cast("long") for x in size)
    assert tuple(spark.range(1).select(S.target_size(F.lit(kind), F.lit(limit), w, h).alias("t")).select("t.*").first()) == to
    assert Downscale(kind, limit).target_size(*size) == to


def test_lookups(spark):
    ask = lambda c: spark.range(1).select(c).first()[0]
    assert ask(formats.from_extension(F.lit("..JPEG"))) == "jpeg" and ask(formats.from_extension(F.lit("avif"))) is None
    assert ask(formats.from_id(F.lit("　Webp\n"))) == "webp"
    for f in formats.FORMATS:
        assert f.primary in f.extensions and ask(formats.from_id(F.lit(f.id))) == f.id


def test_config_round_trip_and_fallbacks(tmp_path):
    config = Config(target_format="png", output_dir="/o", transform=TransformOptions(resize=(3, 4), color="Gray8"), compress=CompressOptions(downscale=Downscale("CustomMax", 77)), max_workers=3)
    config.save(str(tmp_path / "a" / "config.json"))
    assert Config.load(str(tmp_path / "a" / "config.json")) == config
    assert Config.load(str(tmp_path / "none")) == Config()
    (tmp_path / "bad").write_text("{")
    assert Config.load(str(tmp_path / "bad")) == Config()
    import json

    d = json.loads(config.to_json())
    assert d["target_format"] == "Png" and d["compress"]["downscale"] == {"CustomMax": 77}
    del d["compress"], d["encode"]["png_compression_level"], d["encode"]["png_fast_mode"]
    d["max_workers"], d["transform"]["resize"] = 999, [0, 5]
    old = Config.from_json(json.dumps(d))
    assert old.compress == CompressOptions() and old.encode == EncodeOptions() and old.max_workers == 64 and old.transform.resize is None


def test_options_and_arguments():
    assert CompressOptions() == CompressOptions.from_preset("Balanced")
    assert EncodeOptions(0).clamped_quality == 1 and EncodeOptions(101).clamped_quality == 100
    assert [default_workers(n) for n in (0, 3, 99)] == [1, 3, 8]
    there = {"a.png", "b.png"}.__contains__
    assert parse_arguments(["a.png", "--view", "BATCH", "no.png", "--x", "--auto-start", "b.png"], there) == Startup(("a.png", "b.png"), "batch", True)
    assert parse_arguments(["--view=历史"], there).view == "history" and parse_arguments(["--view=?"], there).view is None
    assert Startup(("a",), None, True).route == ("single", 1) and Startup(("a", "b"), None, True).route[0] == "batch" and Startup(("a",)).route is None
    assert ConvertOptions("png").naming == "KeepOriginal" and TransformOptions(resize_mode="Nearest").is_identity


def test_log_file_begins_anew(tmp_path):
    from rasterflow.functions import logs

    at = tmp_path / "log" / "app.log"
    logs.open_log(str(tmp_path), "INFO", "t1").info("one")
    assert "one" in at.read_text()
    at.write_text("x" * (logs.LIMIT + 1))
    log = logs.open_log(str(tmp_path), "loud", "t1")
    log.info("two")
    log.warning("three")
    assert "two" not in at.read_text() and "three" in at.read_text() and (tmp_path / "log" / "app.log.1").exists()


def test_log_of_a_run(tmp_path):
    import re

    from rasterflow.functions import logs

    logs.start(str(tmp_path), False, "title", "1.0", 3).debug("hidden")
    assert re.fullmatch(r"\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\] \[INFO\] title 1\.0 启动,命令行传入文件 3 个\n", (tmp_path / "log" / "app.log").read_text("utf-8"))
    (tmp_path / "file").write_text("")
    logs.open_log(str(tmp_path / "file"), "info", "t2").info("to standard error alone")
