"""Conversion and compression of files, as plans from files to outcomes.

One Arrow stage decodes, transforms, checks and encodes a file after the other; what goes
wrong with a file is a value of its row, never a failed task. Names, notes, summaries and
history rows are expressions around it. Rows are large, so batches hold few of them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, scalars
from ..functions.formats import BY_ID, REGISTRY
from ..functions.options import CompressOptions, ConvertOptions, EncodeOptions
from ..operators import raster
from ..sources import assets, codecs, files
from ..sources.shared import written
from . import naming

CODED = "input string, source_format string, target_format string, width long, height long, color string, semi_transparent boolean, source_bytes long, output_bytes long, elapsed_ms long, encoded binary, error_kind string, error_message string"
_SCHEMA = pa.schema([
    ("input", pa.string()), ("source_format", pa.string()), ("target_format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("color", pa.string()), ("semi_transparent", pa.bool_()),
    ("source_bytes", pa.int64()), ("output_bytes", pa.int64()), ("elapsed_ms", pa.int64()), ("encoded", pa.binary()), ("error_kind", pa.string()), ("error_message", pa.string()),
])


def preflight(width: int, height: int, target: str) -> None:
    """As ``scalars.preflight``, for one image."""
    codecs.check(target, (*REGISTRY, target))
    for name, limit, label in (("ico", scalars.ICO_MAX, "ICO 图标"), ("gif", scalars.GIF_MAX, "GIF 图像")):
        if target == name and max(width, height) > limit:
            raise codecs.Unsupported(f"{label}最大支持 {limit}×{limit},当前图像为 {width}×{height},请先设置缩放")


def compress_target(strategy: str, source: str, enabled: tuple[str, ...]) -> str:
    if strategy != "KeepOriginal":
        return strategy.lower()
    return source if source in enabled and BY_ID[source].implemented and source != "svg" else "png"


def convert_bytes(data: bytes, options: ConvertOptions, enabled: tuple[str, ...] = REGISTRY, path: str = "memory") -> bytes:
    """One image in memory to another; raises CodecError."""
    return _run(path, data, options, enabled)[-1]


def _run(path: str, data: bytes, options: ConvertOptions | CompressOptions, enabled: tuple[str, ...]) -> tuple:
    image, source = codecs.identify(path, data, enabled)
    try:
        if isinstance(options, CompressOptions):
            image, target, encode = raster.downscale(image, options.downscale), compress_target(options.format_strategy, source, enabled), options.encode
        else:
            image, target, encode = raster.transform(image, options.transform), options.target, options.encode
    except raster.TooLarge as e:
        raise codecs.Unsupported(str(e)) from e
    height, width = image.shape[:2]
    preflight(width, height, target)
    out = codecs.encode(image, target, encode, enabled)
    return source, target, width, height, raster.color_type(image), raster.has_semi_transparent(image), out


def coded(contents: DataFrame, options: ConvertOptions | CompressOptions, enabled: tuple[str, ...] = REGISTRY) -> DataFrame:
    """A row for each of ``contents`` (path, content, and error_kind, error_message of reading)."""
    default = options.target if isinstance(options, ConvertOptions) else None

    def one(path: str, data: bytes | None, kind: str | None, message: str | None) -> tuple:
        started = time.monotonic()
        size = len(data) if data is not None else None
        if kind is None:
            try:
                source, target, width, height, color, semi, out = _run(path, data or b"", options, enabled)
                return path, source, target, width, height, color, semi, size, len(out), int((time.monotonic() - started) * 1000), out, None, None
            except codecs.CodecError as e:
                kind, message = e.kind, str(e)
            except Exception as e:  # a file that no check foresaw is its own error, not the task's
                kind, message = "Corrupt", f"{type(e).__name__}: {e}"
        return path, None, default, 0, 0, None, None, size, 0, int((time.monotonic() - started) * 1000), None, kind, message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = (one(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield from files.record_batches(done, _SCHEMA, lambda x: len(x[-3] or b""))

    columns = [F.col(c) if c in contents.columns else F.lit(None).cast("string").alias(c) for c in ("error_kind", "error_message")]
    return contents.select("path", "content", *columns).mapInArrow(run, CODED)


def planned(rows: DataFrame, options: ConvertOptions | CompressOptions, existing: DataFrame, stamp: Column) -> DataFrame:
    """Coded rows with the output path and notes of what succeeded; output is empty for failures.

    The coded rows are written to the shared folder first, so that files are decoded and encoded once. Names are
    decided over rows of paths alone and joined to the encoded bytes last.
    """
    rows = written(rows.withColumn("_file", F.monotonically_increasing_id()), "coded")
    ok = F.col("error_kind").isNull()
    folder = scalars.output_dir(F.lit(options.output_dir), F.col("input"))
    path = scalars.output_path(F.col("input"), folder, formats.output_extension(F.col("target_format"), F.col("color")), F.lit(options.naming), stamp)
    if options.overwrite:
        named = rows.withColumn("output", F.when(ok, path).otherwise(""))
    else:
        names = written(naming.unique_paths(rows.where(ok).select("_file", "input", path.alias("path")), existing).select("_file", "output"), "names")
        named = rows.join(names, "_file", "left").withColumn("output", F.coalesce("output", F.lit("")))
    s, o = F.col("source_bytes"), F.col("output_bytes")
    notes = scalars.collect_notes(F.col("source_format"), F.col("target_format"), F.col("semi_transparent"), s, o)
    if isinstance(options, CompressOptions):
        notes = F.filter(F.concat(notes, F.array(scalars.saved_note(s, o))), lambda n: n.isNotNull())
    return named.drop("_file").withColumn("notes", F.when(ok, notes).otherwise(F.array().cast("array<string>")))


def run_job(spark: SparkSession, paths: DataFrame, options: ConvertOptions | CompressOptions, existing: DataFrame | None = None, enabled: tuple[str, ...] = REGISTRY, stamp: Column | None = None) -> DataFrame:
    """Outcomes of the files named by ``paths`` (path), before they are written.

    File sizes are skewed, so paths are dealt out in many small parts and tasks take the next
    when they are done.
    """
    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    contents = files.read_paths(paths.repartition(parts))
    none = spark.createDataFrame([], "path string")
    return planned(coded(contents, options, enabled), options, none if existing is None else existing, stamp if stamp is not None else F.current_timestamp())


def write(outcomes: DataFrame, overwrite: bool = True, staging: str | None = None, job: str | None = None) -> DataFrame:
    """Writes the encoded files of outcomes to their output paths, all or none; what became of each.

    Without ``overwrite`` a name that another job took since it was planned is left to it; ``wanted`` has the planned path, ``path`` the one given.
    A named ``job`` is written once, however often it is called.
    """
    return assets.write(outcomes.where("error_kind is null").select(F.col("output").alias("path"), F.col("encoded").alias("content")), staging=staging, exclusive=not overwrite, job=job)


def summaries(outcomes: DataFrame) -> DataFrame:
    c = F.col
    return outcomes.select("input", "output", scalars.outcome_summary(c("source_format"), c("target_format"), c("width"), c("height"), c("source_bytes"), c("output_bytes"), c("elapsed_ms")).alias("summary"), scalars.size_change_percent(c("source_bytes"), c("output_bytes")).alias("change_percent"))


__all__ = ["EncodeOptions", "coded", "compress_target", "convert_bytes", "planned", "preflight", "run_job", "summaries", "write"]
