"""Files as rows: folder scans and path lists with their missing files. Writing and ranged reads are in ``assets``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, scalars
from .assets import opened

CONTENT_SCHEMA = "path string, length long, content binary, error_kind string, error_message string"
STREAM_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def scan_folder(spark: SparkSession, path: str, enabled: tuple[str, ...] = formats.REGISTRY, recursive: bool = True) -> DataFrame:
    """Files of a folder with an extension of an enabled format (path, modificationTime, length, content).

    Without content in the plan no file is opened; conditions on length reach the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(formats.from_extension(scalars.extension_of(F.col("path"))).isin(*enabled))


def record_batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """rows in batches of a thousand, or of so many bytes and one row more."""
    wait, held = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*wait, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        wait.append(row)
        held += size(row)
        if held >= most or len(wait) == 1000:
            yield batch()
            wait, held = [], 0
    if wait:
        yield batch()


def read_paths(paths: DataFrame) -> DataFrame:
    """Contents of the files named by ``paths`` (path, others kept aside); what can't be read is an error row.

    Executors open the files, so a list may be of any length and in any store Arrow knows.
    """
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error_kind", pa.string()), ("error_message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from record_batches(map(_read, batch.column(0).to_pylist()), schema, lambda x: len(x[2] or b""))

    return paths.select("path").mapInArrow(run, CONTENT_SCHEMA)


def there(folder: str) -> bool:
    """Whether a folder or file is there."""
    system, at = opened(folder)
    return system.get_file_info(at).type != fs.FileType.NotFound


def _read(path: str | None) -> tuple:
    try:
        system, at = opened(path or "")
        info = system.get_file_info(at)
        if info.type != fs.FileType.File:
            return path, None, None, "InvalidPath", f"文件不存在:{path}"
        with system.open_input_stream(at, compression=None) as f:
            content = f.read()
        return path, len(content), content, None, None
    except (OSError, pa.ArrowException, ValueError) as e:
        return path, None, None, "Io", str(e)


def total_length(files: DataFrame) -> DataFrame:
    """One row with the bytes of all files whose size is known."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted paths that were not found, as error rows."""
    return wanted.join(found.select("path"), "path", "left_anti").select("path", F.lit("InvalidPath").alias("error_kind"), F.concat(F.lit("文件不存在:"), F.col("path")).alias("error_message"))


def existing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.join(found.select("path"), "path", "left_semi")
