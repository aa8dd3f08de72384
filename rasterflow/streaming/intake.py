"""Files as they arrive: a structured stream over a folder, converted micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import formats, scalars
from ..functions.options import CompressOptions, ConvertOptions
from ..plans import convert
from ..sources.files import STREAM_SCHEMA


def incoming(spark: SparkSession, folder: str, files_per_trigger: int = 256, enabled: tuple[str, ...] = formats.REGISTRY) -> DataFrame:
    """A stream of the folder's files with an enabled extension."""
    files = spark.readStream.format("binaryFile").schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.where(formats.from_extension(scalars.extension_of(F.col("path"))).isin(*enabled))


def convert_stream(stream: DataFrame, options: ConvertOptions | CompressOptions, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs until what is there is done. ``sink`` gets the outcomes of each micro-batch and its number.

    A micro-batch that is run again after a failure has the same number and the same files. Output names are kept
    in a table beside the checkpoint, a part for each micro-batch, so that no later one gives a name again.
    """

    def each(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        rows = convert.coded(files.select("path", "content"), options)
        if options.overwrite:
            return sink(convert.planned(rows, options, spark.createDataFrame([], "path string"), F.current_timestamp()), number)
        # an empty part makes the table there from the first micro-batch on
        names = f"{checkpoint.rstrip('/')}-names"
        spark.createDataFrame([], "path string").write.mode("overwrite").parquet(f"{names}/batch=-1")
        given = spark.read.schema("path string, batch long").parquet(names).where(F.col("batch") < number).select("path")
        done = convert.planned(rows, options, given, F.current_timestamp())
        done.where("output <> ''").select(F.col("output").alias("path")).write.mode("overwrite").parquet(f"{names}/batch={number}")
        sink(done, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_stream(stream: DataFrame) -> DataFrame:
    """Files and bytes so far by format, kept as streaming state."""
    known = formats.from_extension(scalars.extension_of(F.col("path")))
    return stream.groupBy(known.alias("format")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
