"""Helpers of the training-data operators: shared-folder tables and word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: words are runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset and all runs in
    one process (tests) a folder of its own is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterflow-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_open: list[list[str]] = []


@contextmanager
def paths_made() -> Iterator[list[str]]:
    """The paths that new_path gives out meanwhile, so that a stage's tables can be deleted when its result is written."""
    _open.append(made := [])
    try:
        yield made
    finally:
        _open.pop()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


class Scratch:
    """Tables written to the shared folder; cuts lineage and can be deleted again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete(self.spark, path)

    def drop_all(self) -> None:
        self.drop(*list(self.paths))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
