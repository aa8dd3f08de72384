"""The history file: one JSON object with its entries, enums by variant name."""

from __future__ import annotations

import json
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import FORMATS, lookup
from ..operators import history

_ENTRY = "timestamp string, input string, output string, source_format string, target_format string, width long, height long, source_bytes long, output_bytes long, elapsed_ms long, success boolean, message string"
_IDS = {f.variant: f.id for f in FORMATS}


def read(spark: SparkSession, path: str, count: int = history.KEPT) -> DataFrame:
    """The newest entries of a history file; an empty history where it can't be read."""
    if not Path(path.removeprefix("file://")).is_file() and "://" not in path.removeprefix("file://"):
        return history.empty(spark)
    try:
        raw = spark.read.schema(f"entries array<struct<{_ENTRY.replace(' string', ':string').replace(' long', ':long').replace(' boolean', ':boolean')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
        rows = raw.select(F.posexplode("entries").alias("pos", "e")).select(F.col("pos").cast("long").alias("seq"), "e.*")
        rows.limit(1).count()
    except (PySparkException, Py4JJavaError):
        return history.empty(spark)
    variant = lambda c: lookup(F.col(c), _IDS)
    out = rows.select(
        "seq", F.to_timestamp("timestamp").alias("timestamp"), F.col("timestamp").alias("timestamp_raw"), "input", "output", variant("source_format").alias("source_format"), variant("target_format").alias("target_format"),
        "width", "height", "source_bytes", "output_bytes", "elapsed_ms", "success", "message",
    )
    return history.retain_recent(out, count)


def write(rows: DataFrame, path: str, count: int = history.KEPT) -> None:
    """The newest entries as pretty JSON; at most ``count`` rows reach the driver."""
    variants = {f.id: f.variant for f in FORMATS}
    entries = []
    for r in history.retain_recent(rows, count).collect():
        d = r.asDict()
        d["timestamp"] = d.pop("timestamp_raw") or (d["timestamp"].isoformat() if d["timestamp"] else None)
        d["source_format"] = variants.get(d["source_format"])
        d["target_format"] = variants.get(d["target_format"])
        d.pop("seq")
        entries.append(d)
    at = Path(path.removeprefix("file://"))
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps({"entries": entries}, ensure_ascii=False, indent=2), encoding="utf-8")
