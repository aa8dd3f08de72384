"""Format detection on binary columns, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from ..functions.formats import REGISTRY
from ..sources.codecs import MAGIC


def _bytes(b: bytes) -> Column:
    return F.unhex(F.lit(b.hex()))


def is_plain_svg(content: Column) -> Column:
    """Not packed: the first 1024 bytes are whole UTF-8 and begin like SVG, or like XML with an svg element."""
    head = F.substring(content, 1, 1024)
    text = F.regexp_replace(head.cast("string"), r"(?U)^\s+", "")
    return F.is_valid_utf8(head.cast("string")) & (text.startswith("<svg") | text.startswith("<?xml") & F.contains(head.cast("string"), F.lit("<svg")))


@pandas_udf(BooleanType())
def _packed_svg(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from ..sources.codecs import is_svg

    for s in heads:
        yield s.map(lambda b: b is not None and is_svg(bytes(b)))


def is_svg(content: Column) -> Column:
    """Plain or gzip-packed; Python sees no more than the head of packed rows."""
    packed = F.startswith(content, _bytes(b"\x1f\x8b"))
    return F.coalesce(F.when(packed, _packed_svg(F.when(packed, F.substring(content, 1, 65536)))).otherwise(is_plain_svg(content)), F.lit(False))


def magic(content: Column) -> Column:
    """The format id of the first bytes; null if none is known."""
    out = F.lit(None).cast("string")
    for format_id, marks in reversed(MAGIC):
        hit = F.lit(True)
        for at, mark in marks:
            hit = hit & (F.substring(content, at + 1, len(mark)) == _bytes(mark))
        out = F.when(hit, format_id).otherwise(out)
    return out


def detect(content: Column, enabled: tuple[str, ...] = REGISTRY, packed: bool = True) -> Column:
    """SVG first, then first bytes; null unless the format is enabled. TGA has no mark."""
    found = F.when(is_svg(content) if packed else is_plain_svg(content), "svg").otherwise(magic(content))
    return F.when(found.isin(*enabled), found)


def detected(files: DataFrame, enabled: tuple[str, ...] = REGISTRY) -> DataFrame:
    """``files`` (content) with detected_format."""
    return files.withColumn("detected_format", detect(F.col("content"), enabled))
