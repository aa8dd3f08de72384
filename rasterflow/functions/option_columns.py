"""Options as columns: what ``options`` decides for one run, for every row of a table of settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import lookup
from .options import COLOR_NAMES, PRESET_VALUES, PRESETS, RESIZE_MODES, ROTATIONS
from .scalars import MAX_DIMENSION


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def default_workers(cpus: Column) -> Column:
    """Logical processors, 1 to 8; 4 where unknown."""
    return clamp(F.coalesce(cpus, F.lit(4)), 1, 8)


def workers(n: Column) -> Column:
    return clamp(n, 1, 64)


def quality(n: Column) -> Column:
    return clamp(n, 1, 100)


def png_level(n: Column) -> Column:
    return F.least(n, F.lit(9))


def resize(width: Column, height: Column) -> Column:
    """struct(width, height) held to the greatest side; null without a size or with a zero side."""
    held = F.struct(F.least(width, F.lit(MAX_DIMENSION)).alias("width"), F.least(height, F.lit(MAX_DIMENSION)).alias("height"))
    return F.when((width != 0) & (height != 0), held)


def preset_texts(preset: Column) -> tuple[Column, Column]:
    """(name, hint) of a preset."""
    return lookup(preset, {k: v[0] for k, v in PRESETS.items()}), lookup(preset, {k: v[1] for k, v in PRESETS.items()})


def preset_values(preset: Column) -> tuple[Column, Column, Column, Column]:
    """(quality, PNG level, fast PNG, downscale) that a preset sets."""
    return tuple(lookup(preset, {k: v[i] for k, v in PRESET_VALUES.items()}) for i in range(4))


def apply_preset(preset: Column, own_quality: Column, own_level: Column, own_fast: Column, own_downscale: Column) -> tuple[Column, Column, Column, Column]:
    """What holds behind a change of preset: Custom keeps what was set."""
    return tuple(F.when(preset == "Custom", own).otherwise(new) for own, new in zip((own_quality, own_level, own_fast, own_downscale), preset_values(preset), strict=True))


def encode_options(text: Column) -> Column:
    """struct(quality, png_compression_level, png_fast_mode) of JSON; the PNG options may be left out, as older files do."""
    o = F.from_json(text, "quality int, png_compression_level int, png_fast_mode boolean")
    return F.when(o["quality"].isNotNull(), F.struct(o["quality"].alias("quality"), F.coalesce(o["png_compression_level"], F.lit(1)).alias("png_compression_level"), F.coalesce(o["png_fast_mode"], F.lit(True)).alias("png_fast_mode")))


def is_identity(size: Column, grayscale: Column, horizontal: Column, vertical: Column, rotate: Column, color: Column) -> Column:
    """Nothing to do; size is a struct or null, and the way to resize alone does nothing."""
    return size.isNull() & ~grayscale & ~horizontal & ~vertical & (rotate == "None") & color.isNull()


def transform_summary(size: Column, mode: Column, grayscale: Column, horizontal: Column, vertical: Column, rotate: Column, color: Column) -> Column:
    """The steps of a transform in a line."""
    parts = F.array(
        F.when(size.isNotNull(), F.concat(F.lit("缩放至 "), size["width"].cast("string"), F.lit("×"), size["height"].cast("string"), F.lit("("), lookup(mode, RESIZE_MODES), F.lit(")"))),
        F.when(grayscale, "灰度"), F.when(horizontal, "水平镜像"), F.when(vertical, "垂直镜像"), F.when(rotate != "None", lookup(rotate, ROTATIONS)),
        F.when(color.isNotNull(), F.concat(F.lit("颜色模式 "), lookup(color, COLOR_NAMES))),
    )
    return F.when(is_identity(size, grayscale, horizontal, vertical, rotate, color), "无变换").otherwise(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "、"))
