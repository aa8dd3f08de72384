"""Image formats, colour layouts and what is known about them, as dimension tables and expressions.

The dimension tables are a few literal rows; lookups against them are constant map
expressions, so they run inside the scan's stage and never join or shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    variant: str
    id: str
    name: str
    extensions: tuple[str, ...]
    primary: str
    alpha: bool
    lossless: bool
    implemented: bool
    description: str


#: The known formats in the order that lookups by extension use.
FORMATS = (
    Format("Bmp", "bmp", "BMP 位图", ("bmp", "dib"), "bmp", True, True, True, "Windows 标准位图,支持 1/4/8/16/24/32 位与 RLE 压缩"),
    Format("Netpbm", "netpbm", "Netpbm 图像", ("pbm", "pgm", "ppm", "pnm", "pam"), "ppm", True, True, True, "科研常用简单格式,含 PBM/PGM/PPM/PAM 四类"),
    Format("Tga", "tga", "TGA 图像", ("tga", "targa", "icb", "vda", "vst"), "tga", True, True, True, "游戏与影视常用,支持调色板与 RLE 压缩"),
    Format("Qoi", "qoi", "QOI 图像", ("qoi",), "qoi", True, True, True, "为快速编解码设计的现代无损格式"),
    Format("Farbfeld", "farbfeld", "farbfeld 图像", ("ff",), "ff", True, True, True, "16 位每通道的高精度无损格式"),
    Format("Ico", "ico", "ICO 图标", ("ico",), "ico", True, True, True, "Windows 图标容器,内部为 BMP 结构"),
    Format("Png", "png", "PNG 图像", ("png",), "png", True, True, True, "支持透明度与隔行的无损压缩图像格式"),
    Format("Gif", "gif", "GIF 图像", ("gif",), "gif", True, False, True, "动图与调色板格式,支持 256 色与二值透明度"),
    Format("Jpeg", "jpeg", "JPEG 图像", ("jpg", "jpeg", "jpe"), "jpg", False, False, True, "有损照片格式,不支持透明度"),
    Format("Webp", "webp", "WebP 图像", ("webp",), "webp", True, True, True, "现代网页图像格式,支持无损与透明通道"),
    Format("Svg", "svg", "SVG 矢量图", ("svg", "svgz"), "svg", True, True, True, "可缩放矢量图形,输入时光栅化渲染,输出时封装为矢量容器"),
    Format("Heic", "heic", "HEIC 图像", ("heic", "heif"), "heic", False, False, False, "高效率图像格式,规划中"),
)
#: Fixed value: the order in which the registry lists formats and tries decoders.
REGISTRY = ("bmp", "netpbm", "png", "gif", "webp", "qoi", "farbfeld", "ico", "jpeg", "svg", "tga")
#: Colour layouts as (variant, channels, name, alpha, gray).
COLORS = (
    ("Gray8", 1, "灰度", False, True),
    ("GrayAlpha8", 2, "灰度+透明", True, True),
    ("Rgb8", 3, "真彩色", False, False),
    ("Rgba8", 4, "真彩色+透明", True, False),
)
BY_ID = {f.id: f for f in FORMATS}

FORMAT_SCHEMA = "enum_no int, variant string, id string, name string, extensions array<string>, primary_extension string, alpha boolean, lossless boolean, implemented boolean, registry_no int, description string"


def format_dim(spark: SparkSession) -> DataFrame:
    """All formats with their attributes, a row each; registry_no is null where not registered."""
    rows = [(i, f.variant, f.id, f.name, list(f.extensions), f.primary, f.alpha, f.lossless, f.implemented, REGISTRY.index(f.id) if f.id in REGISTRY else None, f.description) for i, f in enumerate(FORMATS)]
    return spark.createDataFrame(rows, FORMAT_SCHEMA)


def color_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(COLORS)], "color_no int, color string, channels int, name string, has_alpha boolean, is_gray boolean")


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """The value of a small literal map at a key; null (or default) where absent."""
    items = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = items[key]
    return found if default is None else F.coalesce(found, default)


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def from_extension(ext: Column) -> Column:
    """Format id of an extension, any number of leading dots ignored."""
    return lookup(ascii_lower(F.regexp_replace(ext, r"^\.+", "")), {e: f.id for f in reversed(FORMATS) for e in f.extensions})


def from_id(text: Column) -> Column:
    """Format id as written by a person: trimmed of Unicode white space, in any ASCII case."""
    return lookup(ascii_lower(trim(text)), {f.id: f.id for f in FORMATS})


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def attribute(format_id: Column, name: str) -> Column:
    """An attribute (name, primary, alpha, lossless, implemented, description, variant) of a format id."""
    return lookup(format_id, {f.id: getattr(f, name) for f in FORMATS})


def channels(color: Column) -> Column:
    return lookup(color, {c[0]: c[1] for c in COLORS})


def color_name(color: Column) -> Column:
    return lookup(color, {c[0]: c[2] for c in COLORS})


def has_alpha(color: Column) -> Column:
    return color.isin("GrayAlpha8", "Rgba8")


def is_gray(color: Column) -> Column:
    return color.isin("Gray8", "GrayAlpha8")


def output_extension(format_id: Column, color: Column) -> Column:
    """The extension that a written file gets; Netpbm's depends on the colour layout."""
    netpbm = F.when(color == "Gray8", "pgm").when(color == "Rgb8", "ppm").otherwise("pam")
    return F.when(format_id == "netpbm", netpbm).otherwise(attribute(format_id, "primary"))


def prepared_color(format_id: Column, color: Column) -> Column:
    """The layout that an encoder is given: icons and two palette-less formats widen it."""
    wide = F.when(color == "Gray8", "Rgb8").when(color == "GrayAlpha8", "Rgba8").otherwise(color)
    return F.when(format_id == "ico", F.lit("Rgba8")).when(format_id.isin("qoi", "gif"), wide).when(format_id == "farbfeld", F.lit("Rgba16")).otherwise(color)


def png_settings(level: Column, fast: Column) -> Column:
    """struct(compression, filter) that a PNG level and the fast switch stand for."""
    quick = F.struct(F.when(level == 0, "Uncompressed").when(level <= 4, "Fast").otherwise("Default").alias("compression"), F.lit("Sub").alias("filter"))
    slow = F.struct(
        F.when(level == 0, "Uncompressed").when(level <= 3, "Fast").when(level <= 7, "Default").otherwise("Best").alias("compression"),
        F.when(level == 0, "NoFilter").when(level <= 7, "Sub").otherwise("Adaptive").alias("filter"),
    )
    return F.when(fast, quick).otherwise(slow)


def availability(format_id: Column, enabled: tuple[str, ...] = REGISTRY) -> tuple[Column, Column]:
    """(error kind, error detail) of a format that can't be used; both null where it can."""
    known = format_id.isin(*enabled) if enabled else F.lit(False)
    kind = F.when(~known, "UnsupportedFormat").when(~attribute(format_id, "implemented"), "UnsupportedFeature")
    detail = F.when(~known, attribute(format_id, "name")).when(~attribute(format_id, "implemented"), F.concat(attribute(format_id, "name"), F.lit("的编解码功能尚未实现,请选择其它目标格式")))
    return kind, detail


def registry(spark: SparkSession, enabled: tuple[str, ...] = REGISTRY) -> DataFrame:
    """Enabled formats in registry order; each can be read and written."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(enabled)], "registry_no int, id string")


def effective_target(wanted: Column, writable: tuple[str, ...] = REGISTRY) -> Column:
    """The wanted format if it can be written, else the first that can, else the wanted one."""
    return F.when(wanted.isin(*writable), wanted).otherwise(F.lit(writable[0])) if writable else wanted


def yes_no(c: Column) -> Column:
    return F.when(c, "是").otherwise("否")


def capability_matrix(spark: SparkSession) -> DataFrame:
    """All formats by six columns, in enum order."""
    return format_dim(spark).select("enum_no", "name", "primary_extension", F.when(F.col("implemented"), "已实现").otherwise("规划中").alias("status"), yes_no(F.col("lossless")).alias("lossless"), yes_no(F.col("alpha")).alias("alpha"), "description")


def picker_extensions(spark: SparkSession, enabled: tuple[str, ...] = REGISTRY) -> DataFrame:
    """One sorted list without repeats of the extensions that the file picker offers."""
    listed = [list(BY_ID[x].extensions) for x in enabled]
    return spark.createDataFrame([(listed,)], "x array<array<string>>").select(F.array_sort(F.array_distinct(F.flatten("x"))).alias("extensions"))
