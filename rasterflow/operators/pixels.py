"""Operators on pixel tables (asset_id, y, x, c0, c1, ...), one row for each pixel.

They are geometry and arithmetic on columns alone, fit for small rasters and for holding the
buffer operators against SQL. Large images go through ``raster``, as buffers.
Sizes are columns w and h of each row's image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import target_size
from .raster import LUMA

C = F.col
#: Pixels of a part of images that are dealt out together: some 100 MB of sums while they are resized.
PART = 1 << 19


def by_image(images: DataFrame, pixels: Column) -> DataFrame:
    """``images`` (asset_id, ...), a row each, dealt out by asset_id to parts of about ``PART`` pixels; ``pixels`` counts those of a row.

    What explodes them to pixels then has tasks that grow in number with the pixels, not with the bytes of a small table, and each
    image's pixels in one of them: groups by asset_id and more need no further exchange.
    """
    n = images.agg(F.sum(pixels.cast("double"))).first()[0] or 0
    return images.repartition(int(n // PART) + 1, "asset_id")


def rotate(px: DataFrame, angle: str) -> DataFrame:
    """Clockwise by Deg90, Deg180 or Deg270; w and h change places for a quarter."""
    x, y, w, h = C("x"), C("y"), C("w"), C("h")
    new = {"None": (x, y, w, h), "Deg90": (h - 1 - y, x, h, w), "Deg180": (w - 1 - x, h - 1 - y, w, h), "Deg270": (y, w - 1 - x, h, w)}[angle]
    return px.withColumns(dict(zip(("x", "y", "w", "h"), new, strict=True)))


def placed(px: DataFrame, angle: str = "None", horizontal: bool = False, vertical: bool = False, width: int | None = None, height: int | None = None) -> DataFrame:
    """Rotation, both flips and nearest resizing in one projection, in the fixed order of a transform.

    The first three are one map of whole numbers, x' = a x + b y + c, y' = d x + e y + f, whose offsets are sides less one. With a
    size, each source place is copied to the run of target places that read it; no size or a zero side keeps the image's.
    """
    # rows of (x, y, width - 1, height - 1) that make up x and y; a flip subtracts from the side that holds then
    x, y, sides = {"None": ((1, 0, 0, 0), (0, 1, 0, 0), "wh"), "Deg90": ((0, -1, 0, 1), (1, 0, 0, 0), "hw"), "Deg180": ((-1, 0, 1, 0), (0, -1, 0, 1), "wh"), "Deg270": ((0, 1, 0, 0), (-1, 0, 1, 0), "hw")}[angle]
    flipped = lambda row, side: tuple((side == s) - v for v, s in zip(row, ("x", "y", "w", "h"), strict=True))
    x = flipped(x, sides[0]) if horizontal else x
    y = flipped(y, sides[1]) if vertical else y
    terms = (C("x"), C("y"), C("w") - 1, C("h") - 1)
    moved = lambda row: sum((t if v > 0 else -t for v, t in zip(row, terms, strict=True) if v), F.lit(0))
    new = {"x": moved(x), "y": moved(y), "w": C(sides[0]), "h": C(sides[1])}
    if not width or not height:
        return px.withColumns(new)
    # target places t of a source place s have s * to <= (t + 1/2) * side < (s + 1) * to
    first = lambda at, side, to: F.ceil((at * (2 * to) - side) / (side * 2))
    run = lambda at, side, to: F.sequence(F.greatest(first(at, side, to), F.lit(0)), F.least(first(at + 1, side, to), F.lit(to)))
    across, down = run(new["x"], new["w"], width), run(new["y"], new["h"], height)
    out = px.withColumn("_y", F.explode(F.slice(down, 1, F.size(down) - 1))).withColumn("_x", F.explode(F.slice(across, 1, F.size(across) - 1)))
    return out.withColumns({"x": C("_x").cast("int"), "y": C("_y").cast("int"), "w": F.lit(width), "h": F.lit(height)}).drop("_x", "_y")


def flip_horizontal(px: DataFrame) -> DataFrame:
    return px.withColumn("x", C("w") - 1 - C("x"))


def flip_vertical(px: DataFrame) -> DataFrame:
    return px.withColumn("y", C("h") - 1 - C("y"))


def nearest_source(at: Column, size: Column, to: Column) -> Column:
    """floor((at + 0.5) * size / to), in whole numbers."""
    return F.floor((at * 2 + 1) * size / (to * 2)).cast("int")


def resize_nearest(px: DataFrame, width: int, height: int) -> DataFrame:
    """Each source pixel is copied to the target places that read it; nothing is joined.

    The target places of a source place are a run, so it is exploded from its bounds.
    """
    def run(at: str, size: str, to: int) -> Column:
        places = F.sequence(F.lit(0), F.lit(to - 1))
        return F.filter(places, lambda t: F.floor((t * 2 + 1) * C(size) / (2 * to)) == C(at))

    out = px.withColumn("_y", F.explode(run("y", "h", height))).withColumn("_x", F.explode(run("x", "w", width)))
    return out.withColumns({"x": C("_x"), "y": C("_y"), "w": F.lit(width), "h": F.lit(height)}).drop("_x", "_y")


def _span(at: Column, size: Column, to: Column) -> Column:
    """Target places that a triangle kernel lets a source place reach: those with a weight above zero."""
    wide = F.greatest(size, to) * 2
    first = F.floor(((at * 2 + 1) * to - wide) / (size * 2) - 0.5) + 1
    last = F.ceil(((at * 2 + 1) * to + wide) / (size * 2) - 0.5) - 1
    return F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, to - 1).cast("int"))


def _weight(at: Column, size: Column, place: Column, to: Column) -> Column:
    """Weight of a source place in a target place, in whole numbers; the kernel widens when shrinking."""
    return F.greatest(size, to) * 2 - F.abs((at * 2 + 1) * to - (place * 2 + 1) * size)


def resize_bilinear(px: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Smooth resizing as two grouped sums of whole numbers, upright and then sideways; no Python, no size limit but that of 64 bits.

    ``width`` and ``height`` may be columns, as each image has a target of its own; null or zero keeps the image's side. A weight of
    the triangle kernel is a whole number of 1 / (2 * the larger side), so the value is an exact fraction, rounded half up at the end. With
    sides up to 16384, sums stay within 64 bits. A source pixel is copied to the few targets that it reaches and
    summed before the shuffle, or without one where images are dealt out ``by_image``. Channels c0 to c3 are resized, as far as they are there; other columns but asset_id, w and h go.
    """
    own = lambda to, side: F.coalesce(F.nullif((to if isinstance(to, Column) else F.lit(to)).cast("long"), F.lit(0).cast("long")), C(side).cast("long"))
    channels = [c for c in ("c0", "c1", "c2", "c3") if c in px.columns]
    out = px.select("asset_id", C("w").cast("long").alias("w"), C("h").cast("long").alias("h"), own(width, "w").alias("tw"), own(height, "h").alias("th"), C("x").cast("long").alias("x"), C("y").cast("long").alias("y"), *channels)
    size = ["asset_id", "w", "h", "tw", "th"]
    v = _weight(C("y"), C("h"), C("ty"), C("th"))
    out = out.withColumn("ty", F.explode(_span(C("y"), C("h"), C("th")))).withColumn("v", v)
    out = out.groupBy(*size, "ty", "x").agg(F.sum("v").alias("v"), *[F.sum(C("v") * C(c)).alias(c) for c in channels])
    u = _weight(C("x"), C("w"), C("tx"), C("tw"))
    out = out.withColumn("tx", F.explode(_span(C("x"), C("w"), C("tw")))).withColumn("u", u)
    # v is the same for all of a target's row
    out = out.groupBy(*size, "ty", "tx").agg((F.sum("u") * F.max("v")).alias("all"), *[F.sum(C("u") * C(c)).alias(c) for c in channels])
    return out.select("asset_id", C("tw").cast("int").alias("w"), C("th").cast("int").alias("h"), C("ty").alias("y"), C("tx").alias("x"), *[F.expr(f"(2 * {c} + all) div (2 * all)").cast("int").alias(c) for c in channels])


def downscale(px: DataFrame, kind: Column, value: Column) -> DataFrame:
    """Each image by a limit of its own, always smooth; sizes as ``scalars.target_size``."""
    to = target_size(kind, value, C("w").cast("long"), C("h").cast("long"))
    return resize_bilinear(px.withColumn("_to", to), C("_to")["width"], C("_to")["height"])


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * LUMA[0] + g * LUMA[1] + b * LUMA[2]) / 10000).cast("int")


def grayscale(px: DataFrame, alpha: bool = False) -> DataFrame:
    """c0 becomes gray; with ``alpha`` c1 is what c3 was."""
    keep = [c for c in px.columns if c not in ("c0", "c1", "c2", "c3")]
    return px.select(*keep, gray(C("c0"), C("c1"), C("c2")).alias("c0"), *([C("c3").alias("c1")] if alpha else []))


def to_color(px: DataFrame, have: str, want: str) -> DataFrame:
    """From one channel layout to another: alpha is added as 255 or dropped, gray spread or computed."""
    keep = [c for c in px.columns if c not in ("c0", "c1", "c2", "c3")]
    n = {"Gray8": 1, "GrayAlpha8": 2, "Rgb8": 3, "Rgba8": 4}
    alpha = C("c1") if have == "GrayAlpha8" else C("c3") if have == "Rgba8" else F.lit(255)
    wide = n[have] >= 3
    if n[want] <= 2:
        base = [gray(C("c0"), C("c1"), C("c2")) if wide else C("c0")]
    else:
        base = [C("c0"), C("c1"), C("c2")] if wide else [C("c0")] * 3
    channels = base + ([alpha] if n[want] in (2, 4) else [])
    return px.select(*keep, *[c.cast("int").alias(f"c{i}") for i, c in enumerate(channels)])


def semi_transparent(px: DataFrame, alpha: str) -> DataFrame:
    """(asset_id, semi_transparent): whether any alpha is neither 0 nor 255."""
    return px.groupBy("asset_id").agg(F.bool_or((C(alpha) != 0) & (C(alpha) != 255)).alias("semi_transparent"))


def unpremultiply(px: DataFrame) -> DataFrame:
    a = C("c3")
    straight = lambda c: F.when(a == 0, 0).otherwise(F.floor((C(c) * 255 + F.floor(a / 2)) / a)).cast("int")
    return px.withColumns({c: straight(c) for c in ("c0", "c1", "c2")})


def demote(sample: Column) -> Column:
    """A 16-bit sample as 8 bits, rounded."""
    return F.floor((sample + 128) / 257).cast("int")


def mean_error(a: DataFrame, b: DataFrame, channels: tuple[str, ...] = ("c0",)) -> DataFrame:
    """(asset_id, mean_error) of two tables with the same places; pixels are co-located by asset."""
    keys = ["asset_id", "y", "x"]
    other = b.select(*keys, *[C(c).alias(f"_{c}") for c in channels])
    total = sum((F.abs(C(c) - C(f"_{c}")) for c in channels), F.lit(0))
    return a.join(other, keys).groupBy("asset_id").agg((F.sum(total) / F.lit(len(channels)) / F.count("*")).alias("mean_error"))


def gradient(sizes: DataFrame) -> DataFrame:
    """Pixels of the test image for each (asset_id, w, h)."""
    px = by_image(sizes, C("w").cast("double") * C("h")).withColumn("y", F.explode(F.sequence(F.lit(0), C("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), C("w") - 1)))
    part = lambda v, size: F.floor(v * 255 / F.greatest(size, F.lit(1))).cast("int")
    return px.withColumns({"c0": part(C("x"), C("w")), "c1": part(C("y"), C("h")), "c2": part(C("x") + C("y"), C("w") + C("h"))})
