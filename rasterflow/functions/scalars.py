"""Scalar functions of paths, sizes, outcomes and history rows, as column expressions.

Numbers are shown the way exact binary values round: half to even on the value that is
stored, not on the shortest decimal that names it.

Fixed values: the sentences of notes, summaries, badges and checks in the functions below must read as they do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import attribute

#: Units of sizes, and what stands for nothing.
UNITS = ("B", "KB", "MB", "GB", "TB")
NOTHING = "—"
UNNAMED = "未命名"
ICO_MAX, GIF_MAX, MAX_PIXELS, MAX_DIMENSION, PREVIEW_SIDE = 256, 65535, 1 << 30, 20000, 420
#: Error texts by kind; {} is the detail.
ERRORS = {
    "UnknownFormat": "无法识别的文件格式",
    "UnsupportedFormat": "不支持的格式:{}",
    "Corrupt": "数据损坏:{}",
    "UnsupportedFeature": "暂不支持的特性:{}",
    "InvalidPath": "路径无效:{}",
    "Io": "文件读写失败:{}",
    "Config": "配置错误:{}",
    "Serialize": "数据序列化失败:{}",
}


def fixed(value: Column, digits: int) -> Column:
    """A double with so many digits, from the exact binary value, ties to even; the sign only if negative.

    Values of 2^53 and more are whole and shown as such.
    """
    v = value.cast("double")
    shown = F.translate(F.format_number(F.when(v == 0, 0.0).otherwise(v), digits), ",", "")
    whole = F.concat(v.cast("long").cast("string"), F.lit("." + "0" * digits if digits else ""))
    return F.when(F.abs(v) < float(1 << 53), shown).otherwise(whole)


def human_size(size: Column) -> Column:
    """Bytes in the largest unit that keeps the value at 1 or more, up to TB."""
    b = size.cast("long")
    out = F.concat(b.cast("string"), F.lit(" B"))
    for power in range(1, len(UNITS)):
        out = F.when(b >= 1024**power, F.concat(fixed(b.cast("double") / float(1024**power), 2), F.lit(f" {UNITS[power]}"))).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    """The last part of a path; of a path that ends in ``..`` or is a root, the whole path."""
    clean = F.regexp_replace(path, r"(?<=.)/+(\./*)*$", "")
    last = F.element_at(F.split(clean, "/"), -1)
    return F.when(last.isin("", "..", "."), path).otherwise(last)


def _named(path: Column) -> Column:
    last = file_name(path)
    return F.when((last == path) & (F.instr(path, "/") > 0) | last.isin("", ".", ".."), F.lit(None)).otherwise(last)


def extension_of(path: Column) -> Column:
    """The ASCII lower-case extension without its dot; none for dot files."""
    from .formats import ascii_lower

    return F.coalesce(ascii_lower(F.regexp_extract(_named(path), r"^(?s).+\.([^.]*)$", 1)), F.lit(""))


def file_stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.coalesce(F.regexp_replace(_named(path), r"(?s)^(.+)\.[^.]*$", "$1"), F.lit(UNNAMED))


def parent(path: Column) -> Column:
    """The folder of a path; empty for a bare name, null for a root or nothing."""
    clean = F.regexp_replace(path, r"(?<=.)/+$", "")
    cut = F.length(clean) - F.length(F.substring_index(clean, "/", -1))
    return F.when(clean.isin("", "/"), F.lit(None)).when(cut == 0, "").when(cut == 1, "/").otherwise(F.regexp_replace(F.substring(clean, F.lit(1), cut - 1), r"(?<=.)/+$", ""))


def output_dir(chosen: Column, path: Column) -> Column:
    """The chosen folder, else that of the input, else the current one."""
    return F.when(F.coalesce(chosen, F.lit("")) != "", chosen).otherwise(F.coalesce(parent(path), F.lit(".")))


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).when(folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def output_path(path: Column, folder: Column, ext: Column, naming: Column, stamp: Column) -> Column:
    """The path that a naming rule gives before collisions are looked at."""
    middle = F.when(naming == "AppendSuffix", "_converted").when(naming == "Timestamp", F.concat(F.lit("_"), F.date_format(stamp, "yyyyMMdd_HHmmss"))).otherwise("")
    return join_path(folder, F.concat(file_stem(path), middle, F.lit("."), ext))


def size_change_percent(source: Column, output: Column) -> Column:
    """(output - source) / source * 100, 0 for an empty source."""
    s, o = source.cast("double"), output.cast("double")
    return F.when(source == 0, 0.0).otherwise((o - s) / s * 100.0)


def outcome_summary(source: Column, target: Column, width: Column, height: Column, source_bytes: Column, output_bytes: Column, millis: Column) -> Column:
    t = lambda c: c.cast("string")
    return F.concat(attribute(source, "name"), F.lit(" → "), attribute(target, "name"), F.lit(" · "), t(width), F.lit("×"), t(height), F.lit(" · "), human_size(source_bytes), F.lit(" → "), human_size(output_bytes), F.lit(" · 用时 "), t(millis), F.lit(" ms"))


def collect_notes(source: Column, target: Column, semi_transparent: Column, source_bytes: Column, output_bytes: Column) -> Column:
    """What a user should know of a conversion: up to four notes, in order."""
    growth = (output_bytes - source_bytes).cast("double") / source_bytes.cast("double") * 100.0
    notes = F.array(
        F.when(source == target, "源格式与目标格式相同,文件已被重新编码"),
        F.when(~attribute(target, "alpha") & semi_transparent, F.concat(attribute(target, "name"), F.lit(" 不支持透明度,半透明像素已按不透明处理"))),
        F.when((target == "gif") & semi_transparent, "GIF 仅支持二值透明度，半透明像素已被处理为完全透明或不透明"),
        F.when((source_bytes > 0) & (output_bytes > source_bytes) & (growth >= 1.0), F.concat(F.lit("输出体积比原文件大约 "), fixed(growth, 0), F.lit("%"))),
    )
    return F.filter(notes, lambda n: n.isNotNull())


def saved_note(source_bytes: Column, output_bytes: Column) -> Column:
    """What a compression saved; null where it saved nothing."""
    saved = source_bytes - output_bytes
    share = saved.cast("double") / source_bytes.cast("double") * 100.0
    return F.when(output_bytes < source_bytes, F.concat(F.lit("压缩已节省 "), human_size(saved), F.lit("("), fixed(share, 1), F.lit("%) 空间")))


def time_text(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def format_text(source: Column, target: Column) -> Column:
    return F.concat(F.coalesce(F.upper(source), F.lit("?")), F.lit(" → "), F.upper(target))


def size_text(width: Column, height: Column) -> Column:
    return F.when((width == 0) | (height == 0), NOTHING).otherwise(F.concat(width.cast("string"), F.lit("×"), height.cast("string")))


def volume_text(success: Column, source_bytes: Column, output_bytes: Column) -> Column:
    return F.when(~success, NOTHING).otherwise(F.concat(human_size(source_bytes), F.lit(" → "), human_size(output_bytes)))


def elapsed_text(millis: Column) -> Column:
    return F.when(millis >= 1000, F.concat(fixed(millis.cast("double") / 1000.0, 2), F.lit(" s"))).otherwise(F.concat(millis.cast("string"), F.lit(" ms")))


def status_text(success: Column) -> Column:
    return F.when(success, "成功").otherwise("失败")


def batch_text(succeeded: Column, failed: Column, seconds: Column, cancelled: Column) -> Column:
    """The result of a batch in a line."""
    return F.concat(F.lit("成功 "), succeeded.cast("string"), F.lit(" 个,失败 "), failed.cast("string"), F.lit(" 个,用时 "), fixed(seconds, 2), F.lit(" 秒"), F.when(cancelled, "(已取消)").otherwise(""))


def badge(percent: Column) -> tuple[Column, Column]:
    """(text, class) of a compression badge: success, accent, muted or warning."""
    text = F.when(percent == 0.0, "0.0%").otherwise(F.concat(signed(percent, 1), F.lit("%")))
    return text, F.when(percent <= -20.0, "success").when(percent < 0.0, "accent").when(percent == 0.0, "muted").otherwise("warning")


def signed(value: Column, digits: int) -> Column:
    """A sign always; small negatives that round to nothing keep theirs."""
    size = fixed(F.abs(value), digits)
    return F.concat(F.when(value < 0, "-").otherwise("+"), size)


def progress(processed: Column, total: Column) -> Column:
    """Share of a batch that is done, in single precision: 1 for an empty batch."""
    share = (processed.cast("float") / total.cast("float")).cast("float")
    return F.when(total == 0, F.lit(1.0).cast("float")).otherwise(F.least(F.greatest(share, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")))


def shown_progress(processed: Column, total: Column) -> Column:
    """As ``progress``, but 0 for an empty batch, as the progress bar shows it."""
    return F.when(total == 0, F.lit(0.0).cast("float")).otherwise((processed.cast("float") / total.cast("float")).cast("float"))


def error_text(kind: Column, detail: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, text in ERRORS.items():
        head = text.replace("{}", "")
        out = F.when(kind == k, F.concat(F.lit(head), F.coalesce(detail, F.lit(""))) if "{}" in text else F.lit(head)).otherwise(out)
    return out


def preflight(target: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(error kind, detail) of an image that a target can't hold; both null where it can."""
    too = lambda limit: (width > limit) | (height > limit)
    size = F.concat(width.cast("string"), F.lit("×"), height.cast("string"))
    done = attribute(target, "implemented")
    bad = ~done | (target == "ico") & too(ICO_MAX) | (target == "gif") & too(GIF_MAX)
    detail = (
        F.when(~done, F.concat(attribute(target, "name"), F.lit("的编解码功能尚未实现,请选择其它目标格式")))
        .when((target == "ico") & too(ICO_MAX), F.concat(F.lit(f"ICO 图标最大支持 {ICO_MAX}×{ICO_MAX},当前图像为 "), size, F.lit(",请先设置缩放")))
        .when((target == "gif") & too(GIF_MAX), F.concat(F.lit(f"GIF 图像最大支持 {GIF_MAX}×{GIF_MAX},当前图像为 "), size, F.lit(",请先设置缩放")))
    )
    return F.when(bad, "UnsupportedFeature"), detail


def half_away(value: Column) -> Column:
    """Rounds a double that isn't negative to a whole number, halves up, on the stored value."""
    whole = F.floor(value)
    return (whole + F.when(value - whole >= 0.5, 1).otherwise(0)).cast("long")


def target_size(kind: Column, custom: Column, width: Column, height: Column) -> Column:
    """struct(width, height) under a downscale limit; the ratio is formed before it is applied."""
    limit = F.when(kind == "Max1920", F.lit(1920)).when(kind == "Max2560", F.lit(2560)).when(kind == "CustomMax", F.greatest(custom, F.lit(1)))
    longest = F.greatest(width, height)
    ratio = limit.cast("double") / longest.cast("double")
    scale = F.when(kind == "Scale75", F.lit(0.75)).when(kind == "Scale50", F.lit(0.5)).when(longest > limit, ratio)
    side = lambda c: F.when((width == 0) | (height == 0) | scale.isNull(), c).otherwise(F.greatest(half_away(c.cast("double") * scale), F.lit(1).cast("long"))).cast("long")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def preview_size(width: Column, height: Column) -> Column:
    """struct(width, height) with the longest side at most that of the preview."""
    return target_size(F.lit("CustomMax"), F.lit(PREVIEW_SIDE), width, height)


def resize_guard(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """resize, keep or too_large for a wanted size."""
    keep = to_width.isNull() | to_height.isNull() | (to_width == 0) | (to_height == 0) | (to_width == width) & (to_height == height)
    return F.when(keep, "keep").when(to_width * to_height > MAX_PIXELS, "too_large").otherwise("resize")


def compress_target(strategy: Column, source: Column, enabled: tuple[str, ...]) -> Column:
    """The format a compression writes; what can't be kept becomes PNG."""
    kept = F.when(source.isin(*enabled) & attribute(source, "implemented") & (source != "svg"), source).otherwise("png")
    return F.when(strategy == "Webp", "webp").when(strategy == "Jpeg", "jpeg").otherwise(kept)


def log_level(text: Column) -> Column:
    from .formats import ascii_lower

    level = ascii_lower(text)
    return F.when(level.isin("off", "error", "warn", "info", "debug", "trace"), level).otherwise("warn")


#: Views of the program as (key, title).
VIEWS = (("convert", "转换"), ("batch", "批量"), ("compress", "压缩"), ("history", "历史"), ("settings", "设置"))


def view_of(text: Column) -> Column:
    """The key of a view from its key in any ASCII case or its exact title; null if unknown."""
    from .formats import ascii_lower, lookup, trim

    clean = trim(text)
    return F.coalesce(lookup(ascii_lower(clean), {k: k for k, _ in VIEWS}), lookup(clean, {t: k for k, t in VIEWS}))
