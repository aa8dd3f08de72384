"""Options of conversions and compressions, presets and the program's configuration.

These are plain records on the driver: they parametrise plans and are never data of one.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from .formats import BY_ID, COLORS, FORMATS, REGISTRY
from .scalars import MAX_DIMENSION, MAX_PIXELS, VIEWS

#: Names shown for the choices.
RESIZE_MODES = {"Nearest": "最近邻", "Bilinear": "双线性"}
ROTATIONS = {"None": "不旋转", "Deg90": "顺时针 90°", "Deg180": "顺时针 180°", "Deg270": "顺时针 270°"}
NAMING_RULES = {"KeepOriginal": "沿用原文件名", "AppendSuffix": "追加 _converted 后缀", "Timestamp": "追加时间戳"}
PRESETS = {
    "FastLossless": ("极速无损", "零画质损失，最快速度优先，优化无损编码"),
    "Balanced": ("智能均衡", "推荐！画质与体积的最佳平衡，肉眼几乎无法分辨"),
    "MaxSaving": ("极限压缩", "体积大幅缩小 70%~90%，适合对大小要求严苛的场景"),
    "Custom": ("自定义", "完全自由配置质量、格式、尺寸与压缩算法"),
}
STRATEGIES = {"KeepOriginal": "保持原格式", "Webp": "转为 WebP (体积最小)", "Jpeg": "转为 JPEG (兼容性好)"}
DOWNSCALES = {
    "Original": "保持原图尺寸",
    "Max1920": "限制最长边 1920px (全高清)",
    "Max2560": "限制最长边 2560px (2K)",
    "Scale75": "缩小至 75%",
    "Scale50": "缩小至 50% (减半)",
    "CustomMax": "自定义最长边",
}
#: What a preset sets, as (quality, PNG level, fast PNG, downscale).
PRESET_VALUES = {"FastLossless": (100, 1, True, "Original"), "Balanced": (82, 3, True, "Max2560"), "MaxSaving": (65, 7, False, "Max1920"), "Custom": (80, 3, True, "Original")}
COLOR_NAMES = {c[0]: c[2] for c in COLORS}


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


@dataclass(frozen=True)
class EncodeOptions:
    quality: int = 90
    png_compression_level: int = 1
    png_fast_mode: bool = True

    @property
    def clamped_quality(self) -> int:
        return clamp(self.quality, 1, 100)


@dataclass(frozen=True)
class TransformOptions:
    resize: tuple[int, int] | None = None
    resize_mode: str = "Bilinear"
    grayscale: bool = False
    flip_horizontal: bool = False
    flip_vertical: bool = False
    rotate: str = "None"
    color: str | None = None

    @property
    def is_identity(self) -> bool:
        """Nothing to do; the way to resize alone does nothing."""
        return self.resize is None and not (self.grayscale or self.flip_horizontal or self.flip_vertical) and self.rotate == "None" and self.color is None

    def summary(self) -> str:
        parts = [
            self.resize and f"缩放至 {self.resize[0]}×{self.resize[1]}({RESIZE_MODES[self.resize_mode]})",
            self.grayscale and "灰度",
            self.flip_horizontal and "水平镜像",
            self.flip_vertical and "垂直镜像",
            self.rotate != "None" and ROTATIONS[self.rotate],
            self.color and f"颜色模式 {COLOR_NAMES[self.color]}",
        ]
        return "无变换" if self.is_identity else "、".join(p for p in parts if p)


@dataclass(frozen=True)
class ConvertOptions:
    target: str
    output_dir: str = ""
    naming: str = "KeepOriginal"
    overwrite: bool = False
    transform: TransformOptions = TransformOptions()
    encode: EncodeOptions = EncodeOptions()


@dataclass(frozen=True)
class Downscale:
    """A limit by name; ``max_side`` belongs to CustomMax alone."""

    kind: str = "Original"
    max_side: int = 1

    def target_size(self, width: int, height: int) -> tuple[int, int]:
        """As ``scalars.target_size``, for one image."""
        if not width or not height:
            return width, height
        share = {"Scale75": 0.75, "Scale50": 0.5}.get(self.kind)
        limit = {"Max1920": 1920, "Max2560": 2560, "CustomMax": max(1, self.max_side)}.get(self.kind)
        if share is None and limit is not None and max(width, height) > limit:
            share = limit / max(width, height)
        if share is None:
            return width, height
        return tuple(max(1, int(x * share) + (x * share - int(x * share) >= 0.5)) for x in (width, height))


@dataclass(frozen=True)
class CompressOptions:
    preset: str = "Balanced"
    format_strategy: str = "KeepOriginal"
    quality: int = 82
    png_level: int = 3
    png_fast_mode: bool = True
    downscale: Downscale = Downscale("Max2560")
    output_dir: str = ""
    naming: str = "AppendSuffix"
    overwrite: bool = False

    @classmethod
    def from_preset(cls, preset: str) -> CompressOptions:
        quality, level, fast, limit = PRESET_VALUES[preset]
        return cls(preset, quality=quality, png_level=level, png_fast_mode=fast, downscale=Downscale(limit))

    def apply_preset(self, preset: str) -> CompressOptions:
        """Custom changes the name alone; the others what the picture looks like, not where it goes."""
        if preset == "Custom":
            return replace(self, preset=preset)
        new = self.from_preset(preset)
        return replace(self, preset=preset, quality=new.quality, png_level=new.png_level, png_fast_mode=new.png_fast_mode, downscale=new.downscale)

    @property
    def encode(self) -> EncodeOptions:
        return EncodeOptions(self.quality, self.png_level, self.png_fast_mode)


def default_workers(cpus: int | None = None) -> int:
    """Logical processors, 1 to 8; 4 where unknown."""
    return clamp(cpus if cpus is not None else os.cpu_count() or 4, 1, 8)


@dataclass(frozen=True)
class Config:
    target_format: str = "qoi"
    output_dir: str | None = None
    naming: str = "KeepOriginal"
    overwrite: bool = False
    transform: TransformOptions = TransformOptions()
    encode: EncodeOptions = EncodeOptions()
    compress: CompressOptions = CompressOptions()
    max_workers: int = field(default_factory=default_workers)
    theme: str = "System"
    last_input_dir: str | None = None
    keep_history: bool = True

    def normalised(self) -> Config:
        """All numbers in their ranges; a size with a zero side is none."""
        size = self.transform.resize
        size = None if size is None or 0 in size else (min(size[0], MAX_DIMENSION), min(size[1], MAX_DIMENSION))
        return replace(
            self,
            max_workers=clamp(self.max_workers, 1, 64),
            encode=replace(self.encode, quality=clamp(self.encode.quality, 1, 100), png_compression_level=min(self.encode.png_compression_level, 9)),
            compress=replace(self.compress, quality=clamp(self.compress.quality, 1, 100), png_level=min(self.compress.png_level, 9)),
            transform=replace(self.transform, resize=size),
        )

    def convert_options(self) -> ConvertOptions:
        return ConvertOptions(self.target_format, self.output_dir or "", self.naming, self.overwrite, self.transform, self.encode)

    def adopt(self, o: ConvertOptions) -> Config:
        return replace(self, target_format=o.target, output_dir=o.output_dir or None, naming=o.naming, overwrite=o.overwrite, transform=o.transform, encode=o.encode)

    def to_json(self) -> str:
        """Pretty JSON; enums by variant name, the custom limit as an object."""
        d = asdict(self)
        d["target_format"] = BY_ID[self.target_format].variant
        d["compress"]["downscale"] = {"CustomMax": self.compress.downscale.max_side} if self.compress.downscale.kind == "CustomMax" else self.compress.downscale.kind
        return json.dumps(d, ensure_ascii=False, indent=2)

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Raises on anything missing or unknown, but for what may be left out: PNG options and compress."""
        d = json.loads(text)
        encode = EncodeOptions(**_checked(d["encode"], {"quality"}, {"png_compression_level", "png_fast_mode"}))
        transform = _checked(d["transform"], set(TransformOptions.__dataclass_fields__), set())
        transform["resize"] = tuple(transform["resize"]) if transform["resize"] else None
        compress = CompressOptions()
        if "compress" in d:
            c = _checked(d["compress"], set(CompressOptions.__dataclass_fields__), set())
            limit = c["downscale"]
            c["downscale"] = Downscale("CustomMax", limit["CustomMax"]) if isinstance(limit, dict) else Downscale(limit)
            if c["downscale"].kind not in DOWNSCALES or c["preset"] not in PRESETS or c["format_strategy"] not in STRATEGIES:
                raise ValueError("unknown choice")
            compress = CompressOptions(**c)
        known = {f.variant: f.id for f in FORMATS}
        plain = {k: d[k] for k in ("output_dir", "naming", "overwrite", "max_workers", "theme", "last_input_dir", "keep_history")}
        if plain["naming"] not in NAMING_RULES:
            raise ValueError("unknown naming rule")
        return cls(target_format=known[d["target_format"]], transform=TransformOptions(**transform), encode=encode, compress=compress, **plain).normalised()

    @classmethod
    def load(cls, path: str) -> Config:
        """The configuration in a file; the default one where it can't be read."""
        try:
            return cls.from_json(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return cls()


def _checked(d: dict[str, Any], needed: set[str], optional: set[str]) -> dict[str, Any]:
    if not needed <= set(d):
        raise KeyError(str(needed - set(d)))
    return {k: v for k, v in d.items() if k in needed | optional}


@dataclass(frozen=True)
class Startup:
    files: tuple[str, ...] = ()
    view: str | None = None
    auto_start: bool = False

    @property
    def route(self) -> tuple[str, int] | None:
        """(kind, workers) of what starts by itself: one file alone, or a batch."""
        if not self.auto_start or not self.files:
            return None
        return ("single", 1) if len(self.files) == 1 else ("batch", default_workers())


def parse_arguments(arguments: list[str], exists=os.path.isfile) -> Startup:
    """Files that exist, the wanted view and whether to start; other options are ignored."""
    files, view, auto, rest = [], None, False, iter(arguments)
    for a in rest:
        if a == "--view":
            view = view_key(next(rest, ""))
        elif a.startswith("--view="):
            view = view_key(a.removeprefix("--view="))
        elif a == "--auto-start":
            auto = True
        elif not a.startswith("--") and exists(a):
            files.append(a)
    return Startup(tuple(files), view, auto)


def view_key(text: str) -> str | None:
    text = text.strip()
    return next((k for k, title in VIEWS if text.lower() == k or text == title), None)


def check_resize(width: int, height: int) -> bool:
    return width * height <= MAX_PIXELS


__all__ = ["REGISTRY", "CompressOptions", "Config", "ConvertOptions", "Downscale", "EncodeOptions", "Startup", "TransformOptions", "check_resize", "default_workers", "parse_arguments", "view_key"]
