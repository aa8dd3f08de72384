"""Sniffing, decoding and encoding of image bytes, by format id.

Images are numpy arrays of height x width x channels, 8 bits each. Nothing here knows of
Spark; the operators call it once for each row of an Arrow batch.

Fixed values: the error messages, the container that SVG is written as, and the order in which a file is tried
(by extension, by first bytes, by every format) must be as they are.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib

import numpy as np

from ...functions.formats import BY_ID, FORMATS, REGISTRY
from ...functions.options import EncodeOptions
from ...operators.raster import to_color
from . import gif, jpeg, png, simple, svg, webp
from .errors import CodecError, Corrupt, UnknownFormat, Unsupported, UnsupportedFormat

#: First bytes by format, in the order in which they are tried; offset and bytes.
MAGIC = (
    ("png", ((0, b"\x89PNG\r\n\x1a\n"),)),
    ("jpeg", ((0, b"\xff\xd8\xff"),)),
    ("gif", ((0, b"GIF89a"),)),
    ("gif", ((0, b"GIF87a"),)),
    ("webp", ((0, b"RIFF"), (8, b"WEBP"))),
    ("bmp", ((0, b"BM"),)),
    ("ico", ((0, b"\x00\x00\x01\x00"),)),
    ("netpbm", ((0, b"P1"),)),
    ("netpbm", ((0, b"P2"),)),
    ("netpbm", ((0, b"P3"),)),
    ("netpbm", ((0, b"P4"),)),
    ("netpbm", ((0, b"P5"),)),
    ("netpbm", ((0, b"P6"),)),
    ("netpbm", ((0, b"P7"),)),
    ("farbfeld", ((0, b"farbfeld"),)),
    ("qoi", ((0, b"qoif"),)),
)
_SVG_IMAGE = re.compile(rb"<image\b[^>]*?href\s*=\s*[\"']data:image/(png|jpe?g|gif|webp);base64,([A-Za-z0-9+/=\s]+)[\"']")


def is_svg(b: bytes) -> bool:
    """By the first 512 unpacked or 1024 plain bytes, which must be whole UTF-8."""
    if b[:2] == b"\x1f\x8b":
        try:
            head = zlib.decompressobj(31).decompress(b, 512)
            if "<svg" in head.decode():
                return True
        except (zlib.error, UnicodeDecodeError):
            pass
    try:
        text = b[:1024].decode()
    except UnicodeDecodeError:
        return False
    start = text.lstrip()
    return start.startswith("<svg") or start.startswith("<?xml") and "<svg" in text


def detect(b: bytes, enabled: tuple[str, ...] | None = None) -> str | None:
    """The format that the bytes begin like; TGA has no mark and is never found here."""
    found = "svg" if is_svg(b) else next((f for f, marks in MAGIC if all(b[at : at + len(m)] == m for at, m in marks)), None)
    return found if enabled is None or found in enabled else None


def _ico(b: bytes) -> np.ndarray:
    """The largest image, then the one with the most bits."""
    if len(b) < 6 or b[:4] != b"\0\0\1\0":
        raise Corrupt("ICO header")
    n = struct.unpack_from("<H", b, 4)[0]
    if not n or len(b) < 6 + 16 * n:
        raise Corrupt("ICO directory")
    entries = [struct.unpack_from("<BBBBHHII", b, 6 + 16 * i) for i in range(n)]
    _, _, _, _, _, _, size, at = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    body = b[at : at + size]
    if len(body) < size or not size:
        raise Corrupt("ICO data")
    if body.startswith(png.MAGIC):
        return to_color(png.decode(body), "Rgba8")
    return simple.decode_bmp(body, 0, icon=True)


def _encode_ico(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    body = png.encode(to_color(image, "Rgba8"), 6, False)
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", width & 255, height & 255, 0, 0, 0, 32, len(body), 22) + body


def _svg(b: bytes) -> np.ndarray:
    """The picture inside a container, or its shapes drawn."""
    if b[:2] == b"\x1f\x8b":
        try:
            b = zlib.decompressobj(31).decompress(b)
        except zlib.error as e:
            raise Corrupt(f"解压 svgz 失败: {e}") from e
    if b"<svg" not in b:
        raise Corrupt("SVG 解析失败: no svg element")

    def picture(e: object) -> np.ndarray:
        m = _SVG_IMAGE.search(b)
        if not m:
            raise Unsupported("SVG image")
        kind = {b"png": "png", b"gif": "gif", b"webp": "webp"}.get(m[1], "jpeg")
        try:
            data = base64.b64decode(re.sub(rb"\s+", b"", m[2]), validate=True)
        except ValueError as e:
            raise Corrupt(f"SVG 解析失败: {e}") from e
        return to_color(_DECODERS[kind](data), "Rgba8")

    return svg.decode(b, picture)


def _encode_svg(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    data = base64.b64encode(png.encode(image)).decode()
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="{width}" height="{height}" viewBox="0 0 {width} {height}">\n'
        f'  <image width="{width}" height="{height}" href="data:image/png;base64,{data}"/>\n</svg>\n'
    ).encode()


_DECODERS = {
    "bmp": simple.decode_bmp, "netpbm": simple.decode_netpbm, "tga": simple.decode_tga, "qoi": simple.decode_qoi, "farbfeld": simple.decode_farbfeld,
    "ico": _ico, "png": png.decode, "gif": gif.decode, "jpeg": jpeg.decode, "webp": webp.decode, "svg": _svg,
}
_ENCODERS = {
    "bmp": simple.encode_bmp, "netpbm": simple.encode_netpbm, "tga": simple.encode_tga, "qoi": simple.encode_qoi, "farbfeld": simple.encode_farbfeld,
    "ico": _encode_ico, "gif": gif.encode, "webp": webp.encode, "svg": _encode_svg,
}


def check(format_id: str, enabled: tuple[str, ...] = REGISTRY) -> None:
    if format_id not in enabled:
        raise UnsupportedFormat(BY_ID[format_id].name)
    if not BY_ID[format_id].implemented:
        raise Unsupported(f"{BY_ID[format_id].name}的编解码功能尚未实现,请选择其它目标格式")


def decode_as(b: bytes, format_id: str, enabled: tuple[str, ...] = REGISTRY) -> np.ndarray:
    """An image from bytes of a named format; raises CodecError and nothing else."""
    check(format_id, enabled)
    try:
        image = _DECODERS[format_id](b)
    except CodecError:
        raise
    except Exception as e:  # damaged bytes can lead anywhere; this is the one place where that becomes an error of the file
        raise Corrupt(f"{type(e).__name__}: {e}") from e
    if not image.shape[0] or not image.shape[1]:
        raise Corrupt("图像尺寸为零")
    return image


def decode(b: bytes, enabled: tuple[str, ...] = REGISTRY) -> np.ndarray:
    """By first bytes alone."""
    found = detect(b, enabled)
    if found is None:
        raise UnknownFormat("")
    return decode_as(b, found, enabled)


def prepared(image: np.ndarray, format_id: str) -> np.ndarray:
    """The layout that an encoder is given."""
    if format_id == "ico":
        return to_color(image, "Rgba8")
    if format_id in ("qoi", "gif") and image.shape[2] <= 2:
        return to_color(image, {1: "Rgb8", 2: "Rgba8"}[image.shape[2]])
    return image


def encode(image: np.ndarray, format_id: str, options: EncodeOptions = EncodeOptions(), enabled: tuple[str, ...] = REGISTRY) -> bytes:
    check(format_id, enabled)
    image = np.ascontiguousarray(prepared(image, format_id))
    if format_id == "png":
        return png.encode(image, options.png_compression_level, options.png_fast_mode)
    if format_id == "jpeg":
        return jpeg.encode(image, options.clamped_quality)
    return _ENCODERS[format_id](image)


def identify(path: str, b: bytes, enabled: tuple[str, ...] = REGISTRY) -> tuple[np.ndarray, str]:
    """(image, format) by extension, then by first bytes, then by trying all; else a CodecError with what went wrong."""
    if not b:
        raise Corrupt("文件内容为空")
    problems = []
    ext = extension(path)
    named = next((f.id for f in FORMATS if ext in f.extensions), None)
    if named in enabled:
        try:
            return decode_as(b, named, enabled), named
        except CodecError as e:
            problems.append(f"按扩展名「{BY_ID[named].name}」解析失败:{shown(e)}")
    found = detect(b, enabled)
    if found:
        try:
            return decode_as(b, found, enabled), found
        except CodecError as e:
            problems.append(f"按文件头识别为 {BY_ID[found].name} 后解析失败:{shown(e)}")
    for f in enabled:
        try:
            return decode_as(b, f, enabled), f
        except CodecError:
            continue
    raise Corrupt(";".join(problems)) if problems else UnknownFormat("")


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def shown(e: CodecError) -> str:
    from ...functions.scalars import ERRORS

    return ERRORS[e.kind].format(e)
