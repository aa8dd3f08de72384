"""PNG: all depths, palettes and interlacing in; 8-bit images with chosen filters out."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ...operators.raster import demote
from .errors import Corrupt

MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Places of the seven passes as (x, y, step x, step y).
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of filter byte and data to data."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == 1:
            for c in range(bpp):
                row[c::bpp] = np.cumsum(row[c::bpp], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind == 3:
            line, up = row.tolist(), above.tolist()
            for i in range(len(line)):
                line[i] = (line[i] + ((line[i - bpp] if i >= bpp else 0) + up[i]) // 2) & 255
            row[:] = line
        elif kind == 4:
            line, up = row.tolist(), above.tolist()
            for i in range(len(line)):
                a, b, c = (line[i - bpp], up[i], up[i - bpp]) if i >= bpp else (0, up[i], 0)
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                line[i] = (line[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            row[:] = line
        elif kind:
            raise Corrupt("PNG filter")
        above = row
    return rows


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    height = len(rows)
    if depth == 8:
        return rows[:, : width * channels].reshape(height, width, channels)
    if depth == 16:
        return rows[:, : width * channels * 2].copy().view(">u2").astype(np.uint16).reshape(height, width, channels)
    bits = rows[:, :, None] >> (8 - depth * (np.arange(8 // depth) + 1)) & ((1 << depth) - 1)
    return bits.reshape(height, -1)[:, :width, None].astype(np.uint8)


def decode(b: bytes) -> np.ndarray:
    if not b.startswith(MAGIC):
        raise Corrupt("PNG signature")
    at, head, palette, clear, data = 8, None, None, None, []
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(b):
            raise Corrupt("PNG chunk")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", b, at + 8 + n)[0] and kind[:1].isupper():
            raise Corrupt("PNG CRC")
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8)[: n // 3 * 3].reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or not data:
        raise Corrupt("PNG without image")
    width, height, depth, color, _, _, interlaced = head
    if not width or not height or width * height > 1 << 30:
        raise Corrupt("图像尺寸为零" if not width or not height else "size")
    if color not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or (depth < 8 and color not in (0, 3)) or (depth == 16 and color == 3):
        raise Corrupt("PNG layout")
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise Corrupt(str(e)) from e
    channels = _CHANNELS[color]
    bpp = max(1, channels * depth // 8)
    out = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x, y, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = 1 + (w * channels * depth + 7) // 8
        if at + stride * h > len(raw):
            raise Corrupt("PNG data")
        rows = _unfilter(raw[at : at + stride * h].reshape(h, stride), bpp)
        out[y::dy, x::dx] = _samples(rows, w, channels, depth)
        at += stride * h
    if color == 3:
        if palette is None or int(out.max()) >= len(palette):
            raise Corrupt("PNG palette")
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            n = min(len(clear), len(alpha))
            alpha[:n] = np.frombuffer(clear[:n], np.uint8)
            palette = np.hstack([palette, alpha[:, None]])
        return np.ascontiguousarray(palette[out[..., 0]])
    gone = None
    if clear is not None and color in (0, 2) and len(clear) >= 2 * channels:
        gone = (out == np.array(struct.unpack(f">{channels}H", clear[: 2 * channels]))).all(axis=2)
    if depth < 8:
        out = (out.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    out = demote(out)
    return np.dstack([out, np.where(gone, 0, 255).astype(np.uint8)]) if gone is not None else out


#: Zlib levels of the named compressions.
LEVELS = {"Uncompressed": 0, "Fast": 1, "Default": 6, "Best": 9}


def settings(level: int, fast: bool) -> tuple[str, str]:
    """As ``formats.png_settings``, for one image."""
    if fast:
        return ("Uncompressed" if level == 0 else "Fast" if level <= 4 else "Default"), "Sub"
    if level == 0:
        return "Uncompressed", "NoFilter"
    return ("Fast" if level <= 3 else "Default" if level <= 7 else "Best"), ("Sub" if level <= 7 else "Adaptive")


def _filtered(rows: np.ndarray, bpp: int, kind: str) -> np.ndarray:
    height, stride = rows.shape
    out = np.zeros((height, stride + 1), np.uint8)
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    if kind == "NoFilter":
        out[:, 1:] = rows
        return out
    if kind == "Sub":
        out[:, 0], out[:, 1:] = 1, rows - left
        return out
    up, corner = np.zeros_like(rows), np.zeros_like(rows)
    up[1:], corner[1:] = rows[:-1], left[:-1]
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)
    tries = np.stack([rows, rows - left, rows - up, rows - ((a + b) // 2).astype(np.uint8), rows - paeth])
    cost = np.abs(tries.view(np.int8).astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    out[:, 0], out[:, 1:] = best, tries[best, np.arange(height)]
    return out


def encode(image: np.ndarray, level: int = 1, fast: bool = True) -> bytes:
    compression, kind = settings(level, fast)
    height, width, n = image.shape
    raw = _filtered(np.ascontiguousarray(image).reshape(height, width * n), n, kind)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVELS[compression])) + chunk(b"IEND", b"")
