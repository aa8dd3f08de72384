"""Uncompressed and lightly packed formats: BMP, Netpbm, TGA, QOI and farbfeld."""

from __future__ import annotations

import struct

import numpy as np

from ...operators.raster import demote, to_color
from .errors import Corrupt, Unsupported


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise Corrupt(what)


def _sized(width: int, height: int, limit: int = 1 << 30) -> None:
    _need(0 < width and 0 < height and width * height <= limit, "图像尺寸为零" if not width or not height else "size")


# BMP -------------------------------------------------------------------------


def _shift_scale(mask: int, values: np.ndarray) -> np.ndarray:
    """A channel under a bit mask as 8 bits."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    x = ((values & mask) >> shift).astype(np.uint64)
    return ((x * 255 + top // 2) // top).astype(np.uint8)


def _bmp_rle(b: bytes, width: int, height: int, four: bool) -> np.ndarray:
    out, x, y, i = np.zeros((height, width), np.uint8), 0, 0, 0
    while i + 1 < len(b) and y < height:
        n, v = b[i], b[i + 1]
        i += 2
        if n:
            run = ([v >> 4, v & 15] * (n // 2 + 1))[:n] if four else [v] * n
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            _need(i + 2 <= len(b), "rle")
            x, y, i = x + b[i], y + b[i + 1], i + 2
            continue
        else:
            size = (v + 1) // 2 if four else v
            part = b[i : i + size]
            run = [q for p in part for q in (p >> 4, p & 15)][:v] if four else list(part)
            i += size + (size & 1)
        n = min(len(run), max(0, width - x))
        out[y, x : x + n] = run[:n]
        x += len(run)
    return out


def decode_bmp(b: bytes, at: int = 14, pixels: int | None = None, icon: bool = False) -> np.ndarray:
    """A bitmap; with ``icon`` the header of an icon's bitmap, whose height counts a mask too."""
    if not icon:
        _need(len(b) >= 26 and b[:2] == b"BM", "BMP header")
        pixels = struct.unpack_from("<I", b, 10)[0]
    _need(len(b) >= at + 12, "BMP header")
    size = struct.unpack_from("<I", b, at)[0]
    if size == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", b, at + 4)
        compression, used, entry = 0, 0, 3
    else:
        _need(size >= 40 and len(b) >= at + 40, "BMP header")
        width, height, _, bits, compression, _, _, _, used = struct.unpack_from("<iiHHIIiiI", b, at + 4)
        entry = 4
    top_down, height = height < 0, abs(height)
    if icon:
        height //= 2
    _sized(width, height)
    masks, table = None, at + size
    if compression in (3, 6):
        n = 4 if compression == 6 or size >= 56 else 3
        where = at + 40
        _need(len(b) >= where + 4 * n, "BMP masks")
        masks = [*struct.unpack_from(f"<{n}I", b, where), 0][:4]
        if size == 40:
            table += 4 * n
    palette = None
    if bits <= 8:
        n = used or 1 << bits
        raw = np.frombuffer(b[table : table + n * entry], np.uint8)
        raw = raw[: len(raw) // entry * entry].reshape(-1, entry)
        palette = np.zeros((max(256, n), 3), np.uint8)
        palette[: len(raw)] = raw[:, 2::-1]
        table += n * entry
    if icon:
        pixels = table
    data = b[pixels:]
    if compression in (1, 2):
        _need(bits == (8 if compression == 1 else 4), "BMP rle")
        rows = palette[_bmp_rle(data, width, height, compression == 2)]
    else:
        _need(compression in (0, 3, 6) and bits in (1, 4, 8, 16, 24, 32), "BMP layout")
        stride = (width * bits + 31) // 32 * 4
        _need(len(data) >= stride * (height - 1) + (width * bits + 7) // 8, "BMP data")
        raw = np.frombuffer(data[: stride * height].ljust(stride * height, b"\0"), np.uint8).reshape(height, stride)
        if bits <= 8:
            per = 8 // bits
            index = raw if bits == 8 else (raw[:, :, None] >> (8 - bits * (np.arange(per) + 1)) & ((1 << bits) - 1)).reshape(height, -1)
            rows = palette[index[:, :width]]
        elif bits == 16:
            v = np.frombuffer(raw.tobytes(), "<u2").reshape(height, -1)[:, :width].astype(np.uint32)
            m = masks or [0x7C00, 0x3E0, 0x1F, 0]
            rows = np.stack([_shift_scale(x, v) for x in (m if m[3] else m[:3])], axis=2)
        elif bits == 24:
            rows = raw[:, : width * 3].reshape(height, width, 3)[..., ::-1]
        else:
            v = np.frombuffer(raw.tobytes(), "<u4").reshape(height, -1)[:, :width]
            m = masks or [0xFF0000, 0xFF00, 0xFF, 0xFF000000 if icon else 0]
            rows = np.stack([_shift_scale(x, v) for x in (m if m[3] else m[:3])], axis=2)
    rows = rows if top_down else rows[::-1]
    if icon:
        stride = (width + 31) // 32 * 4
        mask = np.frombuffer(b[pixels + (width * bits + 31) // 32 * 4 * height :][: stride * height], np.uint8)
        if bits != 32 and len(mask) == stride * height:
            gone = np.unpackbits(mask.reshape(height, stride), axis=1)[::-1, :width]
            rows = np.dstack([rows, np.where(gone, 0, 255).astype(np.uint8)])
        rows = to_color(np.ascontiguousarray(rows), "Rgba8")
    return np.ascontiguousarray(rows)


def encode_bmp(image: np.ndarray) -> bytes:
    """Gray as 8 bits with a gray palette, RGB as 24 bits, alpha as 32 bits with masks."""
    image = to_color(image, "Rgba8") if image.shape[2] == 2 else image
    height, width, n = image.shape
    stride = (width * n * 8 + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    ordered = image[..., [2, 1, 0, 3][:n]] if n >= 3 else image
    rows[:, : width * n] = ordered.reshape(height, width * n)
    body = rows[::-1].tobytes()
    head = 108 if n == 4 else 40
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if n == 1 else b""
    offset = 14 + head + len(palette)
    info = struct.pack("<IiiHHIIiiII", head, width, height, 1, n * 8, 3 if n == 4 else 0, len(body), 2835, 2835, 256 if n == 1 else 0, 0)
    if n == 4:
        info += struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    return b"BM" + struct.pack("<IHHI", offset + len(body), 0, 0, offset) + info + palette + body


# Netpbm ----------------------------------------------------------------------


def _netpbm_tokens(b: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    while len(out) < n:
        while at < len(b) and b[at : at + 1].isspace():
            at += 1
        if b[at : at + 1] == b"#":
            end = b.find(b"\n", at)
            _need(end >= 0, "Netpbm header")
            at = end
            continue
        end = at
        while end < len(b) and b[end : end + 1].isdigit():
            end += 1
        _need(end > at, "Netpbm header")
        out.append(int(b[at:end]))
        at = end
    return out, at


def decode_netpbm(b: bytes) -> np.ndarray:
    kind = b[:2]
    _need(kind in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6", b"P7"), "Netpbm header")
    if kind == b"P7":
        end = b.find(b"ENDHDR")
        _need(end >= 0, "PAM header")
        fields = dict(line.split(None, 1) for line in b[3:end].split(b"\n") if len(line.split(None, 1)) == 2 and not line.startswith(b"#"))
        try:
            width, height, depth, top = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        except (KeyError, ValueError) as e:
            raise Corrupt("PAM header") from e
        at = b.find(b"\n", end) + 1
        _need(depth in (1, 2, 3, 4), "PAM depth")
    else:
        bitmap = kind in (b"P1", b"P4")
        found, at = _netpbm_tokens(b, 2, 2 if bitmap else 3)
        width, height, top, depth = found[0], found[1], 1 if bitmap else found[2], 3 if kind in (b"P3", b"P6") else 1
        at += kind in (b"P4", b"P5", b"P6")
    _sized(width, height)
    _need(0 < top < 65536, "Netpbm maximum")
    n = width * height * depth
    if kind == b"P4":
        stride = (width + 7) // 8
        _need(len(b) - at >= stride * height, "Netpbm data")
        bits = np.unpackbits(np.frombuffer(b, np.uint8, stride * height, at).reshape(height, stride), axis=1)[:, :width]
        return np.where(bits, 0, 255).astype(np.uint8)[..., None]
    if kind == b"P1":
        digits = np.array([c - 48 for line in b[at:].split(b"\n") for c in line.split(b"#")[0] if c in b"01"], np.uint8)
        _need(len(digits) >= n, "Netpbm data")
        return np.where(digits[:n], 0, 255).astype(np.uint8).reshape(height, width, 1)
    if kind in (b"P2", b"P3"):
        try:
            v = np.array(b" ".join(x.split(b"#")[0] for x in b[at:].split(b"\n")).split()[:n], np.int64)
        except (ValueError, OverflowError) as e:
            raise Corrupt("Netpbm data") from e
        _need(len(v) == n, "Netpbm data")
    else:
        size = 1 if top < 256 else 2
        _need(len(b) - at >= n * size, "Netpbm data")
        v = np.frombuffer(b, np.uint8 if size == 1 else ">u2", n, at).astype(np.int64)
    _need(int(v.max(initial=0)) <= top and int(v.min(initial=0)) >= 0, "Netpbm sample")
    if top > 255:
        return demote((v * 65535 // top if top != 65535 else v).astype(np.uint16)).reshape(height, width, depth)
    return (v * 255 // top if top != 255 else v).astype(np.uint8).reshape(height, width, depth)


def encode_netpbm(image: np.ndarray) -> bytes:
    height, width, n = image.shape
    if n in (1, 3):
        return f"P{5 if n == 1 else 6}\n{width} {height}\n255\n".encode() + image.tobytes()
    kind = "GRAYSCALE_ALPHA" if n == 2 else "RGB_ALPHA"
    return f"P7\nWIDTH {width}\nHEIGHT {height}\nDEPTH {n}\nMAXVAL 255\nTUPLTYPE {kind}\nENDHDR\n".encode() + image.tobytes()


# TGA -------------------------------------------------------------------------


def _tga_rle(b: bytes, at: int, size: int, n: int) -> bytes:
    out = bytearray()
    while len(out) < n * size:
        _need(at < len(b), "TGA data")
        head, at = b[at], at + 1
        count = (head & 127) + 1
        if head & 128:
            _need(at + size <= len(b), "TGA data")
            out += b[at : at + size] * count
            at += size
        else:
            _need(at + count * size <= len(b), "TGA data")
            out += b[at : at + count * size]
            at += count * size
    return bytes(out[: n * size])


def _tga_pixels(raw: np.ndarray, bits: int, alpha: bool) -> np.ndarray:
    if bits in (15, 16):
        v = raw.view("<u2").reshape(-1)
        return np.stack([((v >> s & 31).astype(np.uint32) * 255 // 31).astype(np.uint8) for s in (10, 5, 0)], axis=1)
    if bits == 24:
        return raw[:, ::-1]
    return raw[:, [2, 1, 0, 3]] if alpha else raw[:, 2::-1]


def decode_tga(b: bytes) -> np.ndarray:
    """Colour-mapped, true-colour and gray images, packed or not. There is no magic, so all of the header is checked."""
    _need(len(b) >= 18, "TGA header")
    id_size, mapped, kind, first, entries, entry_bits, _, _, width, height, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", b)
    _need(mapped in (0, 1) and kind in (1, 2, 3, 9, 10, 11) and flags & 0xC0 == 0, "TGA header")
    base = kind & 7
    _need({1: bits == 8 and mapped == 1 and entry_bits in (15, 16, 24, 32), 2: bits in (15, 16, 24, 32), 3: bits in (8, 16)}[base], "TGA depth")
    _sized(width, height)
    at = 18 + id_size
    table = None
    if mapped:
        size = (entry_bits + 7) // 8
        _need(len(b) >= at + entries * size, "TGA palette")
        table = np.zeros((first + entries, 4 if entry_bits == 32 else 3), np.uint8)
        table[first:] = _tga_pixels(np.frombuffer(b, np.uint8, entries * size, at).reshape(-1, size), entry_bits, True)
        at += entries * size
    size, n = (bits + 7) // 8, width * height
    if kind & 8:
        data = _tga_rle(b, at, size, n)
    else:
        _need(len(b) >= at + n * size, "TGA data")
        data = b[at : at + n * size]
    raw = np.frombuffer(data, np.uint8).reshape(n, size)
    if base == 1:
        _need(int(raw.max(initial=0)) < len(table), "TGA index")
        out = table[raw[:, 0]]
    elif base == 3:
        out = raw
    else:
        out = _tga_pixels(raw, bits, bits == 32)
    out = out.reshape(height, width, -1)
    out = out if flags & 32 else out[::-1]
    return np.ascontiguousarray(out[:, ::-1] if flags & 16 else out)


def encode_tga(image: np.ndarray) -> bytes:
    """Runs are packed row by row."""
    height, width, n = image.shape
    base = 3 if n <= 2 else 2
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, base | 8, 0, 0, 0, 0, 0, width, height, n * 8, 32 | (8 if n in (2, 4) else 0))
    ordered = np.ascontiguousarray(image[..., [2, 1, 0, 3][:n]] if n >= 3 else image)
    out = bytearray(head)
    for row in ordered:
        change = np.flatnonzero((row[1:] != row[:-1]).any(axis=1)) + 1
        bounds = [0, *change.tolist(), width]
        wait = 0
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s < 2:
                continue
            _literals(out, row[wait:s])
            for k in range(s, e, 128):
                out.append(127 + min(128, e - k))
                out += row[s].tobytes()
            wait = e
        _literals(out, row[wait:])
    return bytes(out)


def _literals(out: bytearray, part: np.ndarray) -> None:
    for k in range(0, len(part), 128):
        some = part[k : k + 128]
        out.append(len(some) - 1)
        out += some.tobytes()


# QOI -------------------------------------------------------------------------


def decode_qoi(b: bytes) -> np.ndarray:
    _need(len(b) >= 14 and b[:4] == b"qoif", "QOI header")
    width, height, n, _ = struct.unpack_from(">IIBB", b, 4)
    _need(n in (3, 4), "QOI header")
    _sized(width, height)
    total, at, end = width * height, 14, len(b)
    out, seen, px, done = bytearray(), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    while done < total:
        _need(at < end, "QOI data")
        op, at, run = b[at], at + 1, 1
        r, g, bl, a = px
        if op >= 254:
            k = op - 251
            _need(at + k <= end, "QOI data")
            px, at = (*b[at : at + 3], b[at + 3] if k == 4 else a), at + k
        elif op < 64:
            px = seen[op]
        elif op < 128:
            px = ((r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (bl + (op & 3) - 2) & 255, a)
        elif op < 192:
            _need(at < end, "QOI data")
            d, m, at = (op & 63) - 32, b[at], at + 1
            px = ((r + d - 8 + (m >> 4)) & 255, (g + d) & 255, (bl + d - 8 + (m & 15)) & 255, a)
        else:
            run = min((op & 63) + 1, total - done)
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) & 63] = px
        out += bytes(px[:n]) * run
        done += run
    return np.frombuffer(bytes(out), np.uint8).reshape(height, width, n)


def encode_qoi(image: np.ndarray) -> bytes:
    height, width, n = image.shape
    out = bytearray(b"qoif" + struct.pack(">IIBB", width, height, n, 0))
    rgba = image.reshape(-1, n)
    if n == 3:
        rgba = np.hstack([rgba, np.full((len(rgba), 1), 255, np.uint8)])
    # runs of equal pixels are found at once, what differs is coded pixel by pixel
    change = np.flatnonzero((rgba[1:] != rgba[:-1]).any(axis=1)) + 1
    bounds = [0, *change.tolist(), len(rgba)]
    seen, last = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255)
    for s, e in zip(bounds, bounds[1:], strict=False):
        px, run = tuple(rgba[s].tolist()), e - s
        if px != last:
            run -= 1
            at = (px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) & 63
            dr, dg, db = ((x - y + 128 & 255) - 128 for x, y in zip(px[:3], last[:3], strict=True))
            if seen[at] == px:
                out.append(at)
            elif px[3] != last[3]:
                out += bytes((255, *px))
            elif -2 <= dr < 2 and -2 <= dg < 2 and -2 <= db < 2:
                out.append(64 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -32 <= dg < 32 and -8 <= dr - dg < 8 and -8 <= db - dg < 8:
                out += bytes((128 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
            else:
                out += bytes((254, *px[:3]))
            seen[at] = last = px
        while run > 0:
            out.append(191 + min(run, 62))
            seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) & 63] = px
            run -= 62
    return bytes(out) + bytes(7) + b"\1"


# farbfeld --------------------------------------------------------------------


def decode_farbfeld(b: bytes) -> np.ndarray:
    _need(len(b) >= 16 and b[:8] == b"farbfeld", "farbfeld header")
    width, height = struct.unpack_from(">II", b, 8)
    _sized(width, height)
    _need(len(b) >= 16 + width * height * 8, "farbfeld data")
    return demote(np.frombuffer(b, ">u2", width * height * 4, 16).astype(np.uint16).reshape(height, width, 4))


def encode_farbfeld(image: np.ndarray) -> bytes:
    wide = to_color(image, "Rgba8").astype(">u2") * 257
    return b"farbfeld" + struct.pack(">II", image.shape[1], image.shape[0]) + wide.astype(">u2").tobytes()


__all__ = ["Unsupported"]
