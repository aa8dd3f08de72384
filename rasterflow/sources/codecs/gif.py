"""GIF: the first frame in, one frame of at most 256 colours and on-or-off alpha out."""

from __future__ import annotations

import struct

import numpy as np

from .errors import Corrupt


def _unpack(data: bytes, least: int, n: int) -> bytes:
    clear, stop = 1 << least, (1 << least) + 1
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    width, last, out, size = least + 1, b"", [], 0
    hold = bits = 0
    for byte in data:
        hold |= byte << bits
        bits += 8
        while bits >= width:
            code = hold & ((1 << width) - 1)
            hold >>= width
            bits -= width
            if code == clear:
                del table[clear + 2 :]
                width, last = least + 1, b""
                continue
            if code == stop or size >= n:
                return b"".join(out)[:n]
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise Corrupt("GIF code")
            out.append(entry)
            size += len(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return b"".join(out)[:n]


def _pack(indices: bytes, least: int) -> bytes:
    clear, stop = 1 << least, (1 << least) + 1
    fresh = {bytes([i]): i for i in range(clear)}
    table, width, n = dict(fresh), least + 1, stop + 1
    out, hold, bits = bytearray(), clear, least + 1
    last = b""
    for i in indices:
        new = last + bytes([i])
        if new in table:
            last = new
            continue
        hold |= table[last] << bits
        bits += width
        if n < 4096:
            table[new] = n
            if n == 1 << width and width < 12:
                width += 1
            n += 1
        else:
            hold |= clear << bits
            bits += width
            table, width, n = dict(fresh), least + 1, stop + 1
        while bits >= 8:
            out.append(hold & 255)
            hold >>= 8
            bits -= 8
        last = bytes([i])
    hold |= table[last] << bits
    bits += width
    if n == 1 << width and width < 12:
        width += 1
    hold |= stop << bits
    bits += width
    while bits > 0:
        out.append(hold & 255)
        hold >>= 8
        bits -= 8
    return bytes(out)


def decode(b: bytes) -> np.ndarray:
    """The first frame on the whole canvas, with alpha."""
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        raise Corrupt("GIF header")
    width, height, flags = struct.unpack_from("<HHB", b, 6)
    if not width or not height:
        raise Corrupt("图像尺寸为零")
    at, shared, clear = 13, None, None
    if flags & 128:
        n = 2 << (flags & 7)
        shared = b[at : at + 3 * n]
        at += 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(b):
                raise Corrupt("GIF data")
            n = b[at]
            if not n:
                return b"".join(parts), at + 1
            parts.append(b[at + 1 : at + 1 + n])
            at += 1 + n

    while at < len(b):
        kind = b[at]
        if kind == 0x21:
            label = b[at + 1 : at + 2]
            body, at = blocks(at + 2)
            if label == b"\xf9" and len(body) >= 4 and body[0] & 1:
                clear = body[3]
        elif kind == 0x2C:
            if at + 11 > len(b):
                break
            x, y, w, h, f = struct.unpack_from("<HHHHB", b, at + 1)
            at += 10
            table = shared
            if f & 128:
                n = 2 << (f & 7)
                table = b[at : at + 3 * n]
                at += 3 * n
            if table is None or at >= len(b) or not 1 <= b[at] <= 11 or not w or not h:
                raise Corrupt("GIF frame")
            least = b[at]
            data, at = blocks(at + 1)
            raw = np.frombuffer(_unpack(data, least, w * h), np.uint8)
            if len(raw) < w * h:
                raise Corrupt("GIF data")
            raw = raw.reshape(h, w)
            if f & 64:
                order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, h, d)]
                straight = np.empty_like(raw)
                straight[order] = raw
                raw = straight
            colors = np.zeros((256, 4), np.uint8)
            known = np.frombuffer(table, np.uint8)[: len(table) // 3 * 3].reshape(-1, 3)
            colors[: len(known), :3], colors[: len(known), 3] = known, 255
            if clear is not None:
                colors[clear, 3] = 0
            out = np.zeros((height, width, 4), np.uint8)
            seen = colors[raw][: max(0, height - y), : max(0, width - x)]
            out[y : y + seen.shape[0], x : x + seen.shape[1]] = seen
            return out
        elif kind == 0x3B:
            break
        else:
            raise Corrupt("GIF block")
    raise Corrupt("GIF without frame")


def quantise(rgb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(palette, index of each row) by median cut over the distinct colours; exact where they are few."""
    keys = rgb[:, 0].astype(np.uint32) << 16 | rgb[:, 1].astype(np.uint32) << 8 | rgb[:, 2]
    values, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    colors = np.stack([values >> 16, values >> 8 & 255, values & 255], axis=1).astype(np.int64)
    boxes = [np.arange(len(values))]
    while len(boxes) < min(n, len(values)):
        spread = [(np.ptp(colors[x], axis=0).max() * np.sqrt(counts[x].sum()) if len(x) > 1 else -1) for x in boxes]
        x = boxes.pop(int(np.argmax(spread)))
        axis = int(np.ptp(colors[x], axis=0).argmax())
        x = x[np.argsort(colors[x, axis], kind="stable")]
        upto = np.cumsum(counts[x])
        cut = min(len(x) - 1, max(1, int(np.searchsorted(upto, upto[-1] / 2)) + 1))
        boxes += [x[:cut], x[cut:]]
    label = np.empty(len(values), np.uint8)
    palette = np.zeros((len(boxes), 3), np.uint8)
    for i, x in enumerate(boxes):
        label[x] = i
        palette[i] = np.round((colors[x] * counts[x, None]).sum(axis=0) / counts[x].sum())
    return palette, label[which]


def encode(image: np.ndarray) -> bytes:
    """RGB or RGBA; alpha of 128 and more is opaque."""
    height, width, n = image.shape
    flat = image.reshape(-1, n)
    gone = flat[:, 3] < 128 if n == 4 else np.zeros(len(flat), bool)
    palette, index = quantise(flat[~gone][:, :3], 255 if gone.any() else 256) if not gone.all() else (np.zeros((1, 3), np.uint8), np.empty(0, np.uint8))
    indices = np.full(len(flat), len(palette), np.uint8) if gone.any() else np.empty(len(flat), np.uint8)
    indices[~gone] = index
    bits = max(1, int(len(palette) + gone.any() - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette
    least = max(2, bits)
    body = _pack(indices.tobytes(), least)
    parts = b"".join(bytes([len(x)]) + x for x in (body[i : i + 255] for i in range(0, len(body), 255))) + b"\0"
    control = b"\x21\xf9\x04" + bytes([1, 0, 0, len(palette)]) + b"\0" if gone.any() else b""
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | 0x70 | bits - 1, 0, 0) + table.tobytes() + control + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + bytes([least]) + parts + b"\x3b"
