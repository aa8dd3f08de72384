"""JPEG: baseline and progressive Huffman images in, baseline without subsampling out."""

from __future__ import annotations

import struct

import numpy as np

from .errors import Corrupt, Unsupported

_K = np.arange(8)
#: The orthonormal cosine basis: rows are frequencies.
BASIS = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8)) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
#: Zigzag places from their rule: diagonals, turning each time.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))])

#: The quantisation tables of the public standard's annex, row by row.
LUMA_QUANT = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMA_QUANT = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
])


class _Bits:
    """Bits of an entropy-coded segment, most significant first; zeros behind its end."""

    def __init__(self, b: bytes):
        self.b, self.at, self.hold, self.n = b, 0, 0, 0

    def fill(self, need: int) -> None:
        part = self.b[self.at : self.at + 64]
        self.at += 64
        if not part:
            if self.at > len(self.b) + 4096:
                raise Corrupt("JPEG data")
            part = bytes(64)
        self.hold = (self.hold & ((1 << self.n) - 1)) << 8 * len(part) | int.from_bytes(part, "big")
        self.n += 8 * len(part)
        if self.n < need:
            self.fill(need)

    def get(self, k: int) -> int:
        if not k:
            return 0
        if self.n < k:
            self.fill(k)
        self.n -= k
        return self.hold >> self.n & ((1 << k) - 1)

    def signed(self, k: int) -> int:
        if not k:
            return 0
        v = self.get(k)
        return v if v >> (k - 1) else v - (1 << k) + 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self.fill(16)
        size, value = table[self.hold >> (self.n - 16) & 65535]
        if not size:
            raise Corrupt("JPEG code")
        self.n -= size
        return value


def _table(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    k = 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            out += [(size, values[k])] * (1 << (16 - size))
            k += 1
    if len(out) > 65536:
        raise Corrupt("JPEG table")
    return out + [(0, 0)] * (65536 - len(out))


class _Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.blocks: np.ndarray = np.empty(0)
        self.dc = self.ac = self.last = 0


def decode(b: bytes) -> np.ndarray:
    """Gray or RGB; four components as CMYK are turned to RGB."""
    if b[:2] != b"\xff\xd8":
        raise Corrupt("JPEG header")
    at, quants, huff, parts, frame, restart, adobe = 2, {}, {}, [], None, 0, None
    scanned = False
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        kind = b[at + 1]
        if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", b, at + 2)[0]
        body = b[at + 4 : at + 2 + size]
        if len(body) < size - 2:
            raise Corrupt("JPEG segment")
        at += 2 + size
        try:
            if kind == 0xDB:
                k = 0
                while k < len(body):
                    wide, ident = body[k] >> 4, body[k] & 15
                    n = 128 if wide else 64
                    q = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    quants[ident] = np.zeros(64, np.int64)
                    quants[ident][ZIGZAG] = q
                    k += 1 + n
            elif kind == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    n = sum(counts)
                    huff[body[k]] = _table(counts, body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif kind in (0xC0, 0xC1, 0xC2):
                depth, height, width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise Unsupported("12-bit JPEG")
                if not width or not height or n not in (1, 3, 4):
                    raise Corrupt("图像尺寸为零" if n in (1, 3, 4) else "JPEG components")
                parts = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                hmax, vmax = max(p.h for p in parts), max(p.v for p in parts)
                if not all(1 <= p.h <= 4 and 1 <= p.v <= 4 for p in parts):
                    raise Corrupt("JPEG sampling")
                frame = (width, height, hmax, vmax, kind == 0xC2, -(-width // (8 * hmax)), -(-height // (8 * vmax)))
                for p in parts:
                    p.blocks = np.zeros((frame[6] * p.v, frame[5] * p.h, 64), np.int64)
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise Unsupported("lossless or arithmetic JPEG")
            elif kind == 0xDD:
                restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                adobe = body[11]
            elif kind == 0xDA:
                if frame is None:
                    raise Corrupt("JPEG scan without frame")
                at = _scan(b, at, body, parts, frame, huff, restart)
                scanned = True
        except (IndexError, KeyError, struct.error) as e:
            raise Corrupt(f"JPEG segment {kind:02X}") from e
    if not scanned:
        raise Corrupt("JPEG without image")
    return _image(parts, frame, quants, adobe)


def _segments(b: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded bytes between restart marks, stuffing removed, and the place of the next marker."""
    out, start = [], at
    while True:
        at = b.find(b"\xff", at)
        if at < 0 or at + 1 >= len(b):
            at = len(b)
            break
        if b[at + 1] == 0:
            at += 2
        elif 0xD0 <= b[at + 1] <= 0xD7:
            out.append(b[start:at].replace(b"\xff\0", b"\xff"))
            at += 2
            start = at
        elif b[at + 1] == 0xFF:
            at += 1
        else:
            break
    out.append(b[start:at].replace(b"\xff\0", b"\xff"))
    return out, at


def _scan(b: bytes, at: int, body: bytes, parts: list[_Component], frame: tuple, huff: dict, restart: int) -> int:
    width, height, hmax, vmax, progressive, across, down = frame
    n = body[0]
    chosen = []
    for i in range(n):
        p = next((x for x in parts if x.ident == body[1 + 2 * i]), None)
        if p is None:
            raise Corrupt(f"JPEG scan of component {body[1 + 2 * i]}")
        p.dc, p.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
        chosen.append(p)
    first, last, approx = body[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    segments, end = _segments(b, at)
    if n == 1:
        p = chosen[0]
        wide, tall = -(-(-(-width * p.h // hmax)) // 8), -(-(-(-height * p.v // vmax)) // 8)
        units = [[(p, y, x)] for y in range(tall) for x in range(wide)]
    else:
        units = [[(p, my * p.v + y, mx * p.h + x) for p in chosen for y in range(p.v) for x in range(p.h)] for my in range(down) for mx in range(across)]
    step = restart or len(units)
    zigzag = ZIGZAG.tolist()
    for k, segment in zip(range(0, len(units), step), segments, strict=False):
        bits, run = _Bits(segment), 0
        for p in chosen:
            p.last = 0
        for unit in units[k : k + step]:
            for p, y, x in unit:
                block = p.blocks[y, x]
                if not progressive:
                    _baseline(bits, block, p, huff, zigzag)
                elif first == 0:
                    if high:
                        block[0] |= bits.get(1) << low
                    else:
                        p.last += bits.signed(bits.symbol(huff[p.dc]))
                        block[0] = p.last << low
                elif high == 0:
                    run = _first_ac(bits, block, huff[16 | p.ac], zigzag, first, last, low, run)
                else:
                    run = _refine_ac(bits, block, huff[16 | p.ac], zigzag, first, last, 1 << low, run)
    return end


def _baseline(bits: _Bits, block: np.ndarray, p: _Component, huff: dict, zigzag: list[int]) -> None:
    p.last += bits.signed(bits.symbol(huff[p.dc]))
    block[0] = p.last
    k, table = 1, huff[16 | p.ac]
    while k < 64:
        rs = bits.symbol(table)
        r, s = rs >> 4, rs & 15
        if not s:
            if r < 15:
                break
            k += 16
            continue
        k += r
        if k > 63:
            raise Corrupt("JPEG coefficients")
        block[zigzag[k]] = bits.signed(s)
        k += 1


def _first_ac(bits: _Bits, block: np.ndarray, table: list, zigzag: list[int], k: int, last: int, low: int, run: int) -> int:
    if run:
        return run - 1
    while k <= last:
        rs = bits.symbol(table)
        r, s = rs >> 4, rs & 15
        if not s:
            if r < 15:
                return (1 << r) - 1 + bits.get(r)
            k += 16
            continue
        k += r
        if k > 63:
            raise Corrupt("JPEG coefficients")
        block[zigzag[k]] = bits.signed(s) << low if s else 0
        k += 1
    return 0


def _refine_ac(bits: _Bits, block: np.ndarray, table: list, zigzag: list[int], k: int, last: int, one: int, run: int) -> int:
    def touch(at: int) -> None:
        v = int(block[at])
        if bits.get(1) and not abs(v) & one:
            block[at] = v + one if v > 0 else v - one

    if not run:
        while k <= last:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            value = 0
            if s:
                value = one if bits.get(1) else -one
            elif r < 15:
                run = (1 << r) + bits.get(r)
                break
            while k <= last:
                at = zigzag[k]
                if block[at]:
                    touch(at)
                elif r == 0:
                    if value:
                        block[at] = value
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
    if run:
        while k <= last:
            at = zigzag[k]
            if block[at]:
                touch(at)
            k += 1
        run -= 1
    return run


def _plane(p: _Component, quants: dict) -> np.ndarray:
    if p.quant not in quants:
        raise Corrupt("JPEG table")
    rows, columns, _ = p.blocks.shape
    c = (p.blocks * quants[p.quant]).reshape(rows, columns, 8, 8).astype(np.float64)
    out = np.einsum("fy,rcfg,gx->rcyx", BASIS, c, BASIS, optimize=True) + 128.0
    return out.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)


def _image(parts: list[_Component], frame: tuple, quants: dict, adobe: int | None) -> np.ndarray:
    width, height, hmax, vmax = frame[:4]
    planes = []
    for p in parts:
        x = _plane(p, quants)
        if (p.h, p.v) != (hmax, vmax):
            x = x[np.arange(height) * p.v // vmax][:, np.arange(width) * p.h // hmax]
        planes.append(x[:height, :width])
    if len(planes) == 1:
        return np.clip(np.round(planes[0]), 0, 255).astype(np.uint8)[..., None]
    if len(planes) == 3 and adobe == 0 or len(planes) == 4 and adobe != 2:
        rgb = np.stack(planes[:3], axis=2)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    if len(planes) == 4:
        rgb = rgb * planes[3][..., None] / 255.0  # stored inverted
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)


def _codes(symbols: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(counts, values, code of each symbol, its size): a Huffman code of at most 16 bits for what occurs."""
    counts = np.bincount(symbols, minlength=256)
    used = np.flatnonzero(counts)
    weights = [(int(counts[s]), i, [int(s)]) for i, s in enumerate(used)] + [(0, 999, [256])]  # 256 keeps the all-ones code free
    size = dict.fromkeys([*map(int, used), 256], 0)
    heap = sorted(weights)
    while len(heap) > 1:
        a, b = heap.pop(0), heap.pop(0)
        for s in a[2] + b[2]:
            size[s] += 1
        new = (a[0] + b[0], min(a[1], b[1]), a[2] + b[2])
        k = next((i for i, x in enumerate(heap) if x[:2] > new[:2]), len(heap))
        heap.insert(k, new)
    per = [0] * 300
    for s in size.values():
        per[max(1, s)] += 1
    for i in range(299, 16, -1):
        while per[i]:
            j = i - 2
            while not per[j]:
                j -= 1
            per[i] -= 2
            per[i - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    longest = max(i for i in range(1, 17) if per[i])
    per[longest] -= 1
    values = sorted(map(int, used), key=lambda s: (size[s], s))
    code, k = 0, 0
    codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n in range(1, 17):
        for _ in range(per[n]):
            codes[values[k]], sizes[values[k]] = code, n
            code, k = code + 1, k + 1
        code <<= 1
    return bytes(per[1:17]), bytes(values), codes, sizes


def encode(image: np.ndarray, quality: int = 90) -> bytes:
    """Gray or RGB; alpha is dropped. Tables are those of the annex, scaled by quality, codes fitted to the image."""
    quality = max(1, min(100, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    height, width, n = image.shape
    base = image[..., : 1 if n <= 2 else 3].astype(np.float64)
    if base.shape[2] == 3:
        r, g, b = base[..., 0], base[..., 1], base[..., 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [base[..., 0]]
    tables = [np.clip((q * scale + 50) // 100, 1, 255) for q in (LUMA_QUANT, CHROMA_QUANT)][: 1 if len(planes) == 1 else 2]
    high, wide = -(-height // 8) * 8, -(-width // 8) * 8
    coded = []
    for i, plane in enumerate(planes):
        x = np.pad(plane, ((0, high - height), (0, wide - width)), mode="edge") - 128.0
        x = x.reshape(high // 8, 8, wide // 8, 8).transpose(0, 2, 1, 3)
        c = np.einsum("fy,rcyx,gx->rcfg", BASIS, x, BASIS, optimize=True).reshape(-1, 64)
        coded.append(np.round(c / tables[min(i, 1)]).astype(np.int64)[:, ZIGZAG])
    # symbols of all blocks at once: (block order, place, table, symbol, extra bits, their count)
    rows = []
    for i, c in enumerate(coded):
        blocks, order = len(c), np.arange(len(c)) * len(coded) + i
        dc = np.diff(c[:, 0], prepend=0)
        size = _size(dc)
        rows.append(_rows(order, np.zeros(blocks, np.int64), 2 * min(i, 1), size, dc, size))
        at, place = np.nonzero(c[:, 1:])
        place += 1
        v = c[at, place]
        before = np.where(np.r_[True, at[1:] != at[:-1]], 0, np.r_[0, place[:-1]]) if len(at) else place
        gap = place - before - 1
        size = _size(v)
        rows.append(_rows(order[at], place * 8 + 7, 2 * min(i, 1) + 1, (gap % 16) << 4 | size, v, size))
        for k in range(1, 4):  # runs of 16 zeros
            some = gap >= 16 * k
            rows.append(_rows(order[at[some]], before[some] * 8 + 7 + k, 2 * min(i, 1) + 1, np.full(some.sum(), 0xF0), np.zeros(some.sum(), np.int64), np.zeros(some.sum(), np.int64)))
        far = np.zeros(blocks, np.int64)
        np.maximum.at(far, at, place)
        open_ = far < 63
        rows.append(_rows(order[open_], np.full(open_.sum(), 9999), 2 * min(i, 1) + 1, np.zeros(open_.sum(), np.int64), np.zeros(open_.sum(), np.int64), np.zeros(open_.sum(), np.int64)))
    r = np.concatenate(rows)
    r = r[np.lexsort((r[:, 1], r[:, 0]))]
    dht, code, length = b"", np.zeros(len(r), np.uint64), np.zeros(len(r), np.int64)
    for t in range(2 * len(tables)):
        mine = r[:, 2] == t
        counts, values, codes, sizes = _codes(r[mine, 3])
        dht += _segment(0xC4, bytes([(t & 1) << 4 | t >> 1]) + counts + values)
        code[mine], length[mine] = codes[r[mine, 3]], sizes[r[mine, 3]]
    extra = np.where(r[:, 4] < 0, r[:, 4] + (1 << r[:, 5]) - 1, r[:, 4]).astype(np.uint64)
    data = _bits(code << r[:, 5].astype(np.uint64) | extra, length + r[:, 5])
    dqt = b"".join(_segment(0xDB, bytes([i]) + t[ZIGZAG].astype(np.uint8).tobytes()) for i, t in enumerate(tables))
    sof = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(len(planes)))
    sos = bytes([len(planes)]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(planes))) + b"\0\x3f\0"
    jfif = _segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0")
    return b"\xff\xd8" + jfif + dqt + _segment(0xC0, sof) + dht + _segment(0xDA, sos) + data.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _size(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _rows(order, place, table, symbol, value, size) -> np.ndarray:
    out = np.empty((len(order), 6), np.int64)
    for i, x in enumerate((order, place, table, symbol, value, size)):
        out[:, i] = x
    return out


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([255, kind]) + struct.pack(">H", len(body) + 2) + body


def _bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of so many bits each, one behind the other, filled with ones to a whole byte."""
    total = int(sizes.sum())
    out = np.ones(-(-total // 8) * 8, np.uint8)
    start = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[start[some] + k] = (values[some] >> (sizes[some] - 1 - k).astype(np.uint64)) & np.uint64(1)
    return np.packbits(out).tobytes()
