"""WebP, lossless (VP8L): all of its transforms in, a predicted image with fitted codes out.

Lossy (VP8) and animated files are reported as unsupported.
"""

from __future__ import annotations

import struct

import numpy as np

from ...operators.raster import to_color
from .errors import Corrupt, Unsupported

#: The order of code lengths, and the 120 near distances as (x, y) in the public format's order.
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class _Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, b: bytes):
        self.b, self.at, self.hold, self.n = b, 0, 0, 0

    def fill(self) -> None:
        part = self.b[self.at : self.at + 32]
        self.at += 32
        if not part and self.at > len(self.b) + 1024:
            raise Corrupt("VP8L data")
        part = part.ljust(32, b"\0")
        self.hold |= int.from_bytes(part, "little") << self.n
        self.n += 256

    def get(self, k: int) -> int:
        if self.n < k:
            self.fill()
        v = self.hold & ((1 << k) - 1)
        self.hold >>= k
        self.n -= k
        return v

    def symbol(self, code: tuple[int, dict]) -> int:
        """code: (longest, {(bits reversed, size): symbol}) as a table over the longest size."""
        longest, table = code
        if not longest:
            return table[0][1]
        if self.n < longest:
            self.fill()
        size, value = table[self.hold & ((1 << longest) - 1)]
        self.hold >>= size
        self.n -= size
        return value


def _canonical(lengths: list[int]) -> list[int]:
    """The code of each symbol, with its first bit lowest."""
    out, code = [0] * len(lengths), 0
    for n in range(1, 16):
        for s, size in enumerate(lengths):
            if size == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


def _table(lengths: list[int]) -> tuple[int, list]:
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        raise Corrupt("VP8L code")
    if len(used) == 1:
        return 0, [(0, used[0])]
    if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
        raise Corrupt("VP8L code")
    longest = max(lengths)
    table: list = [None] * (1 << longest)
    for s, code in enumerate(_canonical(lengths)):
        if n := lengths[s]:
            table[code :: 1 << n] = [(n, s)] * (1 << (longest - n))
    return longest, table


def _code(bits: _Bits, alphabet: int) -> tuple[int, list]:
    if bits.get(1):
        two = bits.get(1)
        symbols = [bits.get(8 if bits.get(1) else 1)] + ([bits.get(8)] if two else [])
        if max(symbols) >= alphabet:
            raise Corrupt("VP8L symbol")
        if len(set(symbols)) == 1:
            return 0, [(0, symbols[0])]
        return 1, [(1, symbols[0]), (1, symbols[1])]
    sizes = [0] * 19
    for i in range(4 + bits.get(4)):
        sizes[_ORDER[i]] = bits.get(3)
    lengths_code = _table(sizes)
    most = alphabet
    if bits.get(1):
        n = 2 + 2 * bits.get(3)
        most = 2 + bits.get(n)
        if most > alphabet:
            raise Corrupt("VP8L code")
    lengths: list[int] = []
    last = 8
    while len(lengths) < alphabet and most:
        most -= 1
        s = bits.symbol(lengths_code)
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            n, v = (3 + bits.get(2), last) if s == 16 else (3 + bits.get(3), 0) if s == 17 else (11 + bits.get(7), 0)
            lengths += [v] * n
    if len(lengths) > alphabet:
        raise Corrupt("VP8L code")
    return _table(lengths + [0] * (alphabet - len(lengths)))


def _prefix(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.get(extra) + 1


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """A flat array of ARGB numbers."""
    cache_bits = bits.get(4) if bits.get(1) else 0
    if cache_bits > 11:
        raise Corrupt("VP8L cache")
    meta, shift, groups = None, 0, 1
    if main and bits.get(1):
        shift = bits.get(3) + 2
        wide = (width + (1 << shift) - 1) >> shift
        tall = (height + (1 << shift) - 1) >> shift
        meta = (_pixels(bits, wide, tall, False) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(meta.max()) + 1
        meta = meta.tolist()
    cache = [0] * (1 << cache_bits) if cache_bits else []
    alphabet = 256 + 24 + len(cache)
    codes = [[_code(bits, n) for n in (alphabet, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    out: list[int] = []
    group, turn = codes[0], 32 - cache_bits
    while len(out) < total:
        at = len(out)
        if meta is not None:
            group = codes[meta[(at // width >> shift) * wide + (at % width >> shift)]]
        s = bits.symbol(group[0])
        if s < 256:
            r, b, a = bits.symbol(group[1]), bits.symbol(group[2]), bits.symbol(group[3])
            px = a << 24 | r << 16 | s << 8 | b
            out.append(px)
            if cache:
                cache[(0x1E35A7BD * px & 0xFFFFFFFF) >> turn] = px
        elif s < 280:
            n = _prefix(bits, s - 256)
            d = _prefix(bits, bits.symbol(group[4]))
            if d <= 120:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            if d > at or at + n > total:
                raise Corrupt("VP8L copy")
            if d >= n:
                new = out[at - d : at - d + n]
            else:
                new = (out[at - d :] * (n // d + 1))[:n]
            out += new
            if cache:
                for px in new:
                    cache[(0x1E35A7BD * px & 0xFFFFFFFF) >> turn] = px
        else:
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def _bytes(argb: np.ndarray) -> np.ndarray:
    """(n, 4) of A, R, G, B."""
    return np.ascontiguousarray(argb.astype(">u4")).view(np.uint8).reshape(-1, 4)


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) // 2 for x, y in zip(a, b, strict=True)]


def _predicted(mode: int, left: list[int], top: list[int], corner: list[int], right: list[int]) -> list[int]:
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
            return left if to_left < to_top else top
        case 12:
            return [_clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
        case 13:
            mid = _average(left, top)
            return [_clamp(m + int((m - c) / 2)) for m, c in zip(mid, corner, strict=True)]
        case _:
            return [255, 0, 0, 0]


def _unpredict(px: np.ndarray, width: int, height: int, modes: np.ndarray, shift: int) -> np.ndarray:
    wide = (width + (1 << shift) - 1) >> shift
    rows = _bytes(px).reshape(height, width, 4)
    kinds = (modes >> 8 & 15).astype(np.int64)
    rows[0, 0] += np.array([255, 0, 0, 0], np.uint8)
    rows[0] = np.cumsum(rows[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        rows[y, 0] += rows[y - 1, 0]
        line = rows[y].tolist()
        above = rows[y - 1].tolist()
        above.append(line[0])  # the place right of the row's end is the first of the next row
        mine = kinds[(y >> shift) * wide : (y >> shift) * wide + wide].tolist()
        left = line[0]
        for x in range(1, width):
            p = _predicted(mine[x >> shift], left, above[x], above[x - 1], above[x + 1])
            d = line[x]
            left = line[x] = [d[0] + p[0] & 255, d[1] + p[1] & 255, d[2] + p[2] & 255, d[3] + p[3] & 255]
        rows[y] = line
    return rows.reshape(-1, 4).view(">u4").reshape(-1).astype(np.uint32)


def _uncross(px: np.ndarray, width: int, height: int, factors: np.ndarray, shift: int) -> np.ndarray:
    wide = (width + (1 << shift) - 1) >> shift
    y, x = np.divmod(np.arange(len(px)), width)
    f = _bytes(factors)[(y >> shift) * wide + (x >> shift)].view(np.int8).astype(np.int32)
    argb = _bytes(px).copy()
    green = argb[:, 2].view(np.int8).astype(np.int32)
    red = argb[:, 1].astype(np.int32) + (f[:, 3] * green >> 5) & 255
    signed = red.astype(np.uint8).view(np.int8).astype(np.int32)
    blue = argb[:, 3].astype(np.int32) + (f[:, 2] * green >> 5) + (f[:, 1] * signed >> 5) & 255
    argb[:, 1], argb[:, 3] = red, blue
    return argb.view(">u4").reshape(-1).astype(np.uint32)


def _add_green(px: np.ndarray, sign: int = 1) -> np.ndarray:
    argb = _bytes(px).copy()
    green = argb[:, 2] if sign > 0 else (0 - argb[:, 2]).astype(np.uint8)
    argb[:, 1] += green
    argb[:, 3] += green
    return argb.view(">u4").reshape(-1).astype(np.uint32)


def decode_vp8l(b: bytes) -> np.ndarray:
    if len(b) < 5 or b[0] != 0x2F:
        raise Corrupt("VP8L header")
    bits = _Bits(b[1:])
    width, height = bits.get(14) + 1, bits.get(14) + 1
    alpha = bits.get(1)
    if bits.get(3):
        raise Corrupt("VP8L version")
    steps, wide = [], width
    while bits.get(1):
        kind = bits.get(2)
        if kind in (s[0] for s in steps):
            raise Corrupt("VP8L transform")
        if kind in (0, 1):
            shift = bits.get(3) + 2
            n = lambda x, shift=shift: (x + (1 << shift) - 1) >> shift
            steps.append((kind, wide, _pixels(bits, n(wide), n(height), False), shift))
        elif kind == 2:
            steps.append((kind, wide, None, 0))
        else:
            n = bits.get(8) + 1
            table = _bytes(_pixels(bits, n, 1, False))
            table = np.cumsum(table, axis=0, dtype=np.uint8)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, wide, np.ascontiguousarray(table).view(">u4").reshape(-1).astype(np.uint32), shift))
            wide = (wide + (1 << shift) - 1) >> shift
    px = _pixels(bits, wide, height, True)
    for kind, w, data, shift in reversed(steps):
        if kind == 0:
            px = _unpredict(px, w, height, data, shift)
        elif kind == 1:
            px = _uncross(px, w, height, data, shift)
        elif kind == 2:
            px = _add_green(px)
        else:
            index = (px >> 8 & 255).reshape(height, -1)
            if shift:
                per, size = 1 << shift, 8 >> shift
                index = (index[:, :, None] >> (size * np.arange(per)) & ((1 << size) - 1)).reshape(height, -1)[:, :w]
            known = np.zeros(256, np.uint32)
            known[: len(data)] = data
            px = known[index.reshape(-1)]
    argb = _bytes(px).reshape(height, width, 4)
    return np.ascontiguousarray(argb[..., [1, 2, 3, 0]] if alpha else argb[..., 1:])


def decode(b: bytes) -> np.ndarray:
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        raise Corrupt("WebP header")
    at = 12
    while at + 8 <= len(b):
        kind, n = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        body = b[at + 8 : at + 8 + n]
        if kind == b"VP8L":
            try:
                return decode_vp8l(body)
            except (IndexError, TypeError) as e:
                raise Corrupt("VP8L data") from e
        if kind in (b"VP8 ", b"ANIM", b"ANMF"):
            raise Unsupported("WebP 有损或动画数据")
        at += 8 + n + (n & 1)
    raise Corrupt("WebP without image")


class _Writer:
    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(np.array([value], np.uint64))
        self.sizes.append(np.array([n], np.int64))

    def bytes(self) -> bytes:
        v, s = np.concatenate(self.values), np.concatenate(self.sizes)
        start = np.cumsum(s) - s
        out = np.zeros(-(-int(s.sum()) // 8) * 8, np.uint8)
        for k in range(int(s.max(initial=0))):
            some = s > k
            out[start[some] + k] = v[some] >> np.uint64(k) & np.uint64(1)
        return np.packbits(out, bitorder="little").tobytes()


def _fitted(counts: np.ndarray, longest: int = 15) -> list[int]:
    """Huffman sizes of at most ``longest`` bits; counts are flattened until they fit."""
    import heapq

    used = np.flatnonzero(counts).tolist()
    weights = {s: int(counts[s]) for s in used}
    while True:
        sizes = dict.fromkeys(used, 0)
        heap = [(weights[s], i, [s]) for i, s in enumerate(used)]
        heapq.heapify(heap)
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                sizes[s] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(sizes.values()) <= longest:
            out = [0] * len(counts)
            for s, size in sizes.items():
                out[s] = size
            return out
        weights = {s: (w + 1) // 2 for s, w in weights.items()}


def _put_code(w: _Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code fitted to counts; (codes, sizes) of the symbols."""
    used = np.flatnonzero(counts)
    codes, sizes = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        if len(symbols) == 2:
            codes[symbols[1]] = 1
            sizes[symbols] = 1
        return codes, sizes
    lengths = _fitted(counts)
    w.put(0, 1)
    w.put(15, 4)
    for s in _ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    turned = np.array([int(f"{i:04b}"[::-1], 2) for i in range(16)], np.uint64)
    w.values.append(turned[lengths])
    w.sizes.append(np.full(len(lengths), 4))
    codes[:] = _canonical(lengths)
    sizes[:] = lengths
    return codes, sizes


def encode(image: np.ndarray) -> bytes:
    """Any 8-bit layout; green is subtracted and the best of three predictors used for the whole image."""
    alpha = image.shape[2] in (2, 4)
    rgba = to_color(image, "Rgba8")
    height, width = rgba.shape[:2]
    if width > 1 << 14 or height > 1 << 14:
        raise Unsupported(f"WebP {width}×{height}")
    argb = np.ascontiguousarray(rgba[..., [3, 0, 1, 2]])
    argb[..., 1] -= argb[..., 2]
    argb[..., 3] -= argb[..., 2]
    left, top, corner = np.zeros_like(argb), np.zeros_like(argb), np.zeros_like(argb)
    left[:, 1:], top[1:], corner[1:, 1:] = argb[:, :-1], argb[:-1], argb[:-1, :-1]
    full = np.clip(left.astype(np.int16) + top - corner, 0, 255).astype(np.uint8)
    best = None
    for mode, p in ((1, left), (2, top), (12, full)):
        p = p.copy()
        p[0, 1:], p[1:, 0], p[0, 0] = left[0, 1:], top[1:, 0], (255, 0, 0, 0)
        rest = argb - p
        counts = [np.bincount(rest[..., c].reshape(-1), minlength=256) for c in range(4)]
        cost = sum(float((n[n > 0] * -np.log2(n[n > 0] / n.sum())).sum()) for n in counts)
        if best is None or cost < best[0]:
            best = (cost, mode, rest, counts)
    _, mode, rest, counts = best
    w = _Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)
    w.put(1 | 2 << 1, 3)  # subtract green
    w.put(1, 3)  # predictor
    w.put(7, 3)
    w.put(0, 1)
    for symbol in (mode, 0, 0, 0, 0):
        one = np.zeros(256, np.int64)
        one[symbol] = 1
        _put_code(w, one)
    w.put(0, 1)
    w.put(0, 2)
    green = np.zeros(280, np.int64)
    green[:256] = counts[2]
    tables = [_put_code(w, n) for n in (green, counts[1], counts[3], counts[0], np.zeros(40, np.int64))]
    flat = rest.reshape(-1, 4)
    order = [flat[:, c] for c in (2, 1, 3, 0)]
    w.values.append(np.stack([t[0][x] for t, x in zip(tables, order, strict=False)], axis=1).reshape(-1))
    w.sizes.append(np.stack([t[1][x] for t, x in zip(tables, order, strict=False)], axis=1).reshape(-1))
    body = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
