"""Basic shapes of SVG drawn to RGBA: rect, circle, ellipse, line, polyline, polygon and path.

Shapes are flattened to polygons, filled by sub-scanlines with exact horizontal coverage and laid over
each other with premultiplied alpha. Plain colours only; gradients, patterns, clips, masks, filters, style
sheets and text are reported as unsupported instead of being drawn wrong.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import numpy as np

from .errors import Corrupt, Unsupported

#: Sub-scanlines of a row, and the longest step of a flattened curve in degrees or parts.
LINES, STEPS = 8, 32
#: The sixteen basic colours and orange, and CSS pixels of a unit.
COLORS = {
    "black": "000000", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff",
    "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff", "orange": "ffa500",
}
UNITS = {"": 1.0, "px": 1.0, "pt": 4 / 3, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_SKIPPED = frozenset("defs title desc metadata symbol".split())
_UNKNOWN = frozenset("use text style clipPath mask filter pattern linearGradient radialGradient foreignObject marker switch".split())
#: What a child takes over from its parent.
_INHERITED = ("fill", "stroke", "fill-opacity", "stroke-opacity", "fill-rule", "stroke-width", "color", "visibility")
_MOST = 1 << 28


def _numbers(text: str) -> list[float]:
    return [float(x) for x in _NUMBER.findall(text)]


def _length(text: str | None, default: float) -> float:
    if text is None or text.strip() in ("", "auto"):
        return default
    m = re.fullmatch(rf"\s*({_NUMBER.pattern})\s*([a-z%]*)\s*", text)
    if not m or m[2] not in UNITS and m[2] != "%":
        raise Corrupt(f"SVG 解析失败: {text}")
    return default * float(m[1]) / 100 if m[2] == "%" else float(m[1]) * UNITS[m[2]]


def _matrix(text: str | None) -> np.ndarray:
    """The product of a transform attribute's steps."""
    out = np.eye(3)
    for name, inner in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v, m = _numbers(inner), np.eye(3)
        if name == "matrix":
            m[0], m[1] = (v[0], v[2], v[4]), (v[1], v[3], v[5])
        elif name == "translate":
            m[0, 2], m[1, 2] = v[0], v[1] if len(v) > 1 else 0.0
        elif name == "scale":
            m[0, 0], m[1, 1] = v[0], v[-1]
        elif name == "rotate":
            a = math.radians(v[0])
            m[:2, :2] = ((math.cos(a), -math.sin(a)), (math.sin(a), math.cos(a)))
            if len(v) == 3:
                there = np.array(((1, 0, v[1]), (0, 1, v[2]), (0, 0, 1)), float)
                m = there @ m @ np.linalg.inv(there)
        elif name in ("skewX", "skewY"):
            m[(0, 1) if name == "skewX" else (1, 0)] = math.tan(math.radians(v[0]))
        else:
            raise Corrupt(f"SVG 解析失败: {name}")
        out = out @ m
    return out


def _color(text: str, current: str) -> tuple[float, float, float, float] | None:
    """(r, g, b, a) from 0 to 1; None for no paint."""
    text = text.strip().lower()
    if text == "currentcolor":
        text = current.strip().lower()
    if text in ("none", "transparent"):
        return None
    text = "#" + COLORS[text] if text in COLORS else text
    if re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", text):
        h = text[1:] if len(text) > 5 else "".join(x * 2 for x in text[1:])
        v = [int(h[i : i + 2], 16) / 255 for i in range(0, len(h), 2)]
        return v[0], v[1], v[2], v[3] if len(v) > 3 else 1.0
    if m := re.fullmatch(r"rgba?\(([^)]*)\)", text):
        parts = [x for x in re.split(r"[\s,/]+", m[1].strip()) if x]
        v = [float(x[:-1]) / 100 if x.endswith("%") else float(x) / (255 if i < 3 else 1) for i, x in enumerate(parts)]
        v = [min(1.0, max(0.0, x)) for x in v]
        return v[0], v[1], v[2], v[3] if len(v) > 3 else 1.0
    raise Unsupported(f"SVG {text}")


def _curve(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Points of a Bézier curve of any degree behind its first one."""
    p, out = np.array(points, float), []
    for k in range(1, STEPS + 1):
        q = p
        while len(q) > 1:
            q = q[:-1] + (q[1:] - q[:-1]) * (k / STEPS)
        out.append((float(q[0][0]), float(q[0][1])))
    return out


def _arc(start: tuple[float, float], rx: float, ry: float, turn: float, large: bool, sweep: bool, end: tuple[float, float]) -> list[tuple[float, float]]:
    """Points of an elliptical arc behind its first one, by the centre form of the public specification."""
    if not rx or not ry or start == end:
        return [end]
    rx, ry, a = abs(rx), abs(ry), math.radians(turn)
    c, s = math.cos(a), math.sin(a)
    dx, dy = (start[0] - end[0]) / 2, (start[1] - end[1]) / 2
    x, y = c * dx + s * dy, c * dy - s * dx
    if (over := (x / rx) ** 2 + (y / ry) ** 2) > 1:
        rx, ry = rx * math.sqrt(over), ry * math.sqrt(over)
    root = math.sqrt(max(0.0, ((rx * ry) ** 2 - (rx * y) ** 2 - (ry * x) ** 2) / ((rx * y) ** 2 + (ry * x) ** 2))) * (1 if large != sweep else -1)
    mx, my = root * rx * y / ry, -root * ry * x / rx
    ox, oy = c * mx - s * my + (start[0] + end[0]) / 2, s * mx + c * my + (start[1] + end[1]) / 2
    first, last = math.atan2((y - my) / ry, (x - mx) / rx), math.atan2((-y - my) / ry, (-x - mx) / rx)
    swept = (last - first) % (2 * math.pi) if sweep else -((first - last) % (2 * math.pi))
    n = max(2, math.ceil(abs(swept) / math.pi * STEPS))
    out = []
    for k in range(1, n + 1):
        t = first + swept * k / n
        u, v = rx * math.cos(t), ry * math.sin(t)
        out.append((ox + c * u - s * v, oy + s * u + c * v))
    return [*out[:-1], end]


def _path(d: str) -> list[tuple[list[tuple[float, float]], bool]]:
    """(points, closed) of each subpath."""
    out: list[tuple[list[tuple[float, float]], bool]] = []
    now, at, start, back, last = [], (0.0, 0.0), (0.0, 0.0), None, ""
    takes = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}

    def finish(closed: bool) -> None:
        nonlocal now
        if len(now) > 1:
            out.append((now, closed))
        now = []

    for command, rest in re.findall(r"([MmLlHhVvCcSsQqTtAaZz])([^MmLlHhVvCcSsQqTtAaZz]*)", d):
        kind, relative = command.upper(), command.islower()
        if kind == "A":  # flags may stand without separators
            v = []
            for m in re.finditer(rf"({_NUMBER.pattern})[\s,]*({_NUMBER.pattern})[\s,]*({_NUMBER.pattern})[\s,]*([01])[\s,]*([01])[\s,]*({_NUMBER.pattern})[\s,]*({_NUMBER.pattern})", rest):
                v += map(float, m.groups())
        else:
            v = _numbers(rest)
        n = takes[kind]
        for k in range(0, max(1, len(v)), max(1, n)):
            a = v[k : k + n]
            if len(a) < n:
                break
            ox, oy = at if relative else (0.0, 0.0)
            pair = lambda i, a=a, ox=ox, oy=oy: (a[i] + ox, a[i + 1] + oy)
            if kind == "Z":
                finish(True)
                at, back = start, None
                continue
            if kind == "M" and k == 0:
                finish(False)
                at = start = pair(0)
                now, back, last = [at], None, "M"
                continue
            now = now or [at]
            before, mirror = at, (2 * at[0] - back[0], 2 * at[1] - back[1]) if back else at
            back = None
            if kind in "ML":
                now.append(pair(0))
            elif kind == "H":
                now.append((a[0] + ox, at[1]))
            elif kind == "V":
                now.append((at[0], a[0] + oy))
            elif kind in "CS":
                c1 = pair(0) if kind == "C" else mirror if last in "CS" else at
                c2, end = (pair(2), pair(4)) if kind == "C" else (pair(0), pair(2))
                now += _curve([before, c1, c2, end])
                back = c2
            elif kind in "QT":
                c1 = pair(0) if kind == "Q" else mirror if last in "QT" else at
                now += _curve([before, c1, pair(2) if kind == "Q" else pair(0)])
                back = c1
            else:
                now += _arc(before, a[0], a[1], a[2], a[3] == 1, a[4] == 1, pair(5))
            at, last = now[-1], kind
    finish(False)
    return out


def _shape(tag: str, get: Callable[[str, float], float], e: ET.Element) -> list[tuple[list[tuple[float, float]], bool]]:
    if tag == "path":
        return _path(e.get("d", ""))
    if tag in ("polygon", "polyline"):
        v = _numbers(e.get("points", ""))
        return [(list(zip(v[::2], v[1::2], strict=False)), tag == "polygon")] if len(v) > 3 else []
    if tag == "line":
        return [([(get("x1", 0), get("y1", 0)), (get("x2", 0), get("y2", 0))], False)]
    if tag == "rect":
        x, y, w, h = get("x", 0), get("y", 0), get("width", 0), get("height", 0)
        if w <= 0 or h <= 0:
            return []
        rx, ry = get("rx", -1), get("ry", -1)
        rx, ry = min(w / 2, max(0.0, rx if rx >= 0 else ry)), min(h / 2, max(0.0, ry if ry >= 0 else rx))
        if not rx or not ry:
            return [([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], True)]
        out = []
        for (ax, ay), (bx, by) in (((x + w - rx, y), (x + w, y + ry)), ((x + w, y + h - ry), (x + w - rx, y + h)), ((x + rx, y + h), (x, y + h - ry)), ((x, y + ry), (x + rx, y))):
            out += [(ax, ay), *_arc((ax, ay), rx, ry, 0, False, True, (bx, by))]
        return [(out, True)]
    rx, ry = (get("r", 0),) * 2 if tag == "circle" else (get("rx", 0), get("ry", 0))
    if rx <= 0 or ry <= 0:
        return []
    turns = [2 * math.pi * k / (4 * STEPS) for k in range(4 * STEPS)]
    return [([(get("cx", 0) + rx * math.cos(t), get("cy", 0) + ry * math.sin(t)) for t in turns], True)]


def _outline(parts: list[tuple[list[tuple[float, float]], bool]], width: float) -> list[np.ndarray]:
    """A stroke as polygons of one direction: a quad for each segment, and mitred or cut joins between them."""
    out, r = [], width / 2

    def add(points: list[np.ndarray]) -> None:
        p = np.array(points)
        turned = np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))
        out.append(p if turned >= 0 else p[::-1])

    for points, closed in parts:
        p = np.array([points[0], *[b for a, b in zip(points, points[1:], strict=False) if a != b]], float)
        if closed and len(p) > 1 and tuple(p[0]) != tuple(p[-1]):
            p = np.vstack([p, p[:1]])
        if len(p) < 2:
            continue
        step = p[1:] - p[:-1]
        ahead = step / np.hypot(step[:, 0], step[:, 1])[:, None]
        side = np.stack([-ahead[:, 1], ahead[:, 0]], 1) * r
        for k in range(len(step)):
            add([p[k] + side[k], p[k + 1] + side[k], p[k + 1] - side[k], p[k] - side[k]])
        for k in range(len(step) if closed else len(step) - 1):
            j = (k + 1) % len(step)
            cross = ahead[k][0] * ahead[j][1] - ahead[k][1] * ahead[j][0]
            a, b, middle = (side[k], side[j], p[k + 1]) if cross < 0 else (-side[k], -side[j], p[k + 1])
            half = (a + b) / 2
            size = float(half @ half)
            # the miter is 1 / sin of half the angle; beyond four it is cut
            if size > 0 and r * r / size <= 16:
                add([middle, middle + a, middle + half * (r * r / size), middle + b])
            elif abs(cross) > 1e-9:
                add([middle, middle + a, middle + b])
    return out


def _coverage(polygons: list[np.ndarray], width: int, height: int, even_odd: bool) -> np.ndarray:
    out = np.zeros((height, width + 1))
    edges = [np.hstack([p, np.roll(p, -1, axis=0)]) for p in polygons if len(p) > 1]
    if not edges:
        return out[:, :width]
    e = np.vstack(edges)
    e = e[e[:, 1] != e[:, 3]]
    up = e[:, 1] > e[:, 3]
    sign = np.where(up, -1, 1)
    e[up] = e[up][:, [2, 3, 0, 1]]
    first, last = max(0, math.floor(e[:, 1].min(initial=height))), min(height, math.ceil(e[:, 3].max(initial=0)))
    for line in range(first * LINES, last * LINES):
        y = (line + 0.5) / LINES
        on = (e[:, 1] <= y) & (y < e[:, 3])
        if not on.any():
            continue
        a = e[on]
        x = a[:, 0] + (y - a[:, 1]) * (a[:, 2] - a[:, 0]) / (a[:, 3] - a[:, 1])
        order = np.argsort(x, kind="stable")
        x, wind = np.clip(x[order], 0, width), np.cumsum(sign[on][order])
        inside = (wind % 2 == 1) if even_odd else (wind != 0)
        row = out[line // LINES]
        for l, r in zip(x[:-1][inside[:-1]], x[1:][inside[:-1]], strict=True):  # noqa: E741
            i, j = int(l), int(r)
            if i == j:
                row[i] += r - l
            else:
                row[i] += i + 1 - l
                row[i + 1 : j] += 1
                row[j] += r - j
    return np.clip(out[:, :width] / LINES, 0, 1)


def decode(b: bytes, picture: Callable[[ET.Element], np.ndarray] | None = None) -> np.ndarray:
    """RGBA of a plain document; ``picture`` draws an image element when the document holds that alone."""
    if b"<!ENTITY" in b:
        raise Unsupported("SVG ENTITY")
    try:
        root = ET.fromstring(b)
    except ET.ParseError as e:
        raise Corrupt(f"SVG 解析失败: {e}") from e
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    if local(root) != "svg":
        raise Corrupt("SVG 解析失败: no svg element")
    drawn = [e for e in root.iter() if local(e) in ("image", *("rect circle ellipse line polyline polygon path").split())]
    if picture and len(drawn) == 1 and local(drawn[0]) == "image":
        return picture(drawn[0])
    box = _numbers(root.get("viewBox", ""))
    box = box if len(box) == 4 and box[2] > 0 and box[3] > 0 else None
    wide, high = (box[2], box[3]) if box else (100.0, 100.0)
    wide, high = _length(root.get("width"), wide), _length(root.get("height"), high)
    if wide <= 0 or high <= 0:
        raise Corrupt("SVG 解析失败: size")
    width, height = max(1, math.floor(wide + 0.5)), max(1, math.floor(high + 0.5))
    if width * height > _MOST:
        raise Unsupported(f"SVG {width}×{height}")
    view = np.eye(3)
    if box:
        sx, sy = wide / box[2], high / box[3]
        if root.get("preserveAspectRatio", "").strip() != "none":
            if root.get("preserveAspectRatio", "xMidYMid").split()[0] != "xMidYMid" or "slice" in root.get("preserveAspectRatio", ""):
                raise Unsupported("SVG preserveAspectRatio")
            sx = sy = min(sx, sy)
        view = np.array(((sx, 0, (wide - sx * box[2]) / 2 - sx * box[0]), (0, sy, (high - sy * box[3]) / 2 - sy * box[1]), (0, 0, 1)))
    canvas = np.zeros((height, width, 4))

    def paint(polygons: list[np.ndarray], matrix: np.ndarray, color: tuple[float, float, float, float] | None, alpha: float, even_odd: bool) -> None:
        if color is None or alpha <= 0:
            return
        moved = [p @ matrix[:2, :2].T + matrix[:2, 2] for p in polygons]
        a = (_coverage(moved, width, height, even_odd) * (color[3] * min(1.0, alpha)))[..., None]
        canvas[:] = np.concatenate([a * np.array(color[:3]), a], axis=2) + canvas * (1 - a)

    todo: list[tuple[ET.Element, dict[str, str], np.ndarray, float]] = [(root, {}, view, 1.0)]
    while todo:
        e, above, matrix, alpha = todo.pop()
        tag = local(e)
        if not tag or tag in _SKIPPED:
            continue
        own = dict(e.attrib)
        for part in own.pop("style", "").split(";"):
            name, colon, value = part.partition(":")
            if colon:
                own[name.strip()] = value.strip()
        if tag in _UNKNOWN or any(own.get(k, "none") != "none" for k in ("clip-path", "mask", "filter")) or tag == "image":
            raise Unsupported(f"SVG {tag}")
        style = above | {k: own[k] for k in _INHERITED if k in own and own[k] != "inherit"}
        if own.get("display") == "none":
            continue
        opacity = float(own.get("opacity", 1))
        if opacity < 1 and len(e):
            raise Unsupported("SVG group opacity")
        alpha *= opacity
        matrix = matrix @ _matrix(own.get("transform")) if e is not root else matrix
        todo += [(x, style, matrix, alpha) for x in reversed(e)]
        if tag in ("svg", "g", "a") or style.get("visibility", "visible") != "visible":
            if tag == "svg" and e is not root:
                raise Unsupported("SVG svg")
            continue
        if tag not in ("path", "polygon", "polyline", "line", "rect", "circle", "ellipse"):
            continue
        parts = _shape(tag, lambda k, d, e=e: _length(e.get(k), d) if e.get(k) is not None else d, e)
        current = style.get("color", "black")
        paint([np.array(p, float) for p, _ in parts if len(p) > 2], matrix, _color(style.get("fill", "black"), current), alpha * float(style.get("fill-opacity", 1)), style.get("fill-rule") == "evenodd")
        stroke, thick = _color(style.get("stroke", "none"), current), _length(style.get("stroke-width"), 1.0)
        if stroke and thick > 0:
            if any(own.get(k, d) != d for k, d in (("stroke-dasharray", "none"), ("stroke-linecap", "butt"), ("stroke-linejoin", "miter"))):
                raise Unsupported("SVG stroke")
            paint(_outline(parts, thick), matrix, stroke, alpha * float(style.get("stroke-opacity", 1)), False)
    full = np.floor(canvas * 255 + 0.5).astype(np.int64)
    a = full[..., 3:]
    straight = np.where(a == 0, 0, (full[..., :3] * 255 + a // 2) // np.maximum(a, 1))
    return np.concatenate([np.minimum(straight, 255), a], axis=2).astype(np.uint8)
