"""Operators on image buffers: numpy arrays of height x width x channels, 8 bits each.

The order of a transform is fixed: rotate, flip sideways, flip upside down, resize, gray,
colour layout. Formulas of resampling, luma and depth follow the public descriptions of
the common image library; they are not confirmed against another program's output.
"""

from __future__ import annotations

import numpy as np

from ..functions.options import Downscale, TransformOptions
from ..functions.scalars import MAX_PIXELS

#: Weights of red, green and blue in ten thousandths.
LUMA = (2126, 7152, 722)
CHANNELS = {"Gray8": 1, "GrayAlpha8": 2, "Rgb8": 3, "Rgba8": 4}
COLORS = {n: c for c, n in CHANNELS.items()}


class TooLarge(ValueError):
    pass


def color_type(image: np.ndarray) -> str:
    return COLORS[image.shape[2]]


def is_eight_bit(image: np.ndarray) -> bool:
    """One to four channels of 8 bits, as every step behind decoding expects."""
    return image.dtype == np.uint8 and image.ndim == 3 and image.shape[2] in COLORS


def demote(image: np.ndarray) -> np.ndarray:
    """16-bit samples to 8 bits, rounded; 8-bit images stay."""
    return image if image.dtype == np.uint8 else ((image.astype(np.uint32) + 128) // 257).astype(np.uint8)


def luma(rgb: np.ndarray) -> np.ndarray:
    """One channel from three."""
    r, g, b = (rgb[..., i].astype(np.uint32) for i in range(3))
    return ((LUMA[0] * r + LUMA[1] * g + LUMA[2] * b) // 10000).astype(np.uint8)[..., None]


def to_color(image: np.ndarray, color: str) -> np.ndarray:
    n, have = CHANNELS[color], image.shape[2]
    if n == have:
        return image
    alpha = image[..., -1:] if have in (2, 4) else np.full((*image.shape[:2], 1), 255, np.uint8)
    base = image[..., : have - (have in (2, 4))]
    if n <= 2 and base.shape[2] == 3:
        base = luma(base)
    elif n >= 3 and base.shape[2] == 1:
        base = np.repeat(base, 3, axis=2)
    return np.ascontiguousarray(np.concatenate([base, alpha], axis=2) if n in (2, 4) else base)


def to_gray(image: np.ndarray) -> np.ndarray:
    """Gray, with alpha where there was one."""
    return to_color(image, "GrayAlpha8" if image.shape[2] in (2, 4) else "Gray8")


def has_semi_transparent(image: np.ndarray) -> bool:
    if image.shape[2] not in (2, 4):
        return False
    alpha = image[..., -1]
    return bool(((alpha != 0) & (alpha != 255)).any())


def rotate(image: np.ndarray, angle: str) -> np.ndarray:
    """Clockwise by None, Deg90, Deg180 or Deg270."""
    return np.ascontiguousarray(np.rot90(image, {"None": 0, "Deg90": -1, "Deg180": 2, "Deg270": 1}[angle]))


def _nearest(size: int, to: int) -> np.ndarray:
    return np.minimum(size - 1, np.floor((np.arange(to) + 0.5) * (size / to)).astype(np.int64))


def _triangle(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(source places, weights) for each target place; the kernel widens when shrinking."""
    ratio = size / to
    wide = max(ratio, 1.0)
    middle = (np.arange(to) + 0.5) * ratio
    left = np.clip(np.floor(middle - wide), 0, size - 1).astype(np.int64)
    right = np.clip(np.ceil(middle + wide), left + 1, size).astype(np.int64)
    span = int((right - left).max())
    at = left[:, None] + np.arange(span)
    weight = np.clip(1.0 - np.abs((at - (middle[:, None] - 0.5)) / wide), 0.0, None)
    weight[at >= right[:, None]] = 0.0
    weight /= weight.sum(axis=1, keepdims=True)
    return np.minimum(at, size - 1), weight.astype(np.float32)


def resize(image: np.ndarray, size: tuple[int, int] | None, mode: str = "Bilinear") -> np.ndarray:
    """To (width, height); unchanged for no size, a zero side or the same size. Too large raises."""
    if size is None or 0 in size or (image.shape[1], image.shape[0]) == tuple(size):
        return image
    width, height = size
    if width * height > MAX_PIXELS:
        raise TooLarge(f"缩放目标 {width}×{height} 过大,请缩小尺寸")
    if mode == "Nearest":
        return np.ascontiguousarray(image[_nearest(image.shape[0], height)][:, _nearest(image.shape[1], width)])
    at, weight = _triangle(image.shape[0], height)
    out = np.zeros((height, *image.shape[1:]), np.float32)
    for k in range(at.shape[1]):
        out += image[at[:, k]] * weight[:, k, None, None]
    at, weight = _triangle(image.shape[1], width)
    wide = np.zeros((height, width, image.shape[2]), np.float32)
    for k in range(at.shape[1]):
        wide += out[:, at[:, k]] * weight[None, :, k, None]
    return np.clip(np.floor(wide + np.float32(0.5)), 0, 255).astype(np.uint8)


def downscale(image: np.ndarray, limit: Downscale) -> np.ndarray:
    """By a limit, always smooth."""
    return resize(image, limit.target_size(image.shape[1], image.shape[0]))


def transform(image: np.ndarray, options: TransformOptions) -> np.ndarray:
    if options.is_identity:
        return image
    image = rotate(image, options.rotate)
    if options.flip_horizontal:
        image = image[:, ::-1]
    if options.flip_vertical:
        image = image[::-1]
    image = resize(np.ascontiguousarray(image), options.resize, options.resize_mode)
    if options.grayscale:
        image = to_gray(image)
    return to_color(image, options.color) if options.color else image


def unpremultiply(image: np.ndarray) -> np.ndarray:
    """Straight alpha from premultiplied; nothing where alpha is 0."""
    a = image[..., 3:].astype(np.uint32)
    straight = (image[..., :3].astype(np.uint32) * 255 + a // 2) // np.maximum(a, 1)
    return np.concatenate([np.where(a == 0, 0, straight).astype(np.uint8), image[..., 3:]], axis=2)


def mean_error(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of the samples of two images of one shape."""
    return float(np.abs(a.astype(np.int32) - b.astype(np.int32)).mean())


def gradient(width: int, height: int) -> np.ndarray:
    """A test image: red runs sideways, green downwards, blue along the diagonal."""
    x, y = np.arange(width)[None, :], np.arange(height)[:, None]
    planes = (x * 255 // max(width, 1) + 0 * y, y * 255 // max(height, 1) + 0 * x, (x + y) * 255 // max(width + height, 1))
    return np.stack(planes, axis=2).astype(np.uint8)
