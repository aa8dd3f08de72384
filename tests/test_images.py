import base64
import gzip
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterflow.functions.formats import REGISTRY
from rasterflow.functions.options import Downscale, EncodeOptions, TransformOptions
from rasterflow.operators import raster as R
from rasterflow.sources import codecs
from rasterflow.sources.codecs import gif, jpeg, png, simple, webp

LOSSLESS = [f for f in REGISTRY if f not in ("gif", "jpeg")]
images = st.tuples(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 2**32 - 1), st.booleans()).map(lambda a: (np.random.default_rng(a[3]).integers(0, 2 if a[4] else 256, a[:3]) * (255 if a[4] else 1)).astype(np.uint8))


@settings(max_examples=60, deadline=None)
@given(images, st.sampled_from(LOSSLESS))
def test_lossless_round_trip(image, name):
    data = codecs.encode(image, name)
    back = codecs.decode_as(data, name)
    want = R.to_color(image, R.color_type(back))
    assert back.shape == want.shape and (back == want).all()
    assert R.has_semi_transparent(back) == R.has_semi_transparent(image)
    assert codecs.detect(data) == (None if name == "tga" else name)


@pytest.mark.parametrize("name", REGISTRY)
def test_every_format_from_the_gradient(name):
    image = R.gradient(37, 23)
    back = R.to_color(codecs.decode_as(codecs.encode(image, name), name), "Rgb8")
    error = R.mean_error(back, image)
    assert back.shape == image.shape and (error <= 20 if name in ("gif", "jpeg") else error == 0)


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(REGISTRY), st.integers(0, 2**32 - 1), st.integers(0, 60))
def test_damaged_bytes_never_crash(name, seed, cut):
    rng = np.random.default_rng(seed)
    data = bytearray(codecs.encode(R.gradient(9, 7), name))
    for _ in range(3):
        data[rng.integers(len(data))] = rng.integers(256)
    try:
        codecs.decode_as(bytes(data[: max(1, len(data) - cut)]), name)
    except codecs.CodecError:
        pass


def test_identification_order():
    image = R.gradient(6, 4)
    assert codecs.identify("/a/x.bmp", codecs.encode(image, "qoi"))[1] == "qoi"
    assert codecs.identify("/a/x", codecs.encode(image, "tga"))[1] == "tga"
    assert codecs.identify("/a/X.TGA", codecs.encode(image, "tga"))[1] == "tga"
    for data, kind, part in ((b"", "Corrupt", "文件内容为空"), (b"not an image at all", "Corrupt", "按扩展名「BMP 位图」解析失败"), (b"GIF89a\1\0\1\0", "Corrupt", "按文件头识别为 GIF 图像 后解析失败")):
        with pytest.raises(codecs.CodecError) as e:
            codecs.identify("/a/broken.bmp", data)
        assert e.value.kind == kind and part in str(e.value)
    with pytest.raises(codecs.UnknownFormat):
        codecs.identify("/a/x.txt", bytes(64))
    with pytest.raises(codecs.UnsupportedFormat):
        codecs.decode_as(b"x", "heic")
    with pytest.raises(codecs.Unsupported):
        codecs.check("heic", (*REGISTRY, "heic"))
    assert codecs.detect(codecs.encode(image, "png"), ("bmp",)) is None


def test_svg_sniffing_and_containers():
    yes = [b"<svg/>", b"\n\t <svg>", b"<?xml version='1.0'?><svg>", gzip.compress(b"<?xml?><svg>")]
    no = [b"<?xml?><a>", b"<!-- c --><svg>", b"<svg" + b"x" * 1019 + "é".encode(), gzip.compress(b"<a>" + b" " * 600 + b"<svg>"), b""]
    assert all(map(codecs.is_svg, yes)) and not any(map(codecs.is_svg, no))
    image = R.gradient(5, 4)
    data = codecs.encode(image, "svg")
    assert b'width="5" height="4" viewBox="0 0 5 4"' in data and b"\n" not in data.split(b"base64,")[1].split(b'"')[0]
    assert (codecs.decode_as(gzip.compress(data), "svg")[..., :3] == image).all()
    assert codecs.decode_as(b"<svg><rect/></svg>", "svg").shape == (100, 100, 4)


def drawn(inside, attributes='width="8" height="6"'):
    return codecs.decode_as(f'<?xml version="1.0"?><!DOCTYPE svg><svg xmlns="http://www.w3.org/2000/svg" {attributes}>{inside}</svg>'.encode(), "svg")


def test_svg_shapes_by_pixel():
    red, blue, none = [255, 0, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    image = drawn('<g fill="red"><rect x="1" y="2" width="3" height="2"/><rect x="3" y="3" width="4" height="2" style="fill: #00f"/></g>')
    want = np.zeros((6, 8, 4), np.uint8)
    want[2:4, 1:4], want[3:5, 3:7] = red, blue
    assert (image == want).all()
    same = [
        '<polygon points="1,2 4,2 4,4 1,4" fill="rgb(255,0,0)"/>', '<path d="M1 2h3v2h-3z" fill="#f00"/>', '<path d="m1,2 3,0 0,2 -3,0" fill="rgb(100%,0%,0%)"/>',
        '<g transform="translate(1 2)"><rect width="6" height="4" transform="scale(.5)" fill="red"/></g>', '<rect x="-4" y="-4" width="3" height="2" fill="red" transform="rotate(180)"/>',
        '<line x1="1" y1="3" x2="4" y2="3" stroke="red" stroke-width="2"/>', '<path d="M1 2L1 2L4 2V4H1Z M9 9" fill="currentColor" color="red"/>', '<path fill="red" d="M2.5 3m0-1h-1.5v2h3v-2z"/>',
    ]
    want[3:5, 3:7] = none
    want[2:4, 1:4] = red
    for x in same:
        assert (drawn(x) == want).all(), x
    assert (drawn('<rect x="10" y="20" width="30" height="20" fill="red"/>', 'width="8" height="6" viewBox="0 0 80 60"') == want).all()
    half = drawn('<rect width="8" height="6" fill="red"/><rect width="8" height="6" fill="blue" fill-opacity=".5"/>')
    assert (half == [127, 0, 128, 255]).all() or (half == [128, 0, 128, 255]).all()
    assert drawn('<rect x="0.5" width="1" height="1"/>')[0, :3, 3].tolist() == [128, 128, 0]
    ring = drawn('<path fill-rule="evenodd" d="M0 0h8v6h-8zM2 2h4v2h-4z"/>')
    assert (ring[2:4, 2:6, 3] == 0).all() and (ring[..., 3] > 0).sum() == 40


def test_svg_round_shapes_by_area():
    area = lambda x: drawn(x, 'width="100" height="100"')[..., 3].astype(float).sum() / 255
    assert abs(area('<circle cx="50" cy="50" r="40"/>') - np.pi * 1600) < 12
    assert abs(area('<ellipse cx="50" cy="50" rx="40" ry="20" transform="rotate(30 50 50)"/>') - np.pi * 800) < 8
    assert abs(area('<path d="M10 50A40 40 0 1 0 90 50A40 40 0 1010 50z"/>') - np.pi * 1600) < 12
    assert abs(area('<path d="M10 90Q50 10 90 90T90 90z"/>') - 2 / 3 * 80 * 80 / 2) < 8
    assert abs(area('<path d="M10 10C10 90 90 90 90 10z"/>') - 0.6 * 80 * 80) < 400
    assert abs(area('<circle cx="50" cy="50" r="40" fill="none" stroke="lime" stroke-width="4"/>') - np.pi * (42**2 - 38**2)) < 8
    assert abs(area('<rect x="10" y="10" width="80" height="60" rx="10"/>') - (4800 - 400 + np.pi * 100)) < 4
    assert abs(area('<rect x="20" y="20" width="60" height="60" fill="none" stroke="#000" stroke-width="10"/>') - (70**2 - 50**2)) < 1


@pytest.mark.parametrize("inside", ['<rect width="9" height="9" fill="url(#a)"/>', "<text>x</text>", '<rect clip-path="url(#a)" width="1" height="1"/>', '<use href="#a"/>', '<line x2="9" stroke="red" stroke-dasharray="1 2"/>', '<g opacity=".5"><rect width="1" height="1"/></g>'])
def test_svg_that_is_not_drawn(inside):
    with pytest.raises(codecs.Unsupported):
        drawn(inside)


def test_svg_that_is_broken():
    for b in (b"<svg", b"<?xml?><svg/>", b"<svg><g></svg>", b'<svg width="x"/>', b"<a><svg/></a>", b'<svg width="0" height="1"/>'):
        with pytest.raises(codecs.CodecError):
            codecs.decode_as(b, "svg")


def test_eight_bit_buffers():
    assert R.is_eight_bit(np.zeros((2, 3, 4), np.uint8)) and not R.is_eight_bit(np.zeros((2, 3, 3), np.uint16)) and not R.is_eight_bit(np.zeros((2, 3), np.uint8))


def test_png_layouts():
    def make(width, height, depth, color, rows, extra=b"", interlaced=0):
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    assert png.decode(make(8, 1, 1, 0, b"\0\xa5"))[0, :, 0].tolist() == [255, 0, 255, 0, 0, 255, 0, 255]
    assert png.decode(make(2, 1, 16, 0, b"\0\xff\xff\x80\x7f"))[0, :, 0].tolist() == [255, 128]
    plte = struct.pack(">I", 6) + b"PLTE\1\2\3\4\5\6" + struct.pack(">I", zlib.crc32(b"PLTE\1\2\3\4\5\6"))
    assert png.decode(make(2, 1, 8, 3, b"\0\1\0", plte)).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    image = R.gradient(11, 9)
    passes = b""
    for x, y, dx, dy in png._PASSES:
        part = image[y::dy, x::dx]
        passes += b"".join(b"\0" + row.tobytes() for row in part) if part.size else b""
    assert (png.decode(make(11, 9, 8, 2, passes, interlaced=1)) == image).all()
    for level in range(10):
        for fast in (True, False):
            assert (png.decode(png.encode(image, level, fast)) == image).all()


def test_bmp_and_tga_variants():
    head = lambda bits, comp, size, colors: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 4 * colors) + struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, bits, comp, size, 0, 0, colors, 0)
    palette = bytes([0, 0, 0, 0, 3, 2, 1, 0])
    assert simple.decode_bmp(head(8, 1, 0, 2) + palette + bytes([4, 1, 0, 0, 2, 0, 2, 1, 0, 1]))[:, :, 0].tolist() == [[0, 0, 1, 1], [1, 1, 1, 1]]
    assert simple.decode_bmp(head(1, 0, 0, 2) + palette + bytes([0x50, 0, 0, 0, 0xF0, 0, 0, 0]))[:, :, 0].tolist() == [[1, 1, 1, 1], [0, 1, 0, 1]]
    assert simple.decode_bmp(head(16, 0, 0, 0) + struct.pack("<8H", *[0x7C00] * 8)).tolist() == [[[255, 0, 0]] * 4] * 2
    tga = struct.pack("<BBBHHBHHHHBB", 0, 1, 1, 0, 2, 24, 0, 0, 2, 1, 8, 32) + bytes([9, 8, 7, 3, 2, 1]) + b"\1\0"
    assert simple.decode_tga(tga).tolist() == [[[1, 2, 3], [7, 8, 9]]]
    assert simple.decode_netpbm(b"P1 # c\n3 1\n1 0 1").reshape(-1).tolist() == [0, 255, 0]
    assert simple.decode_netpbm(b"P3\n1 1\n15\n15 0 5\n").reshape(-1).tolist() == [255, 0, 85]


def test_progressive_like_scans_and_quality():
    image = R.gradient(40, 24)
    errors = [R.mean_error(jpeg.decode(jpeg.encode(image, q)), image) for q in (10, 50, 90, 100)]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.5
    assert len(jpeg.encode(image, 20)) < len(jpeg.encode(image, 95))


def test_webp_is_small_and_gif_keeps_alpha():
    big = R.gradient(1000, 800)
    assert len(webp.encode(R.downscale(big, Downscale("Scale50")))) * 10 < len(simple.encode_bmp(big))
    with pytest.raises(codecs.Unsupported):
        codecs.decode_as(b"RIFF\x20\0\0\0WEBPVP8 \x08\0\0\0" + bytes(8), "webp")
    rgba = np.dstack([R.gradient(8, 8), np.where(np.arange(64).reshape(8, 8) % 2, 255, 0)]).astype(np.uint8)
    back = gif.decode(gif.encode(rgba))
    assert (back[..., 3] == rgba[..., 3]).all() and (back[back[..., 3] > 0][:, :3] == rgba[rgba[..., 3] > 0][:, :3]).all()


def test_transforms():
    image = np.zeros((2, 4, 4), np.uint8)
    image[:, :2], image[:, 2:] = (255, 0, 0, 255), (0, 0, 255, 255)
    turned = R.transform(image, TransformOptions(rotate="Deg90"))
    assert turned.shape == (4, 2, 4) and turned[0, 0].tolist() == [255, 0, 0, 255]
    assert (R.transform(image, TransformOptions(flip_horizontal=True))[0, 0] == [0, 0, 255, 255]).all()
    assert R.transform(image, TransformOptions()) is image
    assert R.resize(image, (0, 5)) is image and R.resize(image, None) is image and R.resize(image, (4, 2)) is image
    with pytest.raises(R.TooLarge):
        R.resize(image, (1 << 16, 1 << 15))
    assert R.resize(image, (2, 1), "Nearest")[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255]]
    assert R.resize(image, (2, 1))[0, 0].tolist()[3] == 255
    gray = R.transform(image, TransformOptions(grayscale=True))
    assert gray.shape == (2, 4, 2) and gray[0, 0].tolist() == [54, 255]
    assert R.transform(image, TransformOptions(grayscale=True, color="Rgb8"))[0, 0].tolist() == [54, 54, 54]
    order = R.transform(image, TransformOptions(resize=(1, 2), resize_mode="Nearest", rotate="Deg90", flip_vertical=True))
    assert order[:, 0, 2].tolist() == [255, 0]
    half = np.array([[[64, 0, 32, 128], [9, 9, 9, 0], [5, 6, 7, 255]]], np.uint8)
    assert R.unpremultiply(half).tolist() == [[[128, 0, 64, 128], [0, 0, 0, 0], [5, 6, 7, 255]]]
    assert R.demote(np.array([[[0], [128], [65535]]], np.uint16)).reshape(-1).tolist() == [0, 0, 255]
    assert png.settings(EncodeOptions().png_compression_level, True) == ("Fast", "Sub")
    assert base64.b64encode(b"a") == b"YQ=="
