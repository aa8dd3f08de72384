"""Codecs against the JVM's own image library, both ways."""

import numpy as np
import pytest

from rasterflow.operators import raster as R
from rasterflow.sources.codecs import decode_as, encode


def image(kind):
    rng = np.random.default_rng(3)
    base = R.gradient(61, 45)
    if kind == "rgb":
        return base
    if kind == "gray":
        return R.to_color(base, "Gray8")
    if kind == "noisy":
        return np.clip(base.astype(int) + rng.integers(-30, 30, base.shape), 0, 255).astype(np.uint8)
    return np.dstack([base, rng.integers(0, 256, base.shape[:2])]).astype(np.uint8)


def to_jvm(spark, data):
    jvm = spark.sparkContext._jvm
    return jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))


def pixels(jvm_image, alpha=False):
    w, h = jvm_image.getWidth(), jvm_image.getHeight()
    argb = np.array(list(jvm_image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    parts = [argb >> 16 & 255, argb >> 8 & 255, argb & 255] + ([argb >> 24 & 255] if alpha else [])
    return np.stack(parts, axis=2).astype(np.uint8)


def written(spark, jvm_image, name, progressive=False, quality=0.9):
    jvm = spark.sparkContext._jvm
    out = jvm.java.io.ByteArrayOutputStream()
    if name != "jpeg":
        assert jvm.javax.imageio.ImageIO.write(jvm_image, name, out)
        return bytes(out.toByteArray())
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1 if progressive else 0)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(jvm_image, None, None), param)
    writer.getOutput().flush()
    writer.dispose()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("kind", ["rgb", "gray", "alpha", "noisy"])
def test_png_both_ways(spark, kind):
    mine = image(kind)
    alpha = kind == "alpha"
    for level, fast in ((0, True), (3, False), (9, False)):
        from rasterflow.functions.options import EncodeOptions

        seen = pixels(to_jvm(spark, encode(mine, "png", EncodeOptions(90, level, fast))), alpha)
        if kind != "gray":
            assert (seen == mine).all()
    back = decode_as(written(spark, to_jvm(spark, encode(mine, "png")), "png"), "png")
    assert (R.to_color(back, R.color_type(mine)) == mine).all()


@pytest.mark.parametrize("name", ["bmp", "gif"])
def test_bmp_and_gif_both_ways(spark, name):
    mine = image("rgb")
    theirs = to_jvm(spark, encode(mine, "png"))
    data = written(spark, theirs, name)
    assert (R.to_color(decode_as(data, name), "Rgb8") == pixels(to_jvm(spark, data))).all()
    mine_data = encode(mine, name)
    assert (pixels(to_jvm(spark, mine_data)) == R.to_color(decode_as(mine_data, name), "Rgb8")).all()


@pytest.mark.parametrize("kind", ["rgb", "gray", "noisy"])
@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_both_ways(spark, kind, progressive):
    mine = image(kind)
    data = written(spark, to_jvm(spark, encode(mine, "png")), "jpeg", progressive, 0.6)
    assert (b"\xff\xc2" in data) == progressive
    ours, theirs = decode_as(data, "jpeg"), pixels(to_jvm(spark, data))
    if kind == "gray":
        # gray passes through the JVM's linear colour space on its way to RGB
        assert ours.shape[2] == 1 and R.mean_error(ours, mine) < 4
        return
    # the JVM smooths halved colour planes when it doubles them
    assert R.mean_error(ours, theirs) < 3.5
    seen = pixels(to_jvm(spark, encode(mine, "jpeg")))
    assert R.mean_error(seen, decode_as(encode(mine, "jpeg"), "jpeg")) < 1
