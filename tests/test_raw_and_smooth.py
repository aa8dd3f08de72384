import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.operators import pixels, raster, rawfiles
from rasterflow.sources import codecs
from rasterflow.sources.codecs import simple


def buffer(rows, channels):
    """A pixel table's rows as an image."""
    w, h = rows[0]["w"], rows[0]["h"]
    out = np.full((h, w, channels), -1)
    for r in rows:
        out[r["y"], r["x"]] = [r[f"c{k}"] for k in range(channels)]
    return out


def by_key(rows, key="name"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def files():
    rnd = np.random.default_rng(3)
    rgb, rgba, gray, ga = (rnd.integers(0, 256, (5, 7, n)).astype(np.uint8) for n in (3, 4, 1, 2))
    out = {"24.bmp": simple.encode_bmp(rgb), "32.bmp": simple.encode_bmp(rgba), "8.bmp": simple.encode_bmp(gray), "rgb.ppm": simple.encode_netpbm(rgb), "gray.pgm": simple.encode_netpbm(gray), "ga.pam": simple.encode_netpbm(ga), "rgba.pam": simple.encode_netpbm(rgba), "x.ff": simple.encode_farbfeld(rgba)}
    b = bytearray(out["24.bmp"])
    b[22:26] = (-5).to_bytes(4, "little", signed=True)
    out["down.bmp"] = bytes(b)
    out["comment.ppm"] = b"P6 # a\n#b 9 9\n 7\t5\n100\n" + (rgb % 101).tobytes()
    out["wide.pgm"] = b"P5\n7 5\n65535\n" + rnd.integers(0, 65536, 35).astype(">u2").tobytes()
    out["odd.pgm"] = b"P5\n7 5\n1000\n" + rnd.integers(0, 1001, 35).astype(">u2").tobytes()
    out["wide.pam"] = b"P7\nWIDTH 7\nHEIGHT 5\nDEPTH 4\nMAXVAL 65535\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + rnd.integers(0, 65536, 140).astype(">u2").tobytes()
    out["wide.ff"] = b"farbfeld" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + rnd.integers(0, 65536, 140).astype(">u2").tobytes()
    return out


def test_raw_files_decode_as_the_codecs_do(spark):
    made = files()
    rows = spark.createDataFrame([(n, bytearray(b), 1, "a") for n, b in made.items()], "name string, content binary, x int, head string")
    found = by_key(rawfiles.pixels(rows).collect())
    for name, b in made.items():
        want = codecs.decode(b)
        assert (buffer(found[name], want.shape[2]) == want).all(), name
        assert all(r[f"c{k}"] is None for r in found[name] for k in range(want.shape[2], 4)), name
    plan = rawfiles.pixels(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_damaged_raw_files_keep_a_reason(spark):
    rnd, made, rows = random.Random(4), files(), [("null", None), ("empty", b""), ("png", codecs.encode(raster.gradient(3, 3), "png")), ("zero.ppm", b"P6 0 5 255 "), ("vast.ff", b"farbfeld" + b"\xff" * 8)]
    for name, b in made.items():
        rows += [(f"{name}{k}", b[: rnd.randrange(len(b) - 1)]) for k in range(6)]
        for k in range(6):
            bad = bytearray(b)
            for _ in range(3):
                bad[rnd.randrange(min(50, len(bad)))] = rnd.randrange(256)
            rows.append((f"{name}m{k}", bytes(bad)))
    df = spark.createDataFrame(rows, "name string, content binary")
    errors = {r["name"]: r["error"] for r in rawfiles.headers(df).select("name", "head.error").collect()}
    found, data = by_key(rawfiles.pixels(df).collect()), dict(rows)
    assert set(found) == {n for n, e in errors.items() if e is None} and all(errors[n] for n, _ in rows[:5])
    for name in made:
        for k in range(6):
            try:
                codecs.decode(data[f"{name}{k}"])
                assert errors[f"{name}{k}"] is None  # only the padding of the last row was cut
            except codecs.CodecError:
                assert errors[f"{name}{k}"]
    agreed = 0
    for name, rows_ in found.items():
        try:
            want = codecs.decode(data[name])
        except codecs.CodecError:
            continue  # a sample above its file's greatest: the codec refuses, here it counts as that
        assert (buffer(rows_, want.shape[2]) == want).all(), name
        agreed += 1
    assert agreed > 10


@pytest.mark.parametrize("kind", ["bmp", "netpbm", "farbfeld"])
def test_written_raw_files_are_read_by_the_codecs(spark, kind):
    sizes = [(i, w, h) for i, (w, h) in enumerate([(1, 1), (2, 3), (5, 4), (7, 9), (16, 2)])]
    got = rawfiles.encoded(pixels.gradient(spark.createDataFrame(sizes, "asset_id int, w int, h int")), kind).collect()
    assert len(got) == 5
    for r in got:
        _, w, h = sizes[r["asset_id"]]
        image = codecs.decode(bytes(r["content"]))
        assert (image[..., :3] == raster.gradient(w, h)).all() and codecs.detect(bytes(r["content"])) == kind


@pytest.mark.parametrize(("size", "to"), [((8, 8), (5, 3)), ((7, 5), (3, 9)), ((9, 4), (9, 4)), ((3, 3), (1, 1)), ((1, 1), (4, 5)), ((16, 6), (4, 12)), ((5, 5), (5, 2))])
def test_smooth_resizing_equals_the_buffers(spark, size, to):
    """Apart from fractions of exactly one half, which sums of 32 bits may put on either side."""
    rnd = np.random.default_rng(size[0] * 31 + to[1])
    image = rnd.integers(0, 256, (size[1], size[0], 2)).astype(np.uint8)
    rows = [(1, size[0], size[1], y, x, int(image[y, x, 0]), int(image[y, x, 1])) for y in range(size[1]) for x in range(size[0])]
    px = spark.createDataFrame(rows, "asset_id int, w int, h int, y int, x int, c0 int, c1 int").repartition(3)
    got = buffer(pixels.resize_bilinear(px, *to).collect(), 2)
    want = raster.resize(image, to).astype(int)
    weight = lambda s, t: np.array([[max(0, 2 * max(s, t) - abs((2 * j + 1) * t - (2 * i + 1) * s)) for j in range(s)] for i in range(t)])
    v, u = weight(size[1], to[1]), weight(size[0], to[0])
    up, down = np.einsum("iy,jx,yxc->ijc", v, u, image.astype(int)), (v.sum(axis=1)[:, None] * u.sum(axis=1)[None, :])[..., None]
    assert (got == (2 * up + down) // (2 * down)).all()
    half = 2 * up % (2 * down) == down
    assert (got == want)[~half].all() and (abs(got - want) <= 1).all()


def test_each_image_has_its_own_size(spark):
    px = pixels.gradient(spark.createDataFrame([(1, 6, 4), (2, 5, 5), (3, 2, 2), (4, 8, 2)], "asset_id int, w int, h int"))
    wide = F.when(F.col("asset_id") == 1, 3).when(F.col("asset_id") == 4, 0)
    found = by_key(pixels.resize_bilinear(px, wide, F.when(F.col("asset_id") == 1, 2)).collect(), "asset_id")
    assert {k: (r[0]["w"], r[0]["h"]) for k, r in found.items()} == {1: (3, 2), 2: (5, 5), 3: (2, 2), 4: (8, 2)}
    assert (buffer(found[2], 3) == raster.gradient(5, 5)).all() and (buffer(found[1], 3) == raster.resize(raster.gradient(6, 4), (3, 2))).all()
    small = by_key(pixels.downscale(px, F.lit("Scale50"), F.lit(1)).collect(), "asset_id")
    assert (small[4][0]["w"], small[4][0]["h"]) == (4, 1) and (small[2][0]["w"], small[2][0]["h"]) == (3, 3)
    assert pixels.resize_bilinear(px.limit(0), 3, 3).count() == 0


def test_one_projection_equals_the_steps_and_the_buffers(spark):
    """All rotations and flips, with and without a size, larger and smaller."""
    from rasterflow.functions.options import TransformOptions

    w, h = 5, 3
    image = np.arange(w * h, dtype=np.uint8).reshape(h, w, 1)
    px = spark.createDataFrame([(1, w, h, y, x, int(image[y, x, 0])) for y in range(h) for x in range(w)], "asset_id int, w int, h int, y int, x int, c0 int")
    made, wants = None, {}
    for angle in ("None", "Deg90", "Deg180", "Deg270"):
        for horizontal in (False, True):
            for vertical in (False, True):
                for size in (None, (2, 7), (9, 2), (5, 5)):
                    name = f"{angle} {horizontal} {vertical} {size}"
                    wants[name] = raster.transform(image, TransformOptions(size, "Nearest", False, horizontal, vertical, angle)).astype(int)
                    out = pixels.placed(px, angle, horizontal, vertical, *(size or (None, None))).select(F.lit(name).alias("name"), "w", "h", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "c0")
                    made = out if made is None else made.unionByName(out)
    found = by_key(made.collect())
    assert len(found) == 64
    for name, want in wants.items():
        assert len(found[name]) == want.size and (buffer(found[name], 1) == want).all(), name
    plan = pixels.placed(px, "Deg90", True, False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1
