"""Uncompressed image files to pixel tables and back, in the JVM: header parsing and byte offsets as column expressions.

Read are BMP of 8 (palette), 24 and 32 bits in rows either way up, binary Netpbm (P5, P6 and P7) of 8 and 16 bits, and
farbfeld. Anything else, and whatever is damaged, keeps its row with a reason in ``error``; the codecs read the
rest. A pixel is a copy of its own few bytes, so a file's cost is that of its pixels, whatever its size, and both
explodes run inside one stage of generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAX_PIXELS

C = F.col
KINDS = ("bmp", "netpbm", "farbfeld")
#: Bytes in which the header of a Netpbm file has to end here.
HEADER = 4096
_GAP = r"(?:\s|#[^\n]*\n)+"
_PNM = rf"^P[56]{_GAP}(\d{{1,9}}){_GAP}(\d{{1,9}}){_GAP}(\d{{1,5}})\s"
_PAM = r"(?s)^P7\n.*?ENDHDR\n"


def _number(b: Column) -> Column:
    """Up to 8 bytes, the most significant first, as a long; the first of 8 holds the sign."""
    return F.conv(F.hex(b), 16, -10).cast("long")


def _big(content: Column, at: Column | int, n: int) -> Column:
    return _number(F.substring(content, F.lit(at + 1) if isinstance(at, int) else at + 1, F.lit(n)))


def _little(content: Column, at: int, n: int) -> Column:
    return sum((F.shiftleft(_big(content, at + i, 1), 8 * i) for i in range(1, n)), _big(content, at, 1))


def _signed(v: Column) -> Column:
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def header(content: Column) -> Column:
    """struct(kind, w, h, offset, stride, step, channels, wide, top, bgr, up, palette, error) of a file's first bytes.

    offset: where pixels begin; stride: bytes of a row; step: bytes of a pixel; wide: 16-bit samples; top: the greatest
    sample; bgr: blue comes first; up: the last row comes first; palette: where the entries of 4 bytes begin, or null.
    """
    text = F.decode(F.substring(content, 1, HEADER), "ISO-8859-1")
    none = F.lit(None)

    def made(kind, w, h, offset, stride, step, channels, top, wide=False, bgr=False, up=False, palette=none, error=none) -> Column:
        lit = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
        return F.struct(
            F.lit(kind).alias("kind"), lit(w, "long").alias("w"), lit(h, "long").alias("h"), lit(offset, "long").alias("offset"), lit(stride, "long").alias("stride"), lit(step, "int").alias("step"),
            lit(channels, "int").alias("channels"), lit(wide, "boolean").alias("wide"), lit(top, "int").alias("top"), lit(bgr, "boolean").alias("bgr"), lit(up, "boolean").alias("up"), lit(palette, "long").alias("palette"), lit(error, "string").alias("error"),
        )

    bits, size, packing, used = _little(content, 28, 2), _little(content, 14, 4), _little(content, 30, 4), _little(content, 46, 4)
    high, w = _signed(_little(content, 22, 4)), _signed(_little(content, 18, 4))
    masks = F.hex(F.substring(content, 55, 16))
    alpha = (packing == 3) & (size >= 56) & (F.substring(masks, 25, 8) == "000000FF")
    plain = (packing == 0) & bits.isin(8, 24, 32) | (packing == 3) & (bits == 32) & (F.substring(masks, 1, 24) == "0000FF0000FF0000FF000000") & ((size < 56) | F.substring(masks, 25, 8).isin("000000FF", "00000000"))
    entries = F.when(used > 0, used).otherwise(256)
    bmp_error = F.when((size < 40) | (F.length(content) < 54), "BMP header").when(~plain | (bits == 8) & (entries != 256), "BMP layout")
    step = (bits / 8).cast("int")
    bmp = made("bmp", w, F.abs(high), _little(content, 10, 4), F.floor((w * bits + 31) / 32) * 4, step, F.when(bits == 8, 3).when(alpha, 4).otherwise(3), 255, bgr=bits > 8, up=high > 0, palette=F.when(bits == 8, size + 14), error=bmp_error)

    def pnm() -> Column:
        of = lambda i: F.nullif(F.regexp_extract(text, _PNM, i), F.lit("")).cast("long")
        top, n = of(3), F.when(F.startswith(text, F.lit("P6")), 3).otherwise(1)
        each = F.when(top > 255, n * 2).otherwise(n)
        error = F.when(top.isNull(), "Netpbm header").when((top < 1) | (top > 65535), "Netpbm maximum")
        return made("netpbm", of(1), of(2), F.length(F.regexp_extract(text, _PNM, 0)), of(1) * each, each, n, top, top > 255, error=error)

    def pam() -> Column:
        head = F.regexp_extract(text, _PAM, 0)
        of = lambda name: F.nullif(F.regexp_extract(head, rf"\n{name} +(\d{{1,9}})\s", 1), F.lit("")).cast("long")
        top, n = of("MAXVAL"), of("DEPTH")
        each = F.when(top > 255, n * 2).otherwise(n)
        error = F.when((F.length(head) == 0) | top.isNull() | n.isNull(), "PAM header").when(~n.between(1, 4), "PAM depth").when((top < 1) | (top > 65535), "Netpbm maximum")
        return made("netpbm", of("WIDTH"), of("HEIGHT"), F.length(head), of("WIDTH") * each, each, n, top, top > 255, error=error)

    wide = _big(content, 8, 4)
    farbfeld = made("farbfeld", wide, _big(content, 12, 4), 16, wide * 8, 8, 4, 65535, True, error=F.when(F.length(content) < 16, "farbfeld header"))
    other = made(None, 0, 0, 0, 0, 0, 0, 0, error="not read here")
    starts = lambda b: F.substring(content, 1, len(b)) == F.unhex(F.lit(b.hex()))
    return F.when(starts(b"BM"), bmp).when(starts(b"P5") | starts(b"P6"), pnm()).when(starts(b"P7"), pam()).when(starts(b"farbfeld"), farbfeld).otherwise(other)


def headers(files: DataFrame) -> DataFrame:
    """``files`` (content) with ``head``, whose error says why a file isn't read; sizes and length are checked too."""
    c = C("content")

    def checked(head: Column) -> Column:
        needed = head["offset"] + head["stride"] * (head["h"] - 1) + head["w"] * head["step"]
        error = (
            F.when(c.isNull(), "no content").when(head["error"].isNotNull(), head["error"]).when(head["w"].isNull() | head["h"].isNull() | (head["w"] <= 0) | (head["h"] <= 0), "size")
            .when(head["w"].cast("double") * head["h"].cast("double") > MAX_PIXELS, "size").when(F.length(c) < needed, "data")
        )
        return head.withField("error", error)

    # bound as variables of lambdas: else each use of a field would compute its header again
    return files.withColumn("head", F.transform(F.transform(F.array(c), header), checked)[0])


def pixels(files: DataFrame) -> DataFrame:
    """A row for each pixel of the files (content) that are read here: their other columns, w, h, y, x, c0 to c3.

    Channels that a file doesn't have are null. Samples are brought to 8 bits; one above the file's own greatest counts as
    that. Null and damaged files give no row; ``headers`` tells why. Columns with the names of results are replaced.
    """
    out, head, content = headers(files), C("head"), C("content")
    keep = [c for c in files.columns if c not in ("content", "head", "w", "h", "y", "x", "c0", "c1", "c2", "c3")]
    bits = F.when(head["wide"], 16).otherwise(8)
    last = F.when(head["palette"].isNotNull(), 2).otherwise(head["channels"] - 1)
    place = lambda k: F.when((head["bgr"] | head["palette"].isNotNull()) & F.lit(k < 3), 2 - k).otherwise(k)
    # all that is a file's is settled once, so that the code of a pixel stays small enough to be compiled
    file = {
        "_w": head["w"].cast("int"), "_h": head["h"].cast("int"), "_step": head["step"], "_palette": head["palette"], "_wide": head["wide"], "_top": head["top"].cast("long"), "_mask": F.when(head["wide"], 65535).otherwise(255).cast("long"),
        "_at": head["offset"] + F.when(head["up"], (head["h"] - 1) * head["stride"]).otherwise(0), "_stride": F.when(head["up"], -head["stride"]).otherwise(head["stride"]),
        **{f"_s{k}": F.when(F.lit(k) < head["channels"], (last - place(k)) * bits) for k in range(4)},
    }
    out = out.where(head["error"].isNull()).select(*keep, "content", *[v.alias(n) for n, v in file.items()])
    out = out.withColumn("y", F.explode(F.sequence(F.lit(0), C("_h") - 1))).withColumn("_line", C("_at") + C("y") * C("_stride") + 1).withColumn("x", F.explode(F.sequence(F.lit(0), C("_w") - 1)))
    own = F.substring(content, (C("_line") + C("x") * C("_step")).cast("int"), C("_step"))
    # a palette index is followed to its entry, which stands as blue, green, red, zero
    entry = F.substring(content, (C("_palette") + _number(own) * 4).cast("int") + 1, F.lit(3))
    out = out.withColumn("_v", _number(F.when(C("_palette").isNotNull(), entry).otherwise(own)))
    sample = lambda k: F.when(C(f"_s{k}").isNotNull(), F.least(F.call_function("shiftright", C("_v"), C(f"_s{k}")).bitwiseAND(C("_mask")), C("_top")))
    out = out.withColumns({f"c{k}": sample(k) for k in range(4)})
    full = lambda k: F.expr(f"CASE WHEN _wide THEN (c{k} * 65535 div _top + 128) div 257 WHEN _top = 255 THEN c{k} ELSE c{k} * 255 div _top END").cast("int").alias(f"c{k}")
    return out.select(*keep, C("_w").alias("w"), C("_h").alias("h"), "y", "x", *[full(k) for k in range(4)])


def _hex(v: Column, n: int) -> Column:
    """A whole number as n bytes of hex text."""
    return F.lpad(F.hex(v), 2 * n, "0")


def _little_hex(v: Column | int, n: int) -> Column:
    v = v if isinstance(v, Column) else F.lit(v)
    return F.concat(*[_hex(F.shiftright(v.cast("long"), 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(n)])


def encoded(px: DataFrame, kind: str | Column, key: str = "asset_id") -> DataFrame:
    """(key, content): the files of pixel tables (key, w, h, y, x, c0, c1, c2) as 24-bit ``bmp``, ``netpbm`` (P6) or ``farbfeld``.

    ``kind`` may be a column that is the same in all of an image. A pixel is collected as one whole number, its place above its colour, and becomes text
    with its line. Rows of an image are put together apart, so no more than one image's text of one task is held at once.
    """
    w, h, bmp, farbfeld = C("w"), C("h"), C("_kind") == "bmp", C("_kind") == "farbfeld"
    colour = lambda *names: sum((F.shiftleft(C(c).cast("long"), 8 * (2 - i)) for i, c in enumerate(names)), F.lit(0).cast("long"))
    one = F.shiftleft(C("x").cast("long"), 32) + (1 << 24) + F.when(bmp, colour("c2", "c1", "c0")).otherwise(colour("c0", "c1", "c2"))
    pad = F.when(bmp, F.pmod(-(w * 3), F.lit(4))).otherwise(0)
    lines = px.withColumn("_kind", kind if isinstance(kind, Column) else F.lit(kind)).withColumn("_p", one).groupBy(key, "w", "h", "y", "_kind").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    line = F.array_join(F.transform("_p", lambda p: F.substring(F.hex(p), -6, 6)), "")
    line = F.when(farbfeld, F.regexp_replace(line, "(..)(..)(..)", "$1$1$2$2$3$3FFFF")).otherwise(F.concat(line, F.repeat(F.lit("00"), pad.cast("int"))))
    lines = lines.select(key, "w", "h", "_kind", F.struct(F.when(bmp, -C("y")).otherwise(C("y")).alias("at"), line.alias("line")).alias("_line"))
    head = F.when(
        bmp, F.concat(
            F.hex(F.lit("BM")), _little_hex((w * 3 + pad) * h + 54, 4), _little_hex(0, 4), _little_hex(54, 4), _little_hex(40, 4), _little_hex(w, 4), _little_hex(h, 4), _little_hex(1, 2), _little_hex(24, 2),
            _little_hex(0, 4), _little_hex((w * 3 + pad) * h, 4), _little_hex(2835, 4), _little_hex(2835, 4), _little_hex(0, 8),
        ),
    ).when(farbfeld, F.concat(F.hex(F.lit("farbfeld")), _hex(w, 4), _hex(h, 4))).otherwise(F.hex(F.concat(F.lit("P6\n"), w.cast("string"), F.lit(" "), h.cast("string"), F.lit("\n255\n"))))
    body = F.array_join(C("_lines")["line"], "")
    return lines.groupBy(key, "w", "h", "_kind").agg(F.sort_array(F.collect_list("_line")).alias("_lines")).select(key, F.unhex(F.concat(head, body)).alias("content"))
