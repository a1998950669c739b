"""Format, size and mode of images from the bytes of their headers, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colour types of PNG, components of JPEG, and bits a pixel of BMP, with the names of their modes.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
BMP_MODES = {1: "1", 8: "P", 24: "RGB", 32: "RGB"}
#: JPEG markers that begin a frame: FFC0 to FFCF without tables (C4, CC) and the reserved one (C8).
FRAMES = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))
#: Segments before its frame that a JPEG may have: each is up to 64 KB, so this is 64 MB of them.
SEGMENTS = 1024


def number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The unsigned number of `size` bytes from byte `at` (from 0) on; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(content, at + 1, F.lit(size))
    digits = F.hex(part)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.when(F.octet_length(part) == size, F.conv(digits, 16, 10).cast("long"))


def signed(value: Column, size: int) -> Column:
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def _named(value: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, name in names.items():
        out = F.when(value == k, name).otherwise(out)
    return out


def jpeg_frame(content: Column) -> Column:
    """Where a JPEG's frame header begins (its marker), walking from segment to segment; null if none is found."""

    def step(at: Column, _: Column) -> Column:
        marker = number(content, at + 1, 1)
        # a negative place is one that was found
        return F.when(at < 0, at).when(number(content, at, 1) != 0xFF, F.lit(None)).when(marker.isin(*FRAMES), -at).when(marker == 0xFF, at + 1).otherwise(at + 2 + number(content, at + 2, 2))

    most = F.least(F.lit(SEGMENTS), F.greatest(F.lit(1), (F.octet_length(content) / 4).cast("int")))
    found = F.aggregate(F.sequence(F.lit(1), most), F.lit(2).cast("long"), step)
    return F.when(found < 0, -found)


def with_image_header(images: DataFrame, content: str = "content") -> DataFrame:
    """img_format, width, height, mode of PNG, JPEG and BMP files; null for others and for headers that are cut.

    Step by step, so that each is computed once."""
    c, frame = F.col(content), F.col("_frame")
    kind = F.col("_kind")
    digits = F.hex(F.substring(c, 1, 16))
    told = F.when(digits.startswith("89504E470D0A1A0A") & digits.endswith("49484452"), "PNG").when(digits.startswith("424D"), "BMP").when(digits.startswith("FFD8FF"), "JPEG")
    found = images.withColumn("_kind", told).withColumn("_frame", F.when(kind == "JPEG", jpeg_frame(c)))
    png = F.when(kind == "PNG", F.array(number(c, 16, 4), number(c, 20, 4), number(c, 25, 1)))
    bmp = F.when(kind == "BMP", F.array(signed(number(c, 18, 4, little=True), 4), signed(number(c, 22, 4, little=True), 4), number(c, 28, 2, little=True)))
    jpeg = F.when(kind == "JPEG", F.array(number(c, frame + 7, 2), number(c, frame + 5, 2), number(c, frame + 9, 1)))
    sized = found.withColumn("_size", F.coalesce(png, bmp, jpeg))
    width, height, code = F.abs(F.get("_size", F.lit(0))), F.abs(F.get("_size", F.lit(1))), F.get("_size", F.lit(2))
    whole = (width > 0) & (height > 0)
    mode = F.when(kind == "PNG", _named(code, PNG_MODES)).when(kind == "BMP", _named(code, BMP_MODES)).when(kind == "JPEG", _named(code, JPEG_MODES))
    return sized.select(*images.columns, F.when(whole, kind).alias("img_format"), F.when(whole, width).cast("int").alias("width"), F.when(whole, height).cast("int").alias("height"), F.when(whole, mode).alias("mode"))


def le(value: Column, size: int) -> Column:
    """A number as `size` bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))))


def be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def bitmap(width: Column, height: Column, grey: Column) -> Column:
    """A BMP file of one grey (0 to 255), 24 bits a pixel."""
    row = (width * 3 + 3 - (width * 3 + 3) % 4).cast("int")
    size = row * height
    zero = F.lit(0)
    head = F.concat(F.lit(b"BM"), le(size + 54, 4), le(zero, 4), le(F.lit(54), 4), le(F.lit(40), 4), le(width, 4), le(height, 4), le(F.lit(1), 2), le(F.lit(24), 2), le(zero, 4), le(size, 4), le(zero, 16))
    return F.concat(head, F.unhex(F.repeat(F.lpad(F.hex(grey.cast("long")), 2, "0"), size.cast("int"))))
