"""Row-wise operators on pixels (x, y, c0..c3) and on planes (comp, x, y, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions import color
from blockweave.functions import tables as T


def idiv(a, b: int) -> Column:
    """a div b for integers that are not negative, as int."""
    return F.floor((F.col(a) if isinstance(a, str) else a) / b).cast("int")


def convert(df: DataFrame, source: str, target: str, channels=("c0", "c1", "c2")) -> DataFrame:
    new = color.convert([F.col(c) for c in channels], source, target)
    return df.withColumns(dict(zip(channels, new, strict=True)))


def remap(df: DataFrame, spec: str) -> DataFrame:
    """Channels by digits of their sources; F is 255 and Z is 0. The length must be that of the channels."""
    have = [c for c in df.columns if c in ("c0", "c1", "c2", "c3")]
    if len(spec) != len(have) or any(c not in "FZ" and f"c{c}" not in have for c in spec):
        raise ValueError(f"channel remap {spec!r} does not fit {len(have)} channels")
    return df.withColumns({f"c{i}": F.lit(255) if c == "F" else F.lit(0) if c == "Z" else F.col(f"c{c}") for i, c in enumerate(spec)})


def opaque(df: DataFrame) -> DataFrame:
    return df.withColumn("c3", F.coalesce(F.col("c3"), F.lit(255)) if "c3" in df.columns else F.lit(255))


def gray_to_three(df: DataFrame, internal: str) -> DataFrame:
    rest = F.col("c0") if internal == "rgb" else F.lit(128)
    return df.withColumns({"c1": rest, "c2": rest})


def flip(df: DataFrame, height: Column) -> DataFrame:
    """Row y becomes height - 1 - y; ``height`` is the component's padded height."""
    return df.withColumn("y", (height - 1 - F.col("y")).cast("int"))


def within(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def fan_out(df: DataFrame, comps: int = 3) -> DataFrame:
    """One row for each component: comp, v; no shuffle."""
    keep = [c for c in df.columns if c not in ("c0", "c1", "c2", "c3")]
    return df.select(*keep, F.posexplode(F.array(*(F.col(f"c{i}") for i in range(comps)))).alias("comp", "v"))


def subsample(planes: DataFrame, h: int, v: int) -> DataFrame:
    """Decimation: samples at multiples of (h, v), under new keys. No averaging."""
    return planes.where((F.col("x") % h == 0) & (F.col("y") % v == 0)).withColumns({"x": idiv("x", h), "y": idiv("y", v)})


def upsample(plane: DataFrame, grid: DataFrame, h: int, v: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each pixel of ``grid`` (x, y) with the sample of its cell: an equi-join on the cell, partitioned by it."""
    cell = grid.withColumns({"cx": idiv("x", h), "cy": idiv("y", v)})
    source = plane.select(*keys, F.col("x").alias("cx"), F.col("y").alias("cy"), "v")
    return cell.join(source, [*keys, "cx", "cy"]).drop("cx", "cy")


def upsample_by_copy(plane: DataFrame, h: int, v: int, width: int, height: int) -> DataFrame:
    """The same without a join: each sample is repeated over its cell, and what lies outside the image goes."""
    out = plane.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn(
        "dy", F.explode(F.sequence(F.lit(0), F.lit(v - 1)))
    )
    out = out.withColumns(
        {"x": (F.col("x") * h + F.col("dx")).cast("int"), "y": (F.col("y") * v + F.col("dy")).cast("int")}
    ).drop("dx", "dy")
    return within(out, width, height)


def tile(planes: DataFrame, data_width: int) -> DataFrame:
    """block (row-major number) and n (position 0..63 within it)."""
    return planes.withColumns(
        {"block": idiv("y", 8) * F.lit(data_width // 8) + idiv("x", 8), "n": (F.col("y") % 8 * 8 + F.col("x") % 8).cast("int")}
    )


def pad(plane: DataFrame, data_width: int, data_height: int, split: int = 8) -> DataFrame:
    """All samples of the padded component, with 0 outside the image. Only the padding is generated, nothing is joined."""
    spark = plane.sparkSession
    size = plane.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
    width, height = size.w or 0, size.h or 0
    grid = spark.range(0, data_width * data_height, 1, split).select(
        (F.col("id") % data_width).cast("int").alias("x"), idiv("id", data_width).alias("y")
    )
    margin = grid.where((F.col("x") >= width) | (F.col("y") >= height)).withColumn("v", F.lit(0))
    return plane.select("x", "y", "v").unionByName(margin)


def unpack_offsets(pixels: DataFrame, width: int, height: int, pixel_format: str, padding: int = 0) -> DataFrame:
    """o0..o3: where each channel of pixel (x, y) lies in a buffer of the format; null where the format lacks it."""
    planar, comps, bpp, sampling = T.PIXEL_FORMATS[pixel_format]
    x, y = F.col("x"), F.col("y")
    if pixel_format == "422-u8-p1020":
        line = (width + padding) * 2
        pair = idiv("x", 2) * 4
        offsets = [y * line + x * 2 + 1, y * line + pair, y * line + F.least(pair + 2, F.lit((width - 1) * 2))]
    elif not planar:
        offsets = [y * ((width + padding) * bpp) + x * bpp + k for k in range(comps)]
    else:
        offsets, at = [], 0
        mh, mv = sampling[0]
        for h, v in sampling:
            dh, dv = mh // h, mv // v
            w, ht = -(-width // dh), -(-height // dv)
            offsets.append(F.lit(at) + idiv("y", dv) * w + idiv("x", dh))
            at += w * ht
    return pixels.withColumns({f"o{k}": (offsets[k] if k < comps else F.lit(None)).cast("int") for k in range(4)})


def pack_rows(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each row of packed pixels as hexadecimal digits in order of x: one group a row, so no group grows with the image."""
    have = [c for c in pixels.columns if c in ("c0", "c1", "c2", "c3")]
    digits = F.concat(*(F.lpad(F.hex(F.col(c)), 2, "0") for c in have))
    cells = pixels.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", digits.alias("d")))).alias("cells"))
    return cells.select(*keys, "y", F.array_join(F.transform("cells", lambda c: c["d"]), "").alias("hex"))


def raw_size(width: Column, height: Column, pixel_format: Column, padding: Column) -> Column:
    """Bytes of a raw image; odd chroma sizes round up, padding counts in pixels of packed formats."""
    w, h = width.cast("long"), height.cast("long")
    half_w, half_h = F.floor((w + 1) / 2), F.floor((h + 1) / 2)
    size = F.lit(None).cast("long")
    for name, (_, _, bpp, _) in T.PIXEL_FORMATS.items():
        own = (w + padding) * h * bpp if bpp else w * h + 2 * {
            "444-u8-p0p1p2": w * h, "422-u8-p0p1p2": half_w * h, "420-u8-p0p1p2": half_w * half_h
        }[name]
        size = F.when(pixel_format == name, own).otherwise(size)
    return size.cast("long")


def line_padding(line: Column, alignment: Column) -> Column:
    return (F.ceil(line / alignment) * alignment - line).cast("int")


def value_range(planes: DataFrame, keys: tuple[str, ...] = ("comp",)) -> DataFrame:
    return planes.groupBy(*keys).agg(F.min("v").cast("int").alias("low"), F.max("v").cast("int").alias("high"))


def psnr(pairs: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Peak signal-to-noise ratio in dB; null for equal inputs (infinite)."""
    mse = F.avg(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).cast("double"))
    return pairs.groupBy(*keys).agg(mse.alias("mse")).select(
        *keys, F.when(F.col("mse") > 0, F.round(10 * F.log10(F.lit(65025.0) / F.col("mse")), 6)).alias("psnr")
    )
