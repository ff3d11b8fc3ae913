"""Component, MCU, scan and segment geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions import tables as T


def up(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("int")


def components(df: DataFrame) -> DataFrame:
    """width, height, h, v, max_h, max_v, interleaved, restart -> the component's sizes, MCUs and segments."""
    div_h, div_v = F.floor(F.col("max_h") / F.col("h")), F.floor(F.col("max_v") / F.col("v"))
    out = df.withColumns({
        "comp_width": F.floor(F.ceil(F.col("width") / div_h) * div_h * F.col("h") / F.col("max_h")).cast("int"),
        "comp_height": F.floor(F.ceil(F.col("height") / div_v) * div_v * F.col("v") / F.col("max_v")).cast("int"),
        "mcu_w": F.when(F.col("interleaved"), F.col("h") * 8).otherwise(8).cast("int"),
        "mcu_h": F.when(F.col("interleaved"), F.col("v") * 8).otherwise(8).cast("int"),
    })
    out = out.withColumns({"mcu_x": up(F.col("comp_width"), F.col("mcu_w")), "mcu_y": up(F.col("comp_height"), F.col("mcu_h"))})
    out = out.withColumns(
        {
            "data_width": (F.col("mcu_x") * F.col("mcu_w")).cast("int"),
            "data_height": (F.col("mcu_y") * F.col("mcu_h")).cast("int"),
            "mcu_count": (F.col("mcu_x") * F.col("mcu_y")).cast("int"),
        }
    )
    out = out.withColumn("segment_mcu_count", F.when(F.col("restart") == 0, F.col("mcu_count")).otherwise(F.col("restart")).cast("int"))
    return out.withColumn("segment_count", up(F.col("mcu_count"), F.col("segment_mcu_count")))


def suggest_restart(width: Column, height: Column, comps: Column, subsampled: Column, interleaved: Column) -> Column:
    load = width.cast("double") * height * comps / 3e6
    r = F.when(load < 1, 4).when(load < 3, 8).when(load < 9, 10).otherwise(12)
    r = F.when(subsampled & interleaved, F.floor(r / 2)).otherwise(r)
    return F.when(interleaved, r).otherwise(r * comps).cast("int")


def segment_of(mcu: Column, restart: int) -> Column:
    return F.floor(mcu / restart).cast("int") if restart else F.lit(0)


def mcu_position(bx: Column, by: Column, h: int, v: int, mcus_wide: int) -> tuple[Column, Column]:
    """(MCU number, position within the MCU's blocks of the component) of a block in interleaved order."""
    mcu = F.floor(by / v) * mcus_wide + F.floor(bx / h)
    return mcu.cast("int"), ((by % v) * h + bx % h).cast("int")


def subsampling_name(h0: Column, v0: Column, h1: Column, v1: Column) -> Column:
    """J:a:b of three components whose two chroma ones agree."""
    a = F.floor(F.lit(4) / h0) * h1
    b = F.when(F.floor(F.lit(2) / v0) * v1 == 2, a).otherwise(0)
    return F.concat(F.lit("4:"), a.cast("string"), F.lit(":"), b.cast("string"))


def parse_subsampling(name: Column) -> Column:
    """struct<comps, h0, v0>: sampling of the first component (chroma is 1x1), null if not J:a:b[:alpha] with or without colons."""
    parts = F.split(
        F.when(name.rlike(r"^4[0-9]{2,3}$"), F.regexp_replace(F.regexp_replace(name, r"(\d)", "$1:"), ":$", "")).otherwise(name), ":"
    )
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    j, a, b, alpha = at(0), at(1), at(2), F.when(n == 4, at(3)).otherwise(F.lit(0))
    fits = n.isin(3, 4) & (j == 4) & alpha.isin(0, 4) & (
        (a == b) | (b == 0) | ((a == 4) & (b == 2) & (alpha == 0)) | ((a == 2) & (b == 1) & (alpha == 0))
    )
    comps = F.when((a == 0) & (b == 0) & (alpha == 0), 1).when(alpha == 4, 4).otherwise(3)
    odd = ((a == 4) & (b == 2)) | ((a == 2) & (b == 1))
    h0 = F.when(comps == 1, 1).when(odd, F.when(a == 4, 1).otherwise(2)).otherwise(
        F.floor(F.lit(4) / F.when(a == 0, F.lit(4)).otherwise(a))
    )
    v0 = F.when(comps == 1, 1).when(odd, 2).when(a == b, 1).otherwise(2)
    return F.when(fits, F.struct(comps.cast("int").alias("comps"), h0.cast("int").alias("h0"), v0.cast("int").alias("v0")))


def orientation_name(rotation: Column, flip: Column) -> Column:
    """What a clockwise rotation in quarter turns, and a mirroring before it, are called; null for others."""
    names = F.create_map(*(F.lit(x) for (turns, mirrored), name in T.ORIENTATIONS.items() for x in (turns * 2 + mirrored, name)))
    return F.try_element_at(names, rotation * 2 + flip.cast("int"))


def table_kind(comp: Column, color_space: Column) -> Column:
    """Which quantisation and Huffman tables a component has."""
    return F.when((color_space == "rgb") | comp.isin(0, 3), "luma").otherwise("chroma")
