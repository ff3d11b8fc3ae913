"""Colour arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockweave.functions import tables as T


def clamp(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), x))


def _idiv(a: Column, b: int) -> Column:
    """Integer division that truncates toward zero."""
    return F.when(a >= 0, F.floor(a / b)).otherwise(F.ceil(a / b)).cast("int")


def _scaled(c: Column, base: int) -> Column:
    return _idiv((c.cast("int") - base) * 256, 255)


def _product(m, r, shift: int) -> Column:
    return F.shiftright(m[0] * r[0] + m[1] * r[1] + m[2] * r[2] + 128, 8) + shift


def from_rgb(c: list[Column], target: str) -> list[Column]:
    m, base = T.TO[target]
    r = [_scaled(x, 0) for x in c]
    return [clamp(_product(m[3 * k : 3 * k + 3], r, base[k])).cast("int") for k in range(3)]


def to_rgb(c: list[Column], source: str) -> list[Column]:
    m, base = T.FROM[source]
    r = [_scaled(x, b) for x, b in zip(c, base, strict=True)]
    return [clamp(_product(m[3 * k : 3 * k + 3], r, 0)).cast("int") for k in range(3)]


def convert(c: list[Column], source: str, target: str) -> list[Column]:
    """Three channels from a colour space to another; those that are not RGB meet in clamped 8-bit RGB."""
    for name in (source, target):
        if name not in ("rgb", "none", *T.TO):
            raise ValueError(f"no such colour space: {name}")
    if source == target or "none" in (source, target):
        return [x.cast("int") for x in c]
    rgb = c if source == "rgb" else to_rgb(c, source)
    return [x.cast("int") for x in rgb] if target == "rgb" else from_rgb(rgb, target)
