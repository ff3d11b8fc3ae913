"""8x8 blocks: transforms and quantisation, in long form (joins and sums) and in array form (Arrow batches)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions import tables as T


def quality_table(spark: SparkSession, quality: int = 75) -> DataFrame:
    """kind, zz, k, base, q: 128 rows."""
    rows = [(kind, zz, k, T.QUANT[kind][k]) for kind in ("luma", "chroma") for zz, k in enumerate(T.ZIGZAG)]
    df = spark.createDataFrame(rows, "kind string, zz int, k int, base int")
    return df.withColumn("q", scaled(F.col("base"), F.lit(quality)))


def scaled(base: Column, quality: Column) -> Column:
    q = F.least(F.lit(100), F.greatest(F.lit(1), quality))
    s = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q)
    return F.least(F.lit(255), F.greatest(F.lit(1), F.floor((s * base + 50) / 100))).cast("int")


def zigzag(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(T.ZIGZAG)), "zz int, k int")


def basis(spark: SparkSession) -> DataFrame:
    """k, n, w: 4,096 rows, always."""
    return spark.createDataFrame(T.basis(), "k int, n int, w double")


#: Rows of 1,024 blocks: a task sums over so many, as the hash tables of the sums hold a group for each.
ROWS = 1 << 16


def dealt_out(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows by block, about ROWS a partition: counts them first. Sums by keys and more need no other exchange then."""
    return rows.repartition(max(1, -(-rows.count() // ROWS)), *keys)


def dct(samples: DataFrame, keys: tuple[str, ...] = ("block",)) -> DataFrame:
    """keys, k, c: the cosine transform of the level-shifted samples (keys, n, v), as a broadcast join and a sum; dealt out by keys."""
    shifted = dealt_out(samples.select(*keys, "n", (F.col("v") - 128).alias("s")), keys)
    return shifted.join(F.broadcast(basis(samples.sparkSession)), "n").groupBy(*keys, "k").agg(
        F.round(F.sum(F.col("s") * F.col("w")), 6).alias("c")
    )


def quantise(coefs: DataFrame, quality: int = 75, kind: str = "luma") -> DataFrame:
    """Adds zz and coef = c / q rounded half to even."""
    q = quality_table(coefs.sparkSession, quality).where(F.col("kind") == kind).select("zz", "k", "q")
    return coefs.join(F.broadcast(q), "k").withColumn("coef", F.rint(F.round(F.col("c") / F.col("q"), 6)).cast("int"))


def dequantise(coefs: DataFrame, quality: int = 75, kind: str = "luma") -> DataFrame:
    q = quality_table(coefs.sparkSession, quality).where(F.col("kind") == kind).select(F.col("zz").alias("qz"), "q")
    return coefs.join(F.broadcast(q), F.col("zz") == F.col("qz")).drop("qz").withColumn("c", (F.col("coef") * F.col("q")).cast("int"))


def idct(coefs: DataFrame, keys: tuple[str, ...] = ("block",), dealt: bool = False) -> DataFrame:
    """keys, n, v: samples of the coefficients (keys, k, c), rounded half to even and clamped. dealt: they are, by keys, as dct leaves them."""
    coefs = coefs if dealt else dealt_out(coefs, keys)
    s = coefs.join(F.broadcast(basis(coefs.sparkSession)), "k").groupBy(*keys, "n").agg(F.sum(F.col("c") * F.col("w")).alias("s"))
    return s.select(*keys, "n", F.least(F.lit(255), F.greatest(F.lit(0), F.rint(F.round("s", 6) + 128))).cast("int").alias("v"))


#: Blocks of an Arrow batch that are worked on at once: arrays made of all its 10,000 would take most of a worker's memory.
SLICE = 1024


def slices(batches):
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at : at + SLICE]


_W = np.zeros((64, 64))
for _k, _n, _w in T.basis():
    _W[_k, _n] = _w


def dct_arrays(blocks: DataFrame, column: str, keys: tuple[str, ...], quality: int = 75, kind: str = "luma") -> DataFrame:
    """keys, coefs (array<int>, zig-zag): the transform and quantisation of arrays of 64 samples, batch by batch."""
    q, zz = np.array(T.quant(kind, quality), float), np.array(T.ZIGZAG)
    schema = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys) + ", coefs array<int>"

    def run(batches):
        for batch in slices(batches):
            x = np.stack(batch.samples.to_numpy()).astype(float) - 128
            c = np.rint(np.round(np.round(x @ _W.T, 6) / q, 6)).astype(np.int32)[:, zz]
            yield batch[list(keys)].assign(coefs=list(c))

    return blocks.select(*keys, F.col(column).alias("samples")).mapInPandas(run, schema)


def idct_arrays(blocks: DataFrame, keys: tuple[str, ...], quality: int = 75, kind: str = "luma") -> DataFrame:
    """keys, samples (array<int>) of zig-zag coefficients."""
    q, zz = np.array(T.quant(kind, quality), float), np.array(T.ZIGZAG)
    schema = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys) + ", samples array<int>"

    def run(batches):
        for batch in slices(batches):
            c = np.zeros((len(batch), 64))
            c[:, zz] = np.stack(batch.coefs.to_numpy())
            s = np.clip(np.rint(np.round((c * q) @ _W, 6) + 128), 0, 255).astype(np.int32)
            yield pd.DataFrame({k: batch[k] for k in keys} | {"samples": list(s)})

    return blocks.select(*keys, "coefs").mapInPandas(run, schema)
