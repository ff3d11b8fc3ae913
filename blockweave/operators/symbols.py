"""Entropy symbols: DC differences, zero runs, categories, Huffman codes and their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.functions import tables as T


def category(v: Column) -> Column:
    """Bits of |v|; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long")))).cast("int")


def value_bits(v: Column, n: Column) -> Column:
    """The low n bits that follow a code: v, or v - 1 for a negative v."""
    return F.when(v >= 0, v).otherwise(v - 1 + F.pow(F.lit(2), n)).cast("int")


def extend(bits: Column, n: Column) -> Column:
    """The value of n bits: the inverse of value_bits."""
    return F.when(n == 0, 0).when(bits < F.pow(F.lit(2), n - 1), bits - F.pow(F.lit(2), n) + 1).otherwise(bits).cast("int")


def dc_difference(blocks: DataFrame, segment: tuple[str, ...], order: str, dc: str = "dc") -> DataFrame:
    """diff: to the block before in the segment and component; the first keeps its value."""
    w = Window.partitionBy(*segment).orderBy(order)
    return blocks.withColumn("diff", (F.col(dc) - F.lag(dc, 1, 0).over(w)).cast("int"))


def dc_sum(blocks: DataFrame, segment: tuple[str, ...], order: str, diff: str = "diff") -> DataFrame:
    w = Window.partitionBy(*segment).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("dc", F.sum(diff).over(w).cast("int"))


def zero_runs(coefs: DataFrame, block: tuple[str, ...]) -> DataFrame:
    """block, zz, coef, run of the AC coefficients that are not 0."""
    w = Window.partitionBy(*block).orderBy("zz")
    ac = coefs.where((F.col("zz") > 0) & (F.col("coef") != 0))
    return ac.select(*block, "zz", "coef", (F.col("zz") - F.lag("zz", 1, 0).over(w) - 1).cast("int").alias("run"))


def end_of_block(coefs: DataFrame, block: tuple[str, ...]) -> DataFrame:
    """block, eob: whether zeros end the block."""
    last = F.max(F.when((F.col("zz") > 0) & (F.col("coef") != 0), F.col("zz")).otherwise(0))
    return coefs.groupBy(*block).agg((last < 63).alias("eob"))


def zrl(runs: DataFrame) -> DataFrame:
    """A row (symbol 240) for each 16 zeros that a coefficient follows."""
    return runs.where(F.col("run") >= 16).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.floor(F.col("run") / 16).cast("int")))
    ).withColumn("symbol", F.lit(0xF0))


def ac_symbols(runs: DataFrame) -> DataFrame:
    cat = category(F.col("coef"))
    return runs.withColumns({"cat": cat, "symbol": (F.col("run") % 16 * 16 + cat).cast("int")})


def huffman(spark: SparkSession) -> DataFrame:
    """kind, class, symbol, code, nbits: 348 rows, so a broadcast."""
    rows = [(kind, group, s, code, n) for kind, group in T.HUFFMAN for s, (code, n) in T.codes(kind, group).items()]
    return spark.createDataFrame(rows, "kind string, class string, symbol int, code int, nbits int")


def coded(symbols: DataFrame, kind: str, group: str) -> DataFrame:
    table = huffman(symbols.sparkSession).where((F.col("kind") == kind) & (F.col("class") == group)).select("symbol", "code", "nbits")
    return symbols.join(F.broadcast(table), "symbol")


def all_symbols(coefs: DataFrame, block: tuple[str, ...], kind: str = "luma", diff: DataFrame | None = None) -> DataFrame:
    """block, pos, ord, symbol, nbits, vbits for every symbol of the blocks; diff (block, diff) replaces the DC values."""
    runs = ac_symbols(zero_runs(coefs, block))
    dc = diff if diff is not None else coefs.where("zz = 0").select(*block, F.col("coef").alias("diff"))
    cat = category(F.col("diff"))
    head = dc.select(*block, F.lit(0).alias("pos"), F.lit(0).alias("ord"), cat.alias("symbol"), cat.alias("vbits"))
    zeros = zrl(runs).select(*block, F.col("zz").alias("pos"), F.lit(0).alias("ord"), "symbol", F.lit(0).alias("vbits"))
    values = runs.select(*block, F.col("zz").alias("pos"), F.lit(1).alias("ord"), "symbol", F.col("cat").alias("vbits"))
    ends = end_of_block(coefs, block).where("eob").select(
        *block, F.lit(64).alias("pos"), F.lit(0).alias("ord"), F.lit(0).alias("symbol"), F.lit(0).alias("vbits")
    )
    ac = zeros.unionByName(values).unionByName(ends)
    return coded(head, kind, "dc").unionByName(coded(ac, kind, "ac")).select(*block, "pos", "ord", "symbol", "nbits", "vbits")


def block_bits(symbols: DataFrame, block: tuple[str, ...]) -> DataFrame:
    return symbols.groupBy(*block).agg(F.sum(F.col("nbits") + F.col("vbits")).cast("int").alias("bits"))


def offsets(sizes: DataFrame, scan: tuple[str, ...], order: str, size: str) -> DataFrame:
    """Exclusive prefix sum of the sizes within a scan."""
    w = Window.partitionBy(*scan).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def restart_markers(segments: DataFrame, scan: tuple[str, ...], order: str = "seg") -> DataFrame:
    """rst: the marker after a segment, as hexadecimal digits; none after the last of a scan."""
    w = Window.partitionBy(*scan).orderBy(order)
    return segments.withColumn(
        "rst", F.when(F.lead(order).over(w).isNull(), F.lit("")).otherwise(F.concat(F.lit("FF"), F.hex(F.col(order) % 8 + 0xD0)))
    )
