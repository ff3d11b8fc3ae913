"""Images derived from the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """An RGB image 100 wide, a pixel an event: event_id, x, y, c0, c1, c2."""
    i = lambda c: c.cast("int")
    return read(spark, d, "events").select(
        "event_id", i(F.col("event_id") % WIDTH).alias("x"), i(F.floor(F.col("event_id") / WIDTH)).alias("y"),
        i(F.floor("value").cast("int") % 256).alias("c0"), i(F.col("user_id") % 256).alias("c1"), i(
            F.length("event_type") * 37 % 256
        ).alias("c2"),
    )


PIXELS = """pixels AS (SELECT event_id, CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y,
  CAST(CAST(floor(value) AS INTEGER) % 256 AS INTEGER) AS c0, CAST(user_id % 256 AS INTEGER) AS c1, CAST((length(event_type) * 37) % 256 AS INTEGER) AS c2 FROM events)"""


def bag(spark: SparkSession, d: str) -> DataFrame:
    """Pixels without places: c0, c1, c2 of line items."""
    i = lambda c: c.cast("int")
    return read(spark, d, "lineitem").select(
        i(F.col("l_partkey") % 256).alias("c0"),
        i(F.col("l_suppkey") % 256).alias("c1"),
        i(F.col("l_quantity").cast("int") * 5 % 256).alias("c2"),
    )


BAG = "bag AS (SELECT CAST(l_partkey % 256 AS INTEGER) AS c0, CAST(l_suppkey % 256 AS INTEGER) AS c1, CAST((CAST(l_quantity AS INTEGER) * 5) % 256 AS INTEGER) AS c2 FROM lineitem)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One 8x8 block a vector: vec_id, n, v."""
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("e").cast("double") * 256) + 128)).cast("int")
    return read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("n", "e")).select("vec_id", "n", v.alias("v"))


def sample_arrays(spark: SparkSession, d: str) -> DataFrame:
    to = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 256) + 128)).cast("int")
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", to).alias("samples"))


SAMPLES = """samples AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS n, CAST(least(255, greatest(0, floor(CAST(embedding[i] AS DOUBLE) * 256) + 128)) AS INTEGER) AS v
  FROM embeddings, range(1, 65) AS r(i))"""


def image(spark: SparkSession, d: str, pixel_format: str = "444-u8-p012") -> DataFrame:
    """Images of 100 x 50 pixels cut from the event image, as buffers: image_id, width, height, ..., data."""
    p = pixels(spark, d).withColumns({"image_id": F.floor(F.col("y") / 50).cast("long"), "row": (F.col("y") % 50).cast("int")})
    cells = F.array_sort(F.collect_list(F.struct("row", "x", F.concat(*(F.lpad(F.hex(f"c{k}"), 2, "0") for k in range(3))).alias("d"))))
    whole = p.groupBy("image_id").agg(cells.alias("cells"), F.count("*").alias("n"))  # 5,000 pixels an image
    data = F.unhex(F.array_join(F.transform("cells", lambda c: c["d"]), ""))
    return whole.select(
        "image_id",
        F.lit(WIDTH).alias("width"),
        (F.col("n") / WIDTH).cast("int").alias("height"),
        F.lit("rgb").alias("color_space"),
        F.lit(pixel_format).alias("pixel_format"),
        F.lit(0).alias("width_padding"),
        data.alias("data"),
    )


def values(rows, columns: str) -> str:
    """A VALUES table in SQL."""
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(
        x, (int, float)
    ) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({columns})"
