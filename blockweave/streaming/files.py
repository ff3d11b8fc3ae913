"""Image folders as streams: files are encoded as they arrive. No state is kept but the list of files seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.operators import codec
from blockweave.sources import images


def incoming(spark: SparkSession, folder: str, pattern: str = "*", files_a_batch: int = 100) -> DataFrame:
    """path, modificationTime, length, content of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option(
        "maxFilesPerTrigger", files_a_batch
    ).load(folder)


def encode_stream(spark: SparkSession, folder: str, params: codec.Params | None = None, **options) -> DataFrame:
    """path, jpeg, error of each new file; the id of an image is a hash of its path."""
    raw = images.parse(incoming(spark, folder, **options))
    ids = raw.withColumn("image_id", F.xxhash64("path"))
    coded = codec.encode(ids.select("image_id", "width", "height", "color_space", "pixel_format", "width_padding", "data"), params)
    return coded


def info_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """What the markers of new JPEG files say."""
    return codec.jpeg_info(incoming(spark, folder, **options), column="content", keys=("path",))
