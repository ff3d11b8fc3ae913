"""python -m blockweave info|encode|decode|formats ...: the operators from a command line.

    info PATH...                         what headers and markers say
    encode IN OUT [name=value ...]       image files to JPEG files in the folder OUT; names are those of codec.Params
    decode IN OUT [format=png] [name=value ...]
    formats                              pixel formats, colour spaces and file extensions
    options                              names of encoding and decoding options with their defaults
"""

from __future__ import annotations

import dataclasses
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from blockweave import __version__
from blockweave.functions import tables as T
from blockweave.operators import codec
from blockweave.sources import images


#: Options of decode and their defaults.
DECODING = {"format": "pnm", "color_space": "default", "pixel_format": "auto", "alignment": 0, "flip": False, "remap": "", "tga_rle": False}


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help", "help"):
        print(__doc__)
        return 0
    if args[0] == "--version":
        print(__version__)
        return 0
    if args[0] == "formats":
        for name, (planar, comps, bpp, sampling) in T.PIXEL_FORMATS.items():
            print(f"{name:16} {'planar' if planar else 'packed'}, {comps} components, {bpp or '-'} bytes a pixel, sampling {sampling}")
        print("colour spaces:", ", ".join(T.COLOR_SPACES), "\nextensions:", ", ".join(T.EXTENSIONS))
        return 0
    if args[0] == "options":
        for f in dataclasses.fields(codec.Params):
            print(f"encode {f.name}={f.default if f.default is not dataclasses.MISSING else ''}")
        for name, default in DECODING.items():
            print(f"decode {name}={default}")
        return 0
    spark = SparkSession.builder.appName("blockweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    images.register(spark)
    if args[0] == "info":
        failed = 0
        for path in args[1:]:
            probed = images.probe_images(spark, path)
            probed.show(truncate=False)
            failed += probed.where("error is not null").count()
            jpeg = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(jpg|jpeg|jfif)$"))
            if not jpeg.isEmpty():
                codec.jpeg_info(jpeg, column="content", keys=("path",)).show(truncate=False, vertical=True)
        return int(failed > 0)
    source, target, rest = args[1], args[2], dict(x.split("=", 1) for x in args[3:])
    stem = F.regexp_replace(images.relative("path", source), r"\.[^./]*$", "")  # folders below the source are kept
    if args[0] == "encode":
        raw = images.read_images(spark, source).withColumn("image_id", F.xxhash64("path"))
        coded = codec.encode(raw, codec.options(**rest)).join(
            raw.select("image_id", F.concat(stem, F.lit(".jpg")).alias("name")), "image_id"
        )
        bad = raw.where("error is not null").select("path", "error").collect()
        coded.where("jpeg is not null").select(F.col("name").alias("path"), F.col("jpeg").alias("content")).write.format(
            "imagefiles"
        ).mode("append").save(target)
    elif args[0] == "decode":
        ext = rest.pop("format", "pnm")
        files = spark.read.format("binaryFile").load(source).select(
            F.xxhash64("path").alias("image_id"), "path", F.col("content").alias("jpeg")
        )
        out = codec.decode(
            files,
            rest.get("color_space", "default"),
            rest.get("pixel_format", "auto"),
            alignment=int(rest.get("alignment", 0)),
            flip=rest.get("flip") in ("1", "true"),
            remap=rest.get("remap"),
        )
        named = out.join(files.select("image_id", F.concat(stem, F.lit(f".{ext}")).alias("path")), "image_id")
        bad = named.where("error is not null").select("path", "error").collect()
        written = images.write_images(named.where("error is null"), target, rle=rest.get("tga_rle") in ("1", "true"))
        bad += written.where("error is not null").select("path", "error").collect()
    else:
        print(__doc__)
        return 2
    for row in bad:  # one bad file does not stop the others
        print(f"{row[0]}: {row[1]}", file=sys.stderr)
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
