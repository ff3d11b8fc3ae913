"""Image files as DataFrames: readers and a writer over Spark's file access, and Python data sources for the same."""

from __future__ import annotations

import os
import uuid
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from blockweave.functions import tables as T
from blockweave.sources import formats

SCHEMA = "path string, width int, height int, color_space string, pixel_format string, width_padding int, data binary, error string"


def read_images(
    spark: SparkSession,
    path: str,
    mode: str = "PERMISSIVE",
    width: int = 0,
    height: int = 0,
    color_space: str | None = None,
    pixel_format: str | None = None,
    pattern: str = "*",
) -> DataFrame:
    """SCHEMA, a row a file, whatever its format; files are read by Spark, so any store it reaches will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(
        "path", "content"
    )
    return parse(files, mode, width, height, color_space, pixel_format)


def parse(
    files: DataFrame, mode: str = "PERMISSIVE", width: int = 0, height: int = 0, color_space: str | None = None, pixel_format: str | None = None
) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                try:
                    w, h, cs, pf, raw = formats.load(name, bytes(content), width, height, color_space, pixel_format)
                    row = (name, w, h, cs, pf, 0, raw, None)
                except Exception as e:  # noqa: BLE001  a bad file becomes a row with an error
                    if mode == "FAILFAST":
                        raise
                    row = (name, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame(
                    [row], columns=["path", "width", "height", "color_space", "pixel_format", "width_padding", "data", "error"]
                ).astype({c: "Int32" for c in ("width", "height", "width_padding")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _opened(path: str):
    """(file system, path) of a path of Spark's, where pyarrow knows the scheme."""
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _known(path: str) -> bool:
    try:
        _opened(path if ":" in path else os.path.abspath(path))
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def probe_images(spark: SparkSession, path: str, pattern: str = "*", head: int = 65536) -> DataFrame:
    """path, width, height, color_space, pixel_format, error: from the first bytes of each file.

    Where these do not do, twice as many are read, and so on up to the whole file. Files are listed by Spark and opened by the workers; in
    stores that only Spark reaches it loads them whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    direct = _known(path)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                n, found = head, None
                while found is None:
                    try:
                        if direct:
                            store, at = _opened(row.path)
                            with store.open_input_file(at) as f:
                                content = f.read(min(n, row.length))
                        else:
                            content = bytes(row.content[:n])
                        found = (row.path, *formats.probe(row.path, content), None)
                    except Exception as e:  # noqa: BLE001
                        if n >= row.length:
                            found = (row.path, None, None, None, None, f"{type(e).__name__}: {e}")
                        n *= 2
                out.append(found)
            yield pd.DataFrame(out, columns=["path", "width", "height", "color_space", "pixel_format", "error"]).astype(
                {"width": "Int32", "height": "Int32"}
            )

    files = files.select("path", "length") if direct else files.select("path", "length", "content")
    return files.mapInPandas(run, "path string, width int, height int, color_space string, pixel_format string, error string")


def with_format(df: DataFrame, column: str = "path") -> DataFrame:
    """format: what a file holds by its extension."""
    ext = F.lower(F.regexp_extract(F.col(column), r"\.([^./]*)$", 1))
    table = F.create_map(*(F.lit(x) for kv in T.EXTENSIONS.items() for x in kv))
    return df.withColumn("format", F.try_element_at(table, ext))


def test_images(spark: SparkSession, names: list[str]) -> DataFrame:
    """Synthetic images by their names."""
    return parse(spark.createDataFrame([(n, b"") for n in names], "path string, content binary"), mode="FAILFAST")


def relative(path, base: str | None = None):
    """A column of paths below ``base``, whatever the scheme; the last part of absolute ones if there is no base."""
    plain = lambda c: F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "")
    column = plain(F.col(path) if isinstance(path, str) else path)
    if base is None:
        return F.when(column.startswith("/"), F.regexp_extract(column, r"([^/]*)$", 1)).otherwise(column)
    root = F.concat(F.rtrim(plain(F.lit(base)), F.lit("/")), F.lit("/"))
    return F.when(column.startswith(root), F.substring(column, F.length(root) + 1, F.length(column))).otherwise(column)


class Store:
    """A folder of any file system that pyarrow reaches: local or mounted paths, and the schemes that it knows."""

    def __init__(self, folder: str):
        folder = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
        self.fs, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        self.root = root.rstrip("/")

    def at(self, name: str) -> str:
        parts = [p for p in name.split("/") if p not in ("", ".")]
        if not parts or ".." in parts or name.startswith("/"):
            raise ValueError(f"{name!r} is no path below a folder")
        return "/".join([self.root, *parts])

    def put(self, name: str, body: bytes) -> str:
        to = self.at(name)
        self.fs.create_dir(os.path.dirname(to), recursive=True)
        with self.fs.open_output_stream(to) as f:
            f.write(body)
        return to

    def move(self, tmp: str, name: str) -> None:
        """Does nothing the second time, so a task may run again."""
        to = self.at(name)
        if self.fs.get_file_info(tmp).type == fs.FileType.NotFound and self.fs.get_file_info(to).type == fs.FileType.File:
            return
        self.fs.create_dir(os.path.dirname(to), recursive=True)
        self.fs.move(tmp, to)

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(self.at(name)).type == fs.FileType.Directory:
            self.fs.delete_dir(self.at(name))


_WRITTEN = "path string, file string, bytes long, error string"


def write_images(images: DataFrame, folder: str, name: str = "path", base: str | None = None, **options) -> DataFrame:
    """Writes each row's image to a file below ``folder`` and returns path, file, bytes, error of what has been written.

    A file is named by column ``name`` relative to ``base`` (see ``relative``), so folders are kept. Images are encoded once: files get names
    of their own first, in a subfolder, with a report; two images with one file name raise FileExistsError and nothing is written, else
    the files are moved. ``folder`` is on a file system that all executors, pyarrow and Spark reach.
    """
    spark = images.sparkSession
    work = f"_writing-{uuid.uuid4().hex}"

    def run(batches):
        store = Store(folder)
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    file, body = formats.save(
                        row.name_, row.width, row.height, row.color_space, row.pixel_format, bytes(row.data), **options
                    )
                    store.at(file)
                    out.append((row.path_, file, store.put(f"{work}/{uuid.uuid4().hex}", body), len(body), None))
                except Exception as e:  # noqa: BLE001  a bad image becomes a row with an error
                    out.append((row.path_, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "file", "tmp", "bytes", "error"]).astype({"bytes": "Int64"})

    def settle(batches):
        store = Store(folder)
        for batch in batches:
            for tmp, file in zip(batch.tmp, batch.file, strict=True):
                if file is not None:
                    store.move(tmp, file)
            yield batch[["path", "file", "bytes", "error"]]

    store = Store(folder)
    store.fs.create_dir(store.root, recursive=True)
    report, done = f"{folder.rstrip('/')}/{work}/report", f"{folder.rstrip('/')}/_written-{work[9:]}"
    named = images.select(
        F.col(name).alias("path_"), relative(name, base).alias("name_"), "width", "height", "color_space", "pixel_format", "data"
    )
    named.mapInPandas(run, _WRITTEN.replace("file string", "file string, tmp string")).write.parquet(report)
    written = spark.read.schema(_WRITTEN.replace("file string", "file string, tmp string")).parquet(report)
    clash = written.where("file is not null").groupBy("file").count().where("count > 1").orderBy("file").limit(5).collect()
    if clash:
        store.drop(work)
        raise FileExistsError(f"several images would be written as one file: {', '.join(r.file for r in clash)}")
    written.mapInPandas(settle, _WRITTEN).write.parquet(done)
    store.drop(work)
    return spark.read.schema(_WRITTEN).parquet(done)


class _Part(InputPartition):
    def __init__(self, names):
        self.names = names


class TestImages(DataSource):
    """spark.read.format("tst").option("names", "64x64.tst;8x8.random.tst").load()"""

    @classmethod
    def name(cls):
        return "tst"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _TestReader(self.options)


class _TestReader(DataSourceReader):
    def __init__(self, options):
        self.names = [n for n in (options.get("names") or options.get("path") or "").split(";") if n]

    def partitions(self):
        return [_Part([n]) for n in self.names]

    def read(self, partition):
        for n in partition.names:
            w, h, cs, pf, raw = formats.parse_tst(n)
            yield (n, w, h, cs, pf, 0, raw, None)


class ImageFiles(DataSource):
    """Writes rows (path, content) as files below a folder that all executors reach; paths are relative and keep their folders."""

    @classmethod
    def name(cls):
        return "imagefiles"

    def schema(self):
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"])


class _Wrote(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class _FileWriter(DataSourceWriter):
    """Tasks write under names of their own; the commit moves the files, unless two of them have one name."""

    def __init__(self, folder):
        self.folder, self.work = folder, f"_writing-{uuid.uuid4().hex}"

    def write(self, rows):
        store = Store(self.folder)
        return _Wrote([(store.put(f"{self.work}/{uuid.uuid4().hex}", bytes(row.content)), row.path) for row in rows])

    def commit(self, messages):
        store = Store(self.folder)
        files = [f for m in messages for f in (m.files if m else [])]
        names = Counter(store.at(name) for _, name in files)
        if len(names) < len(files):
            store.drop(self.work)
            raise FileExistsError(f"several rows would be written as one file: {', '.join(n for n, k in sorted(names.items()) if k > 1)}")
        for tmp, name in files:
            store.move(tmp, name)
        store.drop(self.work)

    def abort(self, messages):
        Store(self.folder).drop(self.work)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TestImages)
    spark.dataSource.register(ImageFiles)
