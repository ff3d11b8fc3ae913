"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of an Arrow batch: texts are long, and Spark's 10,000 would hold tens of MB on both sides of the pipe to Python.
BATCH = 1000


def small_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batches to BATCH rows, unless they are smaller already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 4


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes.split() splits at just the characters that WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


# ---- vectorised 64-bit hashes -------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_tables["p"]) < n:
        size = len(_tables["p"])
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            _tables[key] = np.concatenate([_tables[key], _tables[key] * np.uint64(pow(base, size, 1 << 64))])
    return _tables["p"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Prefix sums of a sequence, from which the hash of any slice is two look-ups and a product."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        power, self.inverse = _powers(n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values.astype(np.uint64) * power[: n - 1], out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        starts = np.arange(n)
        return self.slices(starts, starts + size)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Longer runs of bytes go by a cryptographic hash: sums of powers modulo 2^64 are equal for some long unlike runs.
_LONG = 64


def long_hash(data: bytes) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), np.uint64)[0]


def run_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run b[start:end] of bytes."""
    out = Rolling(b.astype(np.uint64) + np.uint64(1)).slices(starts, ends)
    for k in np.flatnonzero(ends - starts > _LONG).tolist():
        out[k] = long_hash(b[starts[k] : ends[k]].astype(np.uint8).tobytes())
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8."""
    if not data:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    solid = np.concatenate([[False], ~_SPACE[b], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return run_hashes(b, edges[::2], edges[1::2])


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of batches that are sorted by keys; only one group is held at a time."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        k = batch[keys]
        new = np.flatnonzero((k.to_numpy()[1:] != k.to_numpy()[:-1]).any(axis=1)) + 1
        bounds = [0, *new.tolist(), len(batch)]
        for at, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            part = batch.iloc[a:b]
            if at == 0 and rest and (rest[-1][keys].iloc[-1].to_numpy() == part[keys].iloc[0].to_numpy()).all():
                rest.append(part)
                continue
            if rest:
                yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0].reset_index(drop=True)
            rest = [part]
    if rest:
        yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0].reset_index(drop=True)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by keys, numbers without nulls; no group is cut in two."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*rest, batch])
        columns = [t.column(c).to_numpy() for c in keys]
        other = np.logical_or.reduce([k != k[-1] for k in columns])  # all but the group that may go on
        whole = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if whole:
            yield t.slice(0, whole)
        rest = t.slice(whole).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


_stored: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage cut, columns compressed, its size known.

    The table goes with the driver, or before by ``discard``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(_at_exit, df.sparkSession)
    _stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Removes the tables of ``stored``. Results that are still to be computed from them are lost."""
    jvm = spark.sparkContext._jvm
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    try:
        discard(spark)
    except (Py4JError, OSError, AttributeError):  # the JVM has gone first
        _stored.clear()
