"""Quality rules: base counts and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Texts become lower-case tokens, runs of word characters or of other visible characters; each token and each pair of
neighbours falls by hash into one of ``BUCKETS`` buckets. Two multinomials over the buckets are counted, one over every
document (raw) and one over trusted documents (target). A document's verdict is its mean log ratio per n-gram
against a fixed threshold, so it depends on nothing but the text and the two tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import mix, run_hashes, small_batches, table, words

BUCKETS = 1 << 14
#: Most trusted documents that the target multinomial is fitted on, drawn by a hash of the id.
TRUSTED = 20_000
#: Mean log ratio per n-gram below which a document goes.
THRESHOLD = -0.35
#: Counts that the target multinomial borrows from the raw one: without evidence a ratio stays near 0.
PRIOR = 2 * BUCKETS
MIN_WORDS, MAX_REPEAT = 50, 50

_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 word character, 2 other
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SYMBOLS = b"#*$%&|<>"


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each token and of each pair of neighbouring tokens."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    kind = np.concatenate([[0], _CLASS[data], [0]])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    starts = edge[kind[edge + 1] != 0]
    ends = edge[kind[edge] != 0]
    one = run_hashes(_LOWER[data], starts, ends)
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws = words(text)
    if not ws:
        return 0, 0, sum(map(text.count, _SYMBOLS.decode())) if text else 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(data.count(c) for c in (bytes([x]) for x in _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeat = 0
    if len(ws) > 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws))
        pairs = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
        often = counts[inverse] > 1
        covered = np.zeros(len(ws), bool)
        for k in range(3):
            covered[k : k + len(often)] |= often
        repeat = int(covered.sum())
    return len(ws), chars, symbols, len(lines) - len(set(lines)), repeat


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted: int = TRUSTED, buckets: int = BUCKETS
) -> np.ndarray:
    """Log ratio of each bucket. Raw counts cover every row of df; at most ``trusted`` labelled ids feed the target."""
    small_batches(df)
    ids = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("trusted_id")).distinct()
    ids = ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(trusted)  # so the broadcast below has a fixed bound
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = texts.join(F.broadcast(ids), F.col("id") == F.col("trusted_id"), "left").select(
        "text", F.col("trusted_id").isNotNull().alias("target")
    )

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, is_target in zip(batch.text, batch.target, strict=True):
                if text:
                    found = np.bincount(ngram_buckets(text, buckets), minlength=buckets)
                    raw += found
                    if is_target:
                        target += found
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})

    counted = marked.mapInPandas(count, "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most one row a bucket
    raw, target = np.ones(buckets), np.zeros(buckets)
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    share = raw / raw.sum()
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)


def _verdict(text: str | None, model: np.ndarray, threshold: float, buckets: int) -> bool:
    counts = base_counts(text)
    if counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]:
        return False
    found = ngram_buckets(text, buckets)
    return bool(model[found].sum() / len(found) >= threshold)


def quality_rules(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED
) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept: one row a row of df.

    A null or empty text has no words and fails the base rules. Repeated rows each give their row; a null id is
    scored like any other. Without trusted documents every ratio is 0 and only the base rules reject. An empty table
    gives no rows. Other columns are not looked at, so their names cannot clash.
    """
    model = fit(df, labels, id_col, text_col, trusted, buckets).astype(np.float64)
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"
    id_type = df.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            out = []
            for text in batch.text:
                counts = base_counts(text)
                found = ngram_buckets(text, buckets)
                llr = float(model[found].sum() / len(found)) if len(found) else 0.0
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]
                out.append((*counts, llr, failed, not failed and llr >= threshold))
            frame = pd.DataFrame(
                out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
            )
            frame.insert(0, "id", batch.id.to_numpy())
            yield frame

    scored = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(score, f"id {id_type}, {schema}")
    return scored.withColumnRenamed("id", id_col)


def keep_good(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED
) -> DataFrame:
    """The rows of df that quality_rules keeps, with all their columns, without a join."""
    model = fit(df, labels, id_col, text_col, trusted, buckets).astype(np.float64)
    at = df.columns.index(text_col)

    def passing(batches):
        for batch in batches:
            yield batch.filter(pa.array([_verdict(t, model, threshold, buckets) for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(passing, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
