"""The corpus pipeline: quality rules, line dedup, near duplicates, source mixing and BPE over ``documents``.

Each stage takes what the one before it kept. All but the last return the columns of ``documents``; n_chars follows
the text. Between stages the rows go through a Parquet table. Columns other than those of ``documents`` are left behind by each
stage, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.llm import bpe, jaccard, lines, mixing, quality
from blockweave.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go.

    A null or empty text has no words, so its document goes; null ids, languages and sources stay as they are, and rows
    repeated in full share their verdict.
    """
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go from the texts; a document of which nothing is left goes with them.

    The first place of a chunk by id, null last, keeps it; rows that repeat an id and text are one document and all stay or go. A
    null or empty text has no chunk and stays.
    """
    out = lines.line_dedup(docs, keep=("lang", "source"))
    out = out.where((F.col("n_removed_chunks") == 0) | (F.length("text") > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the least id.

    Of rows that share this id the one with the least text stays, null first. Null and empty texts are copies of each other. A
    row without an id stays only if no row of its class has one.
    """
    keepers = jaccard.near_duplicates(docs).select("keeper").distinct()
    own = docs.select(*COLUMNS, jaccard.node_id("doc_id", "text").alias("nid"))
    left = own.join(keepers, F.col("nid") == F.col("keeper"), "left_semi")
    first = Window.partitionBy("nid").orderBy("text", "lang", "source", "n_chars")
    return left.withColumn("copy", F.row_number().over(first)).where("copy = 1").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, 0 to 3 times.

    A null or empty text is never taken; a null source is a source of its own, a null id takes part. Of rows repeated in full one
    stands as often as all of them are taken.
    """
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("tid"), "h")
    taken = taken.agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    taken = stored(taken.where("copies > 0"))
    own = docs.select(*COLUMNS, mixing.row_hash("doc_id", "text").alias("own_h"))
    match = F.col("doc_id").eqNullSafe(F.col("tid")) & (F.col("own_h") == F.col("h"))
    out = own.join(taken.where("rows = 1"), match).select(*COLUMNS, "copies")
    repeated = taken.where("rows > 1")
    if not repeated.isEmpty():  # rows repeated in full: one of them stands for all
        out = out.unionByName(own.join(repeated, match).dropDuplicates(["doc_id", "own_h"]).select(*COLUMNS, "copies"))
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: a row for each row; a null or empty text has no tokens, and a null id stays null."""
    coded = bpe.bpe(docs, bpe.tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mix sources", mix_sources),
    ("encode", encode),
]

#: SQL can express neither the log-likelihood ratio over hashes, nor the cube method, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
