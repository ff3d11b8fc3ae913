"""Queries that SQL can express, against DuckDB; and the names and columns of all."""

import duckdb
import pytest

from blockweave.llm import queries
from tests.test_queries import SF, TABLES, rows_of

COLUMNS = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_main_text": ["page_id", "url", "text", "n_chars"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"],
    "op9_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    table = "pages" if "page_id" in df.columns else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    types = dict(df.dtypes)
    want = {
        "held_out": "boolean",
        "score": "double",
        "predicted": "int",
        "lang_pred": "string",
        "n_tokens": "bigint",
        "n_chars": "bigint",
        "size": "bigint",
        "source_size": "bigint",
        "target": "double",
        "taken": "bigint",
        "n_words": "bigint",
        "word_chars": "bigint",
        "n_symbols": "bigint",
        "n_dup_lines": "bigint",
        "n_repeat_words": "bigint",
        "base_failed": "boolean",
        "kept": "boolean",
    }
    assert all(types[k] == v for k, v in want.items() if k in types)


def test_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
