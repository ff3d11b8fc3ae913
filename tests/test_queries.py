"""Every query of the catalogue against its SQL in DuckDB."""

import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from blockweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    plain = frame[sorted(frame.columns)].astype(object)
    return sorted(
        tuple(
            "" if x != x or x is None else str(int(x)) if isinstance(x, (int, float)) and x == int(x) else str(x) for x in r
        ) for r in plain.where(plain.notna(), None).values.tolist()
    )


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    if name == "j4_published_psnr":
        pytest.skip("test_codec has it")
    df = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        assert df.columns and df.limit(1).count() == 1
        return
    got, want = df.toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["i18_color_space", "i20_unsupported"])
def test_all_images(spark, tmp_path, name):
    """Images other than the first are reported too, each in the query by image."""
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 2000")
    moved = [events.withColumn("event_id", events.event_id + 5000 * k) for k in (3, 7)]
    moved[0].unionByName(moved[1]).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for n in (name, f"{name}_by_image"):
        got, want = catalog.queries()[n](spark, str(tmp_path)).toPandas(), c.execute(catalog.oracle_sql()[n]).fetchdf()
        assert rows_of(got) == rows_of(want)
    assert set(got.image_id) == {3, 7}


def test_segment_index_of_many_scans(spark, tmp_path):
    """Scans whose number does not fit the byte of the marker."""
    embeddings = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 150")
    far = [embeddings.withColumn("vec_id", embeddings.vec_id + 64 * k) for k in (0, 254, 4095)]
    far[0].unionByName(far[1]).unionByName(far[2]).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.queries()["i13_segment_index"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(c.execute(catalog.oracle_sql()["i13_segment_index"]).fetchdf())
    assert set(got.scan) == {0, 1, 2, 254, 255, 256, 4095, 4096, 4097}


def test_memory_of_packed_bits(spark, monkeypatch):
    """The functions that the query runs in Python, on a whole Arrow batch of 10,000 blocks each: what they hold beside it."""
    runs = []
    frame = SimpleNamespace(schema=spark.createDataFrame([], "vec_id long").schema)
    frame.select = lambda *_: frame
    frame.mapInPandas = lambda run, _: runs.append(run) or frame
    monkeypatch.setattr(catalog.X, "sample_arrays", lambda *_: frame)
    catalog.queries()["h1_packed_bits"](spark, SF)
    samples = np.random.default_rng(1).integers(0, 256, (10_000, 64), dtype=np.int32)
    batch = pd.DataFrame({"vec_id": np.arange(10_000), "samples": list(samples)})
    assert len(runs) == 2
    for run in runs:
        tracemalloc.start()
        out, most = [], 0
        for part in run(iter([batch])):
            most = max(most, tracemalloc.get_traced_memory()[1])
            out.append(part)
            tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        batch = pd.concat(out, ignore_index=True)
        assert len(batch) == 10_000 and batch.vec_id.tolist() == list(range(10_000))
        assert most - held < 40 << 20, (most, held)


def test_packed_bits_of_many_blocks(spark, tmp_path):
    """Blocks of several slices in one batch."""
    embeddings = spark.read.parquet(f"{SF}/embeddings.parquet")
    moved = embeddings
    for k in range(1, 5):
        moved = moved.unionByName(embeddings.withColumn("vec_id", embeddings.vec_id + 500 * k))
    moved.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("h1_packed_bits", "f9_idct"):
        got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), c.execute(catalog.oracle_sql()[name]).fetchdf()
        assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["f2_f3_dct_quantize_joined", "f9_idct_joined"])
def test_joined_transforms_are_dealt_out(spark, duck, monkeypatch, name):
    """Partitions follow the rows, nothing is summed before the blocks are dealt out, and no other exchange follows."""
    for rows, parts in ((16_000, 2), (3_200, 10)):
        monkeypatch.setattr(catalog.blocks, "ROWS", rows, raising=False)
        df = catalog.queries()[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        above, _, below = plan.partition("Exchange hashpartitioning(vec_id")
        assert f", {parts}), REPARTITION_BY_NUM" in below and "HashAggregate" in above
        assert "Exchange hashpartitioning" not in below and "HashAggregate" not in below
    assert rows_of(df.toPandas()) == rows_of(duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_inverse_transform_deals_out(spark, duck, monkeypatch):
    """Coefficients that are not dealt out by block."""
    monkeypatch.setattr(catalog.blocks, "ROWS", 3_200, raising=False)
    natural = catalog.queries()["f8_dequantize"](spark, SF).join(catalog.blocks.zigzag(spark), "zz").select("vec_id", "k", "c")
    got = catalog.blocks.idct(natural, ("vec_id",))
    assert ", 10), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert rows_of(got.toPandas()) == rows_of(duck.execute(catalog.oracle_sql()["f9_idct_joined"]).fetchdf())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "zz", "coef"] and df.count() == 32000
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Scans read only what they need, and row-wise operators do not shuffle."""
    plan = lambda n: catalog.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("d8_rgb_to_ycbcr_jpeg", "e1_subsample_420", "e2_fan_out", "f1_level_shift", "f2_f3_dct_quantize", "e3_upsample_by_copy"):
        assert "Exchange" not in plan(name), name
    assert "ReadSchema: struct<event_id:bigint,user_id:" in plan("e1_subsample_420").replace("int>", "bigint>") or "event_type" not in plan(
        "e1_subsample_420"
    )
    assert "BroadcastHashJoin" in plan("g10_codewords")
