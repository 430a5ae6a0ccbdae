"""Correlations of wide tables and appends that can be run again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.operators import pairwise
from opinara.operators.summary import corr_matrix
from opinara.session import scratch_path
from opinara.sources.writers import append_results


def wide(spark, n, k, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + rng.choice([0, 1e7], k)
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 1] = 3.0
    x[2:, 2] = np.nan
    return x


def test_768_columns_with_nulls(spark):
    x = wide(spark, 400, 768)
    cols = [f"v{i}" for i in range(768)]
    frame = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(6).select(*[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    got = corr_matrix(frame, cols).toPandas()
    assert len(got) == 768 * 768
    r = got.pivot(index="a", columns="b", values="r").loc[cols, cols].to_numpy(dtype=float)
    want = pd.DataFrame(x, columns=cols).corr(min_periods=2).to_numpy().copy()
    want[1, :] = want[:, 1] = np.nan
    # Two rows only: what pairs with column 2 has few rows or none.
    want[2, :], want[:, 2], r[2, :], r[:, 2] = 0, 0, 0, 0
    assert np.array_equal(np.isnan(r), np.isnan(want)) and np.nanmax(np.abs(r - want)) < 1e-8


def test_parts_merge(spark):
    x = wide(spark, 90, 6)
    whole, cut = pairwise.Pairs.of(x), pairwise.Pairs.of(x[:30]) + pairwise.Pairs.of(x[30:31]) + pairwise.Pairs.of(x[31:])
    assert np.allclose(whole.correlations(), cut.correlations(), atol=1e-9, equal_nan=True)
    assert np.allclose(whole.correlations(), whole.correlations().T, equal_nan=True)


def test_narrow_and_empty(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, 5.0), (float("nan"), 6.0)], "a double, b double")
    assert {(r.a, r.b, r.r) for r in corr_matrix(frame, ["a", "b"]).collect()} == {("a", "a", 1.0), ("b", "b", 1.0), ("a", "b", None), ("b", "a", None)}
    assert {r.r for r in corr_matrix(frame.limit(0), ["a", "b"]).collect()} <= {None}
    assert corr_matrix(frame, []).count() == 0


def test_a_batch_written_twice_leaves_one_copy(spark):
    path = scratch_path(spark, "batches")
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    append_results(rows.filter("id < 6"), path, 0)
    append_results(rows.filter("id >= 6"), path, 1)
    append_results(rows.filter("id < 6"), path, 0)
    back = spark.read.parquet(path)
    assert sorted((r.id, r.batch) for r in back.collect()) == [(i, int(i >= 6)) for i in range(10)]
    append_results(rows.filter("id < 0"), path, 0)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [6, 7, 8, 9]
    with pytest.raises(ValueError):
        append_results(rows.withColumn("batch", F.lit(1)), path, 2)
