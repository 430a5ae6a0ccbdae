"""Resampling and indirect effects on centred moments: trees walked by hand, shifted columns, awkward samples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.base import table
from opinara.operators import mediation as M
from opinara.operators import resampling as B
from opinara.operators import splitting, stacks
from opinara.operators.moments import Moments

STAT = M.Parallel(("x",), ("m1", "m2"), "y", ("c",))
SERIAL = M.Serial(("x",), ("m1", "m2"), "y", ("c",))
PARTS = M.Components(("x",), ("m1", "m2"), "y", ("c",))


def sample(n=2000, shift=0.0, seed=3):
    rng = np.random.default_rng(seed)
    x, c = rng.normal(size=n), rng.normal(size=n)
    m1 = 0.5 * x + rng.normal(size=n)
    m2 = 0.3 * x - 0.4 * m1 + rng.normal(size=n)
    y = 0.4 * m1 - 0.7 * m2 + 0.2 * c + rng.normal(size=n)
    # Steps of 2**-24 are exact at every shift used here, so the shifted columns hold the same numbers.
    grid = lambda v: np.round(v * 2**24) / 2**24
    return pd.DataFrame({"id": np.arange(n), "x": grid(x) + shift, "c": grid(c), "m1": grid(m1) + shift, "m2": grid(m2), "y": grid(y)})


def plain_counts(n, seed, reps, leaf):
    """Counts of all rows, from the root down, without memory."""
    out = np.zeros((len(reps), n), np.int64)

    def walk(low, high, draws):
        if high - low <= leaf:
            row = splitting.generator(seed, low, high, int(reps[0]), True).integers(0, high - low, int(draws.sum()))
            for r, part in enumerate(np.split(row, np.cumsum(draws)[:-1])):
                for i in part:
                    out[r, low + i] += 1
            return
        middle = (low + high) // 2
        left = splitting.generator(seed, low, high, int(reps[0]), False).binomial(draws, (middle - low) / (high - low))
        walk(low, middle, left)
        walk(middle, high, draws - left)

    walk(0, n, np.full(len(reps), n))
    return out


@pytest.mark.parametrize(("n", "leaf"), [(1, 4), (5, 1), (103, 8), (64, 64)])
def test_counts_are_those_of_the_whole_tree(n, leaf):
    reps = np.arange(6)
    want = plain_counts(n, 42, reps, leaf)
    assert (want.sum(axis=1) == n).all()
    split = splitting.Splitter(n, 42, leaf)
    # Any order of the rows, in pieces, and with nodes forgotten on the way.
    for ids in (np.arange(n), np.random.default_rng(1).permutation(n), np.arange(n)[::-1][: max(1, n // 3)]):
        got = np.zeros((len(reps), len(ids)), np.int64)
        for at, w in split(reps, ids):
            got[:, at] = w
        assert (got == want[:, ids]).all()
        split.known.clear()


def test_counts_are_a_fair_multinomial():
    reps, n = np.arange(4000), 37
    counts = np.concatenate([plain_counts_fast(n, 7, reps[i : i + 250]) for i in range(0, 4000, 250)])
    assert np.abs(counts.mean(axis=0) - 1).max() < 0.08
    assert np.abs(counts.var(axis=0) - (1 - 1 / n)).max() < 0.15
    cov = np.cov(counts.T)
    assert np.abs(cov[~np.eye(n, dtype=bool)] + 1 / n).max() < 0.08


def plain_counts_fast(n, seed, reps):
    out = np.zeros((len(reps), n), np.int64)
    for at, w in splitting.Splitter(n, seed, 5)(reps, np.arange(n)):
        out[:, at] = w
    return out


def refit(d):
    fit = lambda y, x: dict(zip(["_", *x], np.linalg.lstsq(np.column_stack([np.ones(len(d)), d[x]]), d[y], rcond=None)[0]))
    b = fit("y", ["x", "m1", "m2", "c"])
    return {f"ind|{m}|x": fit(m, ["x", "c"])["x"] * b[m] for m in ("m1", "m2")}


def test_split_bootstrap_equals_refits(spark, monkeypatch):
    monkeypatch.setattr(splitting, "LEAF", 32)
    monkeypatch.setattr(stacks, "REP_BLOCK", 4)
    data = sample(300)
    data.loc[5, "m1"] = np.nan
    whole = data.dropna().reset_index(drop=True)
    split = lambda n, seed: splitting.Splitter(n, seed, 32)
    monkeypatch.setattr(B, "Splitter", split)
    for parts in (1, 7):
        frame = spark.createDataFrame(data).repartition(parts)
        draws = B.bootstrap(frame, STAT, 10, 11, ["id"])
        got = {(r.rep, r.stat): r.value for r in draws.collect()}
        sums = B.replicate_moments and stacks.replicate_sums(B.split_moments(frame, STAT.cols(), ["id"], 10, 11)).collect()
        assert {r.rep: r.sw for r in sums} == {r: float(len(whole)) for r in range(10)}
        for first in (0, 4, 8):
            reps = np.arange(first, min(first + 4, 10))
            for rep, w in zip(reps.tolist(), plain_counts(len(whole), 11, reps, 32)):
                for stat, value in refit(whole.iloc[np.repeat(np.arange(len(whole)), w)]).items():
                    assert got[rep, stat] == pytest.approx(value, abs=1e-9)


def test_no_draw_is_shuffled(spark):
    frame = spark.createDataFrame(sample(500))
    plan = B.bootstrap(frame, STAT, 50, 1, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "idx" not in plan and "Join" not in plan.replace("BroadcastHashJoin", "").replace("BroadcastNestedLoopJoin", "")
    # Two exchanges add the stacks up; each task hands on one row per block of replicates.
    assert plan.count("Exchange hashpartitioning(block") == 2


@pytest.mark.parametrize("shift", [1e6, 1e8])
def test_shifted_columns_give_the_same_results(spark, shift):
    plain, moved = spark.createDataFrame(sample()), spark.createDataFrame(sample(shift=shift))
    rows = lambda frame, *keys: {tuple(r[k] for k in keys): r for r in frame.collect()}
    for stat in (STAT, SERIAL, PARTS):
        a, b = rows(M.estimate(plain, stat), "stat"), rows(M.estimate(moved, stat), "stat")
        assert len(a) == len(stat.names()) and any(abs(r.value) > 0.1 for r in a.values())
        for k, r in a.items():
            assert b[k].value == pytest.approx(r.value, rel=1e-8, abs=1e-9)
    for method in ("exact", "poisson"):
        a, b = (rows(B.bootstrap(f, STAT, 20, 5, ["id"], method), "rep", "stat") for f in (plain, moved))
        assert all(b[k].value == pytest.approx(r.value, rel=1e-8, abs=1e-8) for k, r in a.items())
    a, b = (rows(B.acceleration(B.jackknife_moments(f, STAT)), "stat") for f in (plain, moved))
    assert all(b[k].accel == pytest.approx(r.accel, rel=1e-6, abs=1e-8) for k, r in a.items()) and a
    draws = [B.bootstrap(f, STAT, 60, 5, ["id"]) for f in (plain, moved)]
    ends = [rows(B.bca_ci(d, M.estimate(f, STAT), B.jackknife_moments(f, STAT)), "stat") for d, f in zip(draws, (plain, moved))]
    for k, r in ends[0].items():
        assert (ends[1][k].ci_low, ends[1][k].ci_high) == (pytest.approx(r.ci_low, rel=1e-7, abs=1e-8), pytest.approx(r.ci_high, rel=1e-7, abs=1e-8))


def test_near_dependent_designs_raise_and_dependent_ones_share(spark):
    data = sample(400)
    near = spark.createDataFrame(data.assign(c=data.x + 1e-6 * data.c))
    for run in (lambda: M.estimate(near, STAT), lambda: B.bootstrap(near, STAT, 4, 1, ["id"])):
        with pytest.raises(Exception, match="ill-conditioned"):
            run().collect()
    with pytest.raises(Exception, match="ill-conditioned"):
        B.jackknife_moments(near, STAT).collect()
    twin = spark.createDataFrame(data.assign(c=2 * data.x))
    alone = M.Parallel(("x",), ("m1", "m2"), "y")
    want = {r.stat: r.value for r in M.estimate(spark.createDataFrame(data), alone).collect()}
    got = {r.stat: r.value for r in M.estimate(twin, STAT).collect()}
    # x and c = 2x share the effect of x by the scaled pseudo-inverse: half each after scaling.
    assert got["b|m1"] == pytest.approx(want["b|m1"]) and got["ind|m1|x"] == pytest.approx(want["ind|m1|x"] / 2)


def test_stacks_merge_and_lose_rows():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(90, 4)) * [1, 5, 1e-3, 1] + [0, 1e7, 3, 0], rng.integers(0, 4, size=(6, 90)).astype(float)
    w[2, :40] = 0
    w[3] = 0
    whole, cut = stacks.Stack.of(x, w), stacks.Stack.of(x[:40], w[:, :40]) + stacks.Stack.of(x[40:], w[:, 40:])
    for r in (0, 1, 2, 4, 5):
        rows = np.repeat(x, w[r].astype(int), axis=0)
        for s in (whole, cut):
            assert s.sw[r] == len(rows) and s.n[r] == (w[r] > 0).sum()
            assert s.mean[r] == pytest.approx(rows.mean(axis=0))
            assert s.s[r] == pytest.approx(np.cov(rows.T, bias=True) * len(rows), rel=1e-7, abs=1e-7)
    assert whole.sw[3] == cut.sw[3] == 0
    less = stacks.without_each(Moments.of(x, np.ones(90)), x)
    for i in (0, 17, 89):
        rest = np.delete(x, i, axis=0)
        assert less.mean[i] == pytest.approx(rest.mean(axis=0)) and less.s[i] == pytest.approx(np.cov(rest.T, bias=True) * 89, rel=1e-6, abs=1e-6)


def test_tiny_and_empty_samples(spark):
    one = spark.createDataFrame(sample(1))
    none = one.filter(F.lit(False))
    assert B.jackknife_moments(one, STAT).count() == 0 and B.jackknife_moments(none, STAT).count() == 0
    assert M.estimate(none, STAT).count() == 0 and B.bootstrap(none, STAT, 3, 1, ["id"]).count() == 0
    assert {r.value for r in B.bootstrap(one, M.Mean(("y",)), 3, 1, ["id"]).collect()} == {one.first().y}
    with pytest.raises(ValueError):
        B.bootstrap(one, STAT, 3, 1, ["id"], "other")


def test_draws_by_hash_are_not_broadcast(spark):
    rows = spark.createDataFrame(sample(500)[["id", "x", "y"]])
    plan = B.hashed_moments(rows, ["x", "y"], ["id"], 4, 7)._jdf.queryExecution().executedPlan().toString()
    # The draws are known by their row and replicate; the offsets of the dense index may be broadcast.
    assert "SortMergeJoin [idx" in plan


def test_the_design_is_joined_without_a_broadcast(spark, tmp_path):
    spark.sql(
        """SELECT id AS l_partkey, 1.0D AS l_quantity, 0.1D AS l_discount, 0.1D AS l_tax, 10000.0D * id AS l_extendedprice
        FROM range(1, 5)"""
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(
        "SELECT id AS p_partkey, 'b' AS p_brand, cast(id AS int) AS p_size, 1000.0D AS p_retailprice FROM range(2, 7)"
    ).write.parquet(f"{tmp_path}/part.parquet")
    rows = table(spark, str(tmp_path), "design")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # However few parts Spark sees in the files, they do not pass the driver.
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.product_id, r.spend) for r in rows.collect()) == [(2, 2.0), (3, 3.0), (4, 4.0)]
