"""Models, resampling and multiple testing against numpy."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.functions.distributions import f_upper, f_uppers, normal_quantile, t_quantile, t_two_sided, t_two_sideds
from opinara.functions.hashing import MOD, hash_np, poisson_np
from opinara.operators import gram as G
from opinara.operators import mediation as M
from opinara.operators import multiple_testing as MT
from opinara.operators import quantiles as Q
from opinara.operators import regression as R
from opinara.operators import resampling as B
from opinara.operators import vectors as OV
from opinara.session import pin

N = 300


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 14))
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(14)])
    pdf["m1"] = 0.5 * pdf.x0 - 0.3 * pdf.x1 + rng.normal(size=N)
    pdf["m2"] = 0.4 * pdf.x0 + 0.2 * pdf.m1 + rng.normal(size=N)
    pdf["y"] = 0.3 * pdf.m1 - 0.2 * pdf.m2 + 0.1 * pdf.x2 + rng.normal(size=N) * (1 + 0.5 * np.abs(pdf.x0))
    pdf["w"] = rng.integers(1, 9, size=N).astype(float)
    pdf["id"] = np.arange(N)
    pdf.loc[3, "m1"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(5).cache()


def hc1(pdf, y, x, w=None):
    d = pdf.dropna(subset=[y, *x])
    z = np.column_stack([np.ones(len(d)), d[list(x)].to_numpy()])
    w = np.ones(len(d)) if w is None else d[w].to_numpy()
    xtx = np.linalg.pinv(z.T @ (z * w[:, None]))
    beta = xtx @ z.T @ (w * d[y].to_numpy())
    e = d[y].to_numpy() - z @ beta
    ze = z * (w * e)[:, None]
    n, k = z.shape
    v = n / (n - k) * xtx @ (ze.T @ ze) @ xtx
    return beta, np.sqrt(np.diag(v)), n


@pytest.mark.parametrize("x", [("x0", "x1"), tuple(f"x{i}" for i in range(14))])
@pytest.mark.parametrize("w", [None, "w"])
def test_hc1(df, data, x, w):
    """Native sums (few columns) and matrix products (many) give numpy's answer."""
    rows = {r["term"]: r for r in R.ols(df, [R.Spec("a", "m1", x), R.Spec("b", "y", x)], weight=w).filter("spec = 'a'").collect()}
    beta, se, n = hc1(data, "m1", x, w)
    for i, term in enumerate([G.CONST, *x]):
        assert rows[term]["beta"] == pytest.approx(beta[i], abs=1e-9)
        assert rows[term]["se"] == pytest.approx(se[i], abs=1e-9)
        assert rows[term]["n"] == n


def test_thresholds_match_filters(df, data):
    models = [R.Spec("m", "y", ("x0", "x1"))]
    got = R.ols_thresholds(df, models, "w", [3, 6]).collect()
    for cut in (3, 6):
        beta, se, n = hc1(data[data.w >= cut], "y", ("x0", "x1"))
        row = next(r for r in got if r["cutoff"] == cut and r["term"] == "x0")
        assert (row["beta"], row["se"], row["n"]) == (pytest.approx(beta[1]), pytest.approx(se[1]), n)


def test_rank_deficient_uses_pseudo_inverse(df, data):
    d = df.withColumn("x0b", F.col("x0") * 2)
    rows = {r["term"]: r["beta"] for r in R.ols(d, [R.Spec("m", "y", ("x0", "x0b"))], cov="classic").collect()}
    single = {r["term"]: r["beta"] for r in R.ols(d, [R.Spec("m", "y", ("x0",))], cov="classic").collect()}
    assert rows["x0"] + 2 * rows["x0b"] == pytest.approx(single["x0"])


def test_vif_equals_regression(df, data):
    x = ("x0", "m1", "m2")
    got = {r["variable"]: r["vif"] for r in R.vif(df, x).collect()}
    d = data.dropna()
    for c in x:
        others = [o for o in x if o != c]
        z = np.column_stack([np.ones(len(d)), d[others]])
        e = d[c] - z @ np.linalg.lstsq(z, d[c], rcond=None)[0]
        assert got[c] == pytest.approx(1 / (e.var() / d[c].var()))


def test_single_factor(df, data):
    d = data[["x0", "m1", "m2", "y"]].dropna()
    vals = np.linalg.eigvalsh(np.corrcoef(d.T))
    row = R.single_factor(df, ["x0", "m1", "m2", "y"]).first()
    assert row["first_factor_pct"] == pytest.approx(vals[-1] / 4 * 100)


def lstsq(d, y, x):
    z = np.column_stack([np.ones(len(d)), d[list(x)]])
    return dict(zip(["c", *x], np.linalg.lstsq(z, d[y].to_numpy(), rcond=None)[0]))


STAT = M.Parallel(("x0", "x1"), ("m1", "m2"), "y", ("x2",))


def parallel_np(d):
    b = lstsq(d, "y", ["x0", "x1", "m1", "m2", "x2"])
    a = {m: lstsq(d, m, ["x0", "x1", "x2"]) for m in ("m1", "m2")}
    ind = [a[m][x] * b[m] for m in ("m1", "m2") for x in ("x0", "x1")]
    t = [abs(ind[0]) + abs(ind[1]), abs(ind[2]) + abs(ind[3])]
    return np.array([*ind, b["m1"], b["m2"], *t, t[0] - t[1]])


def test_parallel(df, data):
    got = {r["stat"]: r["value"] for r in M.estimate(df, STAT).collect()}
    want = parallel_np(data.dropna())
    assert [got[n] for n in STAT.names()] == pytest.approx(list(want))


def test_serial(df, data):
    stat = M.Serial(("x0", "x1"), ("m1", "m2"), "y", ("x2",))
    got = {r["stat"]: r["value"] for r in M.estimate(df, stat).collect()}
    d = data.dropna()
    a, link = lstsq(d, "m1", ["x0", "x1", "x2"]), lstsq(d, "m2", ["x0", "x1", "x2", "m1"])["m1"]
    b = lstsq(d, "y", ["x0", "x1", "x2", "m1", "m2"])["m2"]
    assert got["serial|x1"] == pytest.approx(a["x1"] * link * b)
    assert got["serial_total"] == pytest.approx((a["x0"] + a["x1"]) * link * b)


def test_exact_bootstrap_redrawn(df, data):
    d = data.dropna().reset_index(drop=True)
    n, draw = len(d), np.arange(len(d), dtype=np.int64)
    rows = B.bootstrap(df, STAT, 5, 11, ["id"], "hashed").collect()
    got = {(r["rep"], r["stat"]): r["value"] for r in rows}
    for rep in range(5):
        idx = (hash_np(11, np.int64(rep), 2 * draw) * MOD + hash_np(11, np.int64(rep), 2 * draw + 1)) % n
        want = parallel_np(d.iloc[idx])
        assert [got[(rep, s)] for s in STAT.names()] == pytest.approx(list(want), abs=1e-9)


def test_poisson_bootstrap_redrawn(df, data):
    d = data.dropna().reset_index(drop=True)
    got = {(r["rep"], r["stat"]): r["value"] for r in B.bootstrap(df, STAT, 5, 11, ["id"], "poisson").collect()}
    for rep in range(5):
        w = poisson_np(hash_np(11, np.int64(rep), d["id"].to_numpy()))
        want = parallel_np(d.iloc[np.repeat(np.arange(len(d)), w)])
        assert [got[(rep, s)] for s in STAT.names()] == pytest.approx(list(want), abs=1e-9)


def test_jackknife_downdate_equals_refit(df, data):
    d = data.dropna().reset_index(drop=True)
    full = parallel_np(d)
    loo = np.array([parallel_np(d.drop(i)) for i in range(len(d))]) - full
    rows = {r["stat"]: r for r in B.jackknife_moments(df, STAT).collect()}
    for j, s in enumerate(STAT.names()):
        assert rows[s]["s1"] == pytest.approx(loo[:, j].sum(), abs=1e-9)
        assert rows[s]["s2"] == pytest.approx((loo[:, j] ** 2).sum(), rel=1e-6)
    accel = {r["stat"]: r["accel"] for r in B.acceleration(B.jackknife_moments(df, STAT)).collect()}
    dev = loo.mean(axis=0) - loo
    want = (dev**3).sum(axis=0) / (6 * (dev**2).sum(axis=0) ** 1.5)
    assert [accel[s] for s in STAT.names()] == pytest.approx(list(want), abs=1e-8)


def test_bca_centred_symmetric_is_percentile(spark):
    v = np.linspace(-1, 1, 401)
    draws = spark.createDataFrame(pd.DataFrame({"rep": range(401), "stat": "s", "value": v}))
    point = spark.createDataFrame([("s", 0.0)], "stat string, value double")
    flat = spark.createDataFrame([("s", 100, 0.0, 1.0, 0.0)], "stat string, n long, s1 double, s2 double, s3 double")
    row = B.bca_ci(draws, point, flat).first()
    assert (row["z0"], row["accel"]) == (pytest.approx(0, abs=1e-12), 0.0)
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(np.quantile(v, 0.025)), pytest.approx(np.quantile(v, 0.975)))


def test_bca_formula(spark):
    """Skewed draws with ties: bias and acceleration move both ends as the textbook formula says."""
    nd = NormalDist()
    rng = np.random.default_rng(8)
    v = rng.exponential(size=500).round(2)
    theta, n, s1, s2, s3 = 0.8, 120, 0.4, 0.09, 0.004
    draws = spark.createDataFrame(pd.DataFrame({"rep": range(500), "stat": "s", "value": v}))
    point = spark.createDataFrame([("s", theta)], "stat string, value double")
    moments = spark.createDataFrame([("s", n, s1, s2, s3)], "stat string, n long, s1 double, s2 double, s3 double")
    m = s1 / n
    central2, central3 = s2 - n * m**2, s3 - 3 * m * s2 + 3 * m**2 * s1 - n * m**3
    a = -central3 / (6 * central2**1.5)
    z0 = nd.inv_cdf(((v < theta).sum() + (v == theta).sum() / 2) / 500)
    ends = [np.quantile(v, nd.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (nd.inv_cdf(0.025), nd.inv_cdf(0.975))]
    row = B.bca_ci(draws, point, moments).first()
    assert (row["z0"], row["accel"]) == (pytest.approx(z0), pytest.approx(a))
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(ends[0]), pytest.approx(ends[1]))


def test_zero_vector_fails(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, v array<float>")
    cents = spark.createDataFrame(
        [("c", "positive", [1.0, 0.0]), ("c", "negative", [0.0, 1.0])], "concept_id string, prompt_polarity string, centroid array<double>"
    )
    good = OV.concept_scores(vecs.filter("id = 1"), cents, "id", "v").first()
    assert (good["sim_pos"], good["sim_neg"], good["score"]) == (1.0, 0.0, 1.0)
    with pytest.raises(Exception, match="zero vector"):
        OV.concept_scores(vecs, cents, "id", "v").collect()


def bh(p):
    p = np.asarray(p)
    order = np.argsort(p)[::-1]
    ranks = np.arange(len(p), 0, -1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(p[order] * len(p) / ranks), 1)
    return out


@pytest.mark.parametrize("blocks", [2, 7, 64])
def test_fdr_hot_family(spark, blocks):
    """One family holds most rows, with ties, zeros and ones; any block count gives the textbook values."""
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.beta(0.3, 2, 700).round(3), [0.0] * 60, [1.0] * 40, [0.2], rng.uniform(size=30)])
    fam = np.array(["hot"] * 800 + ["single"] + ["small"] * 30)
    pdf = pd.DataFrame({"i": range(len(p)), "fam": fam, "p": p})
    sdf = spark.createDataFrame(pdf)
    got = MT.fdr_bh(sdf, "p", ["fam"], blocks=blocks).toPandas().sort_values("i")["p_bh"].to_numpy()
    got_by = MT.fdr_by(sdf, "p", ["fam"], blocks=blocks).toPandas().sort_values("i")["p_by"].to_numpy()
    for f in set(fam):
        m = fam == f
        assert got[m] == pytest.approx(bh(p[m]))
        c = sum(1 / i for i in range(1, m.sum() + 1))
        assert got_by[m] == pytest.approx(np.minimum(1, bh(p[m]) * c))
    assert (got >= p - 1e-12).all()


@pytest.mark.parametrize("blocks", [2, 5, 40])
def test_exact_quantiles_hot_group(spark, blocks):
    rng = np.random.default_rng(2)
    g = np.array(["hot"] * 900 + ["a"] * 50 + ["one"])
    v = np.concatenate([np.where(rng.uniform(size=900) < 0.4, 7.0, rng.normal(size=900)), rng.normal(size=50), [3.0]])
    sdf = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    rows = {r["g"]: r for r in Q.exact_quantiles(sdf, ["g"], "v", [0.0, 0.25, 0.5, 0.975, 1.0], blocks=blocks).collect()}
    for name in ("hot", "a", "one"):
        want = np.quantile(v[g == name], [0.0, 0.25, 0.5, 0.975, 1.0])
        assert [rows[name][f"q_{i}"] for i in range(5)] == pytest.approx(list(want))


def test_pca_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    sdf = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<float>")
    got = OV.pca_scores(sdf, "id", "v", 3).toPandas().sort_values("id")[["z_pc1", "z_pc2", "z_pc3"]].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u = np.linalg.svd(z, full_matrices=False)[0][:, :3]
    corr = np.abs([np.corrcoef(got[:, i], u[:, i])[0, 1] for i in range(3)])
    assert corr == pytest.approx([1, 1, 1], abs=1e-5)
    assert np.cov(got.T) == pytest.approx(np.eye(3), abs=0.02)


def test_distributions_of_arrays():
    rng = np.random.default_rng(4)
    t, df = rng.normal(size=400) * 4, rng.integers(0, 60, 400).astype(float)
    t[:3] = [0.0, np.nan, 1e9]
    assert t_two_sideds(t, df) == pytest.approx([t_two_sided(a, b) for a, b in zip(t, df)], abs=1e-12, nan_ok=True)
    assert f_uppers(t**2, 3, df) == pytest.approx([f_upper(a, 3, b) for a, b in zip(t**2, df)], abs=1e-12, nan_ok=True)


def test_distributions():
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert normal_quantile(0.975) == pytest.approx(1.959963985)
    assert math.isinf(normal_quantile(0.0))


def test_groups_fit_on_executors(spark, data, monkeypatch):
    """Groups of any size, null and tiny ones included, against numpy one by one; nothing of them comes to the driver."""
    from opinara.operators import moments as MO

    pdf = data.assign(g=np.where(np.arange(N) < 120, "hot", np.array([f"g{i % 9}" for i in range(N)])))
    pdf.loc[200:203, "g"] = None
    pdf = pd.concat([pdf, pdf.iloc[:2].assign(g="two"), pdf.iloc[[3]].assign(g="none")], ignore_index=True)
    frame = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    models = [R.Spec("a", "m1", ("x0", "x1")), R.Spec("b", "y", ("x0", "x2", "m1"))]
    for flush, short in ((2048, 48), (3, 0), (3, 10**9)):
        monkeypatch.setattr(MO, "FLUSH", flush)
        monkeypatch.setattr(MO, "SHORT", short)
        rows = {(r.g, r.spec, r.term): r for r in R.ols(frame, models, weight="w", by="g").collect()}
        for g, part in pdf.groupby("g", dropna=False):
            g = None if pd.isna(g) else g
            for m in models:
                if not len(part.dropna(subset=[*m.x, m.y])):
                    assert (g, m.name, "x0") not in rows
                    continue
                if len(part.dropna(subset=[*m.x, m.y])) > len(m.x) + 1:
                    beta, se, n = hc1(part, m.y, m.x, "w")
                    for i, term in enumerate([G.CONST, *m.x]):
                        r = rows[g, m.name, term]
                        assert (r.beta, r.se, r.n) == (pytest.approx(beta[i], abs=1e-8), pytest.approx(se[i], abs=1e-8), n)
                else:
                    assert rows[g, m.name, "x0"].t is None
    plain = {(r.g, r.term): r.se for r in R.ols(frame, models[:1], cov="classic", by="g").collect()}
    assert plain["hot", "x0"] > 0
    near = frame.filter("g = 'hot'").withColumn("x1", F.when(F.col("g") == "hot", F.col("x0") + 1e-6 * F.col("x1")).otherwise(F.col("x1")))
    assert {r.beta for r in R.ols(near, models[:1], by="g").collect()} == {None}


def test_many_groups(spark):
    """200,000 groups of five rows: all have a fit, and a few are checked."""
    n = 200_000
    rows = spark.range(5 * n).select(
        (F.col("id") % n).alias("g"), F.rand(1).alias("x"), F.randn(2).alias("e"), (F.col("id") % n).cast("double").alias("size")
    ).withColumn("y", F.col("size") + F.col("x") * (F.col("g") % 7) + 1e-3 * F.col("e"))
    fits = pin(R.ols(rows, [R.Spec("m", "y", ("x",))], by="g"))
    got = fits.filter("term = 'x'").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("beta") - F.col("g") % 7)).alias("off"), F.sum("n").alias("rows")).first()
    assert (got.n, got.rows) == (n, 5 * n) and got.off < 0.5
    some = rows.filter("g in (0, 77, 199999)").toPandas()
    for r in fits.filter("g in (0, 77, 199999) AND term = 'x'").collect():
        beta, se, _ = hc1(some[some.g == r.g], "y", ("x",))
        assert (r.beta, r.se) == (pytest.approx(beta[1], abs=1e-7), pytest.approx(se[1], rel=1e-5))
