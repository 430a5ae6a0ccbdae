"""Input that the synthetic tables do not hold: quotes, NaN, text ids, zero weights, large means, empty tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.summaries import product_reviews
from opinara.operators import scoring as SC
from opinara.operators import regression as R
from opinara.operators.multiple_testing import fdr
from opinara.operators.quantiles import exact_quantiles
from opinara.operators.resampling import poisson_moments
from opinara.operators.stacks import replicate_sums
from opinara.operators.standardize import BLOCK, column_stats
from opinara.operators.scoring import with_degree_lexicon, with_degree_weight
from opinara.plans import inference as I
from opinara.plans.master import build_master
from opinara.plans.product_scores import METRICS, complete_metrics
from opinara.sources.readers import read_csv
from opinara.sources.writers import write_table

ROWS = [("1", 'a "quoted", b'), ("2", "two\nlines, and\r\nthree"), ("3", ""), ("4", None), ("5", "plain"), ("6", '"')]


def test_csv_from_pandas_keeps_rows(spark, tmp_path):
    place = tmp_path / "r.csv"
    pd.DataFrame(ROWS, columns=["id", "text"]).to_csv(place, index=False, encoding="utf-8-sig")
    got = {r.id: r.text for r in read_csv(spark, str(place)).collect()}
    assert {k: (v or "").replace("\r\n", "\n") for k, v in got.items()} == {k: (v or "").replace("\r\n", "\n") for k, v in ROWS}


def test_csv_written_is_read_by_pandas(spark, tmp_path):
    place = str(tmp_path / "out")
    write_table(spark.createDataFrame(ROWS, "id string, text string").coalesce(1), place, "csv")
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    got = pd.read_csv(part, dtype=str, keep_default_na=False)
    assert dict(zip(got["id"], got["text"])) == {k: v or "" for k, v in ROWS}
    assert {r.id: r.text for r in read_csv(spark, place).collect()} == {k: v or None for k, v in ROWS}


def test_nan_p_values_do_not_count(spark):
    got = {r.i: r for r in fdr(spark.createDataFrame([(1, 0.01), (2, 0.5), (3, math.nan), (4, None)], "i int, p double"), "p").collect()}
    assert got[1].p_bh == pytest.approx(0.02) and got[2].p_bh == pytest.approx(0.5) and got[3].p_bh is None and got[4].p_bh is None


def test_quantiles_leave_nan_out(spark):
    rows = [(float(i),) for i in range(101)] + [(math.nan,), (math.inf,), (None,)]
    assert exact_quantiles(spark.createDataFrame(rows, "v double"), [], "v", [0.0, 0.25, 1.0]).first()[:] == (0.0, 25.0, 100.0)


def test_poisson_replicates_on_text_ids(spark):
    frame = spark.createDataFrame([("same", f"{i}-{i % 7}", float(i)) for i in range(300)], "g string, id string, v double")
    rows = replicate_sums(poisson_moments(frame, ["v"], ["g", "id"], 20, 3)).collect()
    assert len(rows) == 20 and len({r.sw for r in rows}) > 5
    assert abs(np.mean([r.sw for r in rows]) - 300) < 20
    with pytest.raises(Exception):
        poisson_moments(frame.withColumn("id", F.lit(None).cast("string")), ["v"], ["g", "id"], 5, 3).collect()


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e8])
def test_large_means_cost_no_digits(spark, shift):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=2000), rng.normal(size=2000)
    y = 2 * x - z + rng.normal(size=2000)
    frame = spark.createDataFrame(pd.DataFrame({"x": x + shift, "z": z, "y": y + shift}))
    got = {r.term: r for r in R.ols(frame, [R.Spec("m", "y", ("x", "z"))]).collect()}
    shifted = (x + shift) - (x + shift).mean()
    a = np.column_stack([np.ones(2000), shifted, z])
    target = (y + shift) - (y + shift).mean()
    beta = np.linalg.lstsq(a, target, rcond=None)[0]
    e = target - a @ beta
    inv = np.linalg.inv(a.T @ a)
    v = 2000 / 1997 * inv @ (a * (e**2)[:, None]).T @ a @ inv
    for i, term in ((1, "x"), (2, "z")):
        assert got[term].beta == pytest.approx(beta[i], rel=1e-8) and got[term].se == pytest.approx(math.sqrt(v[i, i]), rel=1e-7)
    if not shift:
        b = np.column_stack([np.ones(2000), x, z])
        plain = np.linalg.lstsq(b, y, rcond=None)[0]
        assert got["_cons"].beta == pytest.approx(plain[0], abs=1e-10)


def test_zero_weights_are_left_out_and_negative_ones_raise(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"x": rng.normal(size=200), "y": rng.normal(size=200), "w": np.where(np.arange(200) < 61, 0.0, 1.5)})
    frame = spark.createDataFrame(data)
    got = R.ols(frame, [R.Spec("m", "y", ("x",))], weight="w").collect()
    want = R.ols(frame.filter("w > 0"), [R.Spec("m", "y", ("x",))], weight="w").collect()
    assert got[0].n == 139 and [r.se for r in got] == pytest.approx([r.se for r in want])
    with pytest.raises(Exception):
        R.ols(frame.withColumn("w", -F.col("w") - 1), [R.Spec("m", "y", ("x",))], weight="w")


def test_repeated_column_counts_once_in_the_degrees_of_freedom(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"x": rng.normal(size=50), "y": rng.normal(size=50)})
    frame = spark.createDataFrame(data.assign(x2=data["x"]))
    one = {r.term: r for r in R.ols(frame, [R.Spec("m", "y", ("x",))]).collect()}
    two = {r.term: r for r in R.ols(frame, [R.Spec("m", "y", ("x", "x2"))]).collect()}
    assert two["x"].beta + two["x2"].beta == pytest.approx(one["x"].beta)
    assert two["x"].se * 2 == pytest.approx(one["x"].se)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "x double, z double")
    assert R.vif(none, ["x", "z"]).count() == 0
    with pytest.raises(ValueError):
        R.single_factor(none, ["x", "z"])


def test_degree_lexicon_as_a_table(spark):
    lexicon = {f"w{i}": i / 20_000 for i in range(20_000)}
    table = spark.createDataFrame(list(lexicon.items()), "word string, weight double")
    rows = spark.createDataFrame([(" w5",), ("w19999　",), ("zzz",), ("",), (None,)], "degree_word string")
    few = with_degree_weight(rows, {w: lexicon[w] for w in ("w5", "w19999")}).collect()
    assert sorted(map(repr, with_degree_lexicon(rows, table).collect())) == sorted(map(repr, few))


def test_seven_models_take_two_scans(spark):
    """Rows that leave the source are counted: one pass for the moments of all models, one for their meats."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(400, 9)), columns=[f"v{i}" for i in range(9)])
    for i in range(9):
        pdf.loc[rng.choice(400, 20, replace=False), f"v{i}"] = np.nan
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(pdf)
    models = [R.Spec(f"m{i}", f"v{i}", (f"v{i + 1}", f"v{i + 2}")) for i in range(7)]
    got = R.ols(frame.mapInArrow(count, frame.schema), models).collect()
    assert seen.value == 2 * 400
    for m in models:
        d = pdf[list(m.cols)].dropna()
        z = np.column_stack([np.ones(len(d)), d[list(m.x)]])
        beta = np.linalg.lstsq(z, d[m.y], rcond=None)[0]
        rows = [r for r in got if r.spec == m.name]
        assert [r.beta for r in rows] == pytest.approx(beta.tolist(), abs=1e-10) and {r.n for r in rows} == {len(d)}


def test_design_close_to_dependent_raises(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=500)
    pdf = pd.DataFrame({"x": x, "near": x + 1e-6 * rng.normal(size=500), "y": rng.normal(size=500), "flat": 0.1})
    frame = spark.createDataFrame(pdf)
    with pytest.raises(ValueError, match="ill-conditioned"):
        R.ols(frame, [R.Spec("m", "y", ("x", "near"))])
    rows = {r.term: r for r in R.ols(frame, [R.Spec("m", "y", ("x", "flat"))]).collect()}
    assert rows["flat"].beta == pytest.approx(0.0) and rows["x"].beta == pytest.approx(np.polyfit(x, pdf.y, 1)[0])


def test_thresholds_keep_rows_in_place(spark):
    """Nested cuts, unsorted and repeated, equal one fit per filter; nothing is exploded."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.normal(size=300), "k": rng.integers(0, 40, 300).astype(float)})
    pdf["y"] = pdf.x * pdf.k + rng.normal(size=300)
    pdf.loc[:4, "k"] = np.nan
    frame = spark.createDataFrame(pdf).replace(float("nan"), None, subset=["k"])
    got = {(r.cutoff, r.term): r for r in R.ols_thresholds(frame, [R.Spec("m", "y", ("x",))], "k", [20, 5, 30, 5, 100]).collect()}
    assert sorted({c for c, _ in got}) == [5, 20, 30]
    for cut in (5, 20, 30):
        want = {r.term: r for r in R.ols(frame.filter(f"k >= {cut}"), [R.Spec("m", "y", ("x",))]).collect()}
        for term, r in want.items():
            assert (got[cut, term].beta, got[cut, term].se, got[cut, term].n) == (pytest.approx(r.beta), pytest.approx(r.se), r.n)


def test_comments_are_added_up_after_the_shuffle(spark):
    """Rows of one product meet by shares of its comments, without a sum of nearly unique comments before."""
    rows = [(i % 3 // 2, None if i % 50 == 0 else i // 2 % 90, "ab"[i % 2], float(i % 11)) for i in range(3000)]
    matches = spark.createDataFrame([*rows, (None, 1, "a", 1.0), (2, None, "b", 1.0)], "product_id int, comment_id int, code string, final_value double")
    totals = spark.createDataFrame([(0, 100), (1, 50), (2, 9)], "product_id int, n_total long")
    got = SC.wide_scores(matches, totals, ["a", "b"])
    assert "hashpartitioning(product_id#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", _share#" in plan
    cells = {}
    for p, k, d, v in rows:
        if k is not None:
            cells.setdefault((p, d), {}).setdefault(k, []).append(v)
    for r in got.collect():
        for d in "ab":
            means = [sum(v) / len(v) for v in cells.get((r["product_id"], d), {}).values()]
            assert r[d] == pytest.approx(sum(means) / r["n_total"]) and r[f"cov_{d}"] == pytest.approx(len(means) / r["n_total"])
    profile = {r["product_id"]: r for r in SC.product_profile(matches, totals, ["a", "b"]).collect()}
    for p in (0, 1, 2):
        assert profile[p]["n_any"] == len({k for d in "ab" for k in cells.get((p, d), {})}) and profile[p]["a_h"] == len(cells.get((p, "a"), {}))


def test_only_large_products_are_dealt_to_several_shares(spark, monkeypatch):
    monkeypatch.setattr(SC, "SHARE_ROWS", 50)
    rows = [(i % 4 // 3, i // 2 % 90, "ab"[i % 2], "cd"[i % 3 % 2], float(i % 11)) for i in range(600)] + [(2, None, "a", "c", 1.0), (3, 1, "a", "c", 1.0)]
    matches = spark.createDataFrame(rows, "product_id int, comment_id int, f string, e string, v double")
    # A product may come twice in the totals, or with a null.
    totals = spark.createDataFrame([(0, 450), (1, 50), (1, 50), (2, None), (None, 900)], "product_id int, n_total long")
    dealt = SC.by_share(matches, totals, "product_id", "comment_id")
    assert dealt.count() == len(rows) and dealt.columns == [*matches.columns, "_share"]
    shares = {r["product_id"]: r["n"] for r in dealt.groupBy("product_id").agg(F.count_distinct("_share").alias("n")).collect()}
    assert shares == {0: 9, 1: 1, 2: 1, 3: 1}
    assert dealt.groupBy("product_id", "comment_id").agg(F.count_distinct("_share").alias("n")).filter("n > 1").count() == 0
    whole = spark.createDataFrame([(0, 450), (1, 50)], "product_id int, n_total long")
    families = {"F": ("f", "v", ["a", "b"]), "E": ("e", "v", ["c", "d"])}
    got = SC.joint_profile(matches, whole, families)
    monkeypatch.setattr(SC, "SHARE_ROWS", 1 << 16)
    want = SC.joint_profile(matches, whole, families)
    for a, b in zip(got.orderBy("product_id").collect(), want.orderBy("product_id").collect(), strict=True):
        assert list(a) == pytest.approx(list(b))


def test_tables_of_the_master_are_joined_without_a_broadcast(spark):
    scores = spark.sql("SELECT id AS product_id, 1.0D AS ME1_z FROM range(5)")
    pcs = spark.sql("SELECT id AS product_id, 2.0D AS z_pc1 FROM range(1, 6)")
    sat = spark.sql("SELECT id AS product_id, 'b' AS brand, 3.0D AS price, 4L AS n_reviews_total FROM range(2, 7)")
    rows = build_master(scores, pcs, sat, norm_key=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert sorted((r.product_id, r.z_pc1, r.price) for r in rows.collect()) == [(0, None, None), (1, 2.0, None), (2, 2.0, 3.0), (3, 2.0, 3.0), (4, 2.0, 3.0)]


def test_rows_outside_the_model_sample_count_but_are_not_written(spark):
    rows = [(i, 2.0 + i, 3 + i, float(i * i), None if i % 3 else float(i)) for i in range(12)]
    master = spark.createDataFrame(rows, "product_id long, price double, n_reviews_total long, x double, pc double")
    whole = {r.product_id: r for r in I.prepare(master, ["x", "pc"]).collect()}
    got = I.prepare(master, ["x", "pc"], present=["pc"])
    assert len(whole) == 12 and "Filter" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Relation" in plan
    assert {r.product_id: r for r in got.collect()} == {i: whole[i] for i in (0, 3, 6, 9)}


def test_measures_of_single_dimensions_are_left_out_where_not_asked(spark):
    rows = [(i % 5, i, "ab"[i % 2], float(i % 7) - 2) for i in range(60)]
    matches = spark.createDataFrame(rows, "product_id long, comment_id long, code string, final_value double")
    totals = spark.createDataFrame([(i, 20 + i) for i in range(6)], "product_id long, n_total long")
    whole = complete_metrics(matches, totals, ["a", "b"])
    short = complete_metrics(matches, totals, ["a", "b"], by_dimension=False)
    assert set(whole.columns) - set(short.columns) == {f"{c}_{m}" for c in "ab" for m in METRICS}
    assert sorted(short.collect(), key=lambda r: r.product_id) == sorted(whole.select(*short.columns).collect(), key=lambda r: r.product_id)


def test_statistics_of_many_columns_are_taken_in_blocks(spark):
    rng = np.random.default_rng(5)
    names = [f"v{i}" for i in range(2 * BLOCK + 3)]
    x = rng.normal(3.0, 2.0, size=(40, len(names)))
    x[::3, 1], x[4, BLOCK], x[:, BLOCK + 1], x[:, -1] = np.nan, np.inf, 0.1, np.nan
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names))
    stats = column_stats(rows, names, 1)
    got = stats.first()["stats"]
    for i in range(len(names)):
        own = x[np.isfinite(x[:, i]), i]
        if not len(own):
            assert got[f"m{i}"] is None and got[f"s{i}"] is None
            continue
        assert got[f"m{i}"] == pytest.approx(own.mean())
        assert got[f"s{i}"] is None if i == BLOCK + 1 else got[f"s{i}"] == pytest.approx(own.std(ddof=1))
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    # No aggregate has more columns than Spark compiles.
    assert max(line.count("stddev_samp(") for line in plan.splitlines()) <= BLOCK


def test_reviews_meet_their_products_without_a_broadcast(spark, tmp_path):
    spark.sql(
        """SELECT id % 3 AS l_partkey, id AS l_orderkey, 1 AS l_linenumber, 1L AS l_suppkey, 10.0D AS l_extendedprice, 0.1D AS l_discount,
        0.05D AS l_tax, 1.0D AS l_quantity, 'A' AS l_returnflag, timestamp'2000-01-01' AS l_shipdate FROM range(9)"""
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(
        "SELECT id AS p_partkey, 'b' AS p_brand, cast(id AS int) AS p_size, 1000.0D AS p_retailprice FROM range(1, 4)"
    ).write.parquet(f"{tmp_path}/part.parquet")
    rows = product_reviews(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r.product_id for r in rows.collect()) == [1, 1, 1, 2, 2, 2]
