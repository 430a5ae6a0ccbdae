"""Checks that ride along with an action, and distinct counts that merge."""

import pytest
from pyspark.sql import functions as F

from opinara.operators import sketches as K
from opinara.plans import inference as I
from opinara.session import pin
from opinara.sources.contracts import ContractError, RidingChecks


def test_checks_ride_along(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0), (None, 4.0)], "id long, x double")
    fine = RidingChecks().present("x").positive("x")
    assert pin(fine.attach(rows.filter("x > 0"))).count() == 2 and fine.verify() == 2
    bad = RidingChecks().present("id").positive("x").expect("x must be below 3", F.col("x") < 3)
    pin(bad.attach(rows))
    with pytest.raises(ContractError) as e:
        bad.verify()
    assert "id must not be missing (1 rows)" in str(e.value) and "x must be positive and nonmissing (2 rows)" in str(e.value) and "x must be below 3 (2 rows)" in str(e.value)
    none = RidingChecks().positive("x")
    pin(none.attach(rows.limit(0)))
    assert none.verify() == 0


def test_prepare_reads_the_master_once_and_still_raises(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(i, 10.0 + i, 5 + i % 3, float(i % 7)) for i in range(40)]
    master = spark.createDataFrame(rows, "product_id long, price double, n_reviews_total long, x double").mapInPandas(count, "product_id long, price double, n_reviews_total long, x double")
    done = I.prepare(master, ["x"])
    assert done.count() == 40 and seen.value == 40
    with pytest.raises(ContractError, match="n_reviews_total must be positive"):
        I.prepare(master.withColumn("n_reviews_total", F.when(F.col("product_id") == 3, 0).otherwise(F.col("n_reviews_total"))), ["x"])
    with pytest.raises(ContractError, match="unique"):
        I.prepare(master.withColumn("product_id", F.lit(1)), ["x"])


def test_sketches_of_batches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") % 9_000).alias("v"))
    exact = {r.g: r.n for r in K.distinct_exact(rows, ["g"], "v", "n").collect()}
    assert exact == {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    parts = [K.distinct_sketches(rows.filter((F.hash("v") % 2 == 0) == even), ["g"], "v") for even in (True, False, True)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {r.g: r.n_distinct for r in K.distinct_estimates(K.merged_sketches(whole, ["g"])).collect()}
    assert all(abs(got[g] - n) < 0.08 * n for g, n in exact.items()) and got.keys() == exact.keys()
    nothing = spark.createDataFrame([(1, None)], "g long, v long")
    assert [tuple(r) for r in K.distinct_exact(nothing, ["g"], "v").collect()] == [(1, 0)]
