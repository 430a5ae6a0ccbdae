"""Centroids as a table of blocks: any number of them, against numpy; what the driver sees stays flat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import vectors as OV


def tables(spark, n, m, d, seed=1):
    rng = np.random.default_rng(seed)
    v, c = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>").repartition(5)
    cents = spark.createDataFrame([(f"c{i // 2}", ("positive", "negative")[i % 2], [float(x) for x in r]) for i, r in enumerate(c)], "concept_id string, prompt_polarity string, centroid array<double>").repartition(3)
    v = v.astype(np.float32).astype(float)
    return vecs, cents, (v / np.linalg.norm(v, axis=1, keepdims=True)) @ c.T


@pytest.mark.parametrize(("block", "cents_block", "columns"), [(1024, 512, 16), (7, 3, 2)])
def test_every_vector_meets_every_centroid_once(spark, monkeypatch, block, cents_block, columns):
    for name, value in (("VECTOR_BLOCK", block), ("CENTROID_BLOCK", cents_block), ("COLUMN_BLOCKS", columns), ("OUTPUT_ROWS", 50)):
        monkeypatch.setattr(OV, name, value)
    vecs, cents, want = tables(spark, 60, 26, 8)
    rows = OV.cross_concepts(vecs, cents, "id", "v", ["concept_id", "prompt_polarity"]).collect()
    got = {(r.id, r.concept_id, r.prompt_polarity): r.similarity for r in rows}
    assert len(got) == len(rows) == want.size
    for i in range(60):
        for j in range(26):
            assert got[i, f"c{j // 2}", ("positive", "negative")[j % 2]] == pytest.approx(want[i, j], abs=1e-12)
    scores = {(r.id, r.concept_id): (r.sim_pos, r.sim_neg, r.score) for r in OV.concept_scores(vecs, cents, "id", "v").collect()}
    assert scores[7, "c3"] == pytest.approx((want[7, 6], want[7, 7], want[7, 6] - want[7, 7])) and len(scores) == 60 * 13


def test_a_hundred_thousand_centroids(spark):
    d, n = 16, 100_000
    cents = spark.range(n).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.sin(F.col("id") * (j + 1)).cast("double")).alias("centroid"))
    vecs, _, _ = tables(spark, 40, 2, d)
    # No scan of the vectors but one, and no list of centroids in the plan.
    found = OV.cross_concepts(vecs, cents, "id", "v", ["k"])
    plan = found._jdf.queryExecution().toString()
    assert len(plan) < 100_000
    got = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("k", "similarity").alias("best")).collect()
    assert {r.n for r in got} == {n} and len(got) == 40
    c = np.sin(np.arange(n)[:, None] * (np.arange(d) + 1))
    for r in vecs.collect():
        v = np.array(r.v, float)
        best = next(g.best for g in got if g.id == r.id)
        assert (c @ v)[best] == pytest.approx((c @ v).max())


def test_empty_sides(spark):
    vecs, cents, _ = tables(spark, 5, 4, 3)
    assert OV.cross_concepts(vecs.limit(0), cents, "id", "v", ["concept_id"]).count() == 0
    assert OV.cross_concepts(vecs, cents.limit(0), "id", "v", ["concept_id"]).count() == 0
