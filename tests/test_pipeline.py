"""Contracts, resumable streams, ordering and plan shape."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog.base import WEIGHTS, table
from catalog.scoring import fmatches
from catalog.texts import DIMS
from opinara.operators import joins as J
from opinara.operators import rows as RW
from opinara.operators import scoring as SC
from opinara.functions import responses as R
from opinara.operators.lexicon import score_texts
from opinara.session import scratch_path
from opinara.sources import contracts as CT
from opinara.sources import readers as RD
from opinara.streaming import ingest as ST

SF = "/root/testdata/sf0.001"


def test_contracts_fail(spark):
    df = spark.createDataFrame([(1, 2.0), (1, -1.0), (2, None)], "k int, v double")
    with pytest.raises(CT.ContractError):
        CT.require_columns(df, ["k", "zz"])
    with pytest.raises(CT.ContractError):
        CT.assert_unique(df, ["k"])
    with pytest.raises(CT.ContractError):
        CT.assert_keys(df, spark.createDataFrame([(3,)], "k int"), "k")
    with pytest.raises(CT.ContractError):
        J.join_one_to_one(df, df.select("k").distinct(), "k")
    with pytest.raises(Exception, match="must be positive"):
        CT.assert_positive(df, "v").collect()
    good = spark.createDataFrame([(1, 2.0), (2, 1.0)], "k int, v double")
    assert CT.assert_unique(good, ["k"]).count() == 2
    assert CT.assert_positive(good, "v").count() == 2


def test_null_keys(spark):
    rows = [("a", 1, "x", 1.0), (None, 2, "x", 1.0), ("a", None, "x", 9.0), ("a", 1, "x", 0.0), ("b", 4, "x", 1.0)]
    m = spark.createDataFrame(rows, "product_id string, comment_id int, code string, final_value double")
    totals = spark.createDataFrame([("a", 4), ("b", 1), ("c", 5)], "product_id string, n_total long")
    got = {r["product_id"]: (r["x"], r["cov_x"]) for r in SC.wide_scores(m, totals, ["x"]).collect()}
    assert got == {"a": (0.125, 0.25), "b": (1.0, 1.0), "c": (0.0, 0.0)}


def test_dense_index_is_total_order(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1009)
    got = RW.dense_index(df, ["k"]).orderBy("k").select("idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))


def test_stream_second_run_does_only_new_work(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    rows = table(spark, SF, "responses").select("row_id", "product_id", "text", "raw", "usage")
    first, second = rows.filter("row_id < 100"), rows.filter("row_id >= 50")
    first.write.parquet(src)
    schema = spark.read.parquet(src).schema
    args = ({d: d for d in DIMS}, WEIGHTS, False, schema)
    ST.stream_scores(spark, src, out, ck, *args)
    half = spark.read.parquet(out).agg(F.sum("n_mentioning")).first()[0]
    ST.stream_scores(spark, src, out, ck, *args)
    assert spark.read.parquet(out).agg(F.sum("n_mentioning")).first()[0] == half
    second.write.mode("append").parquet(src)
    ST.stream_scores(spark, src, out, ck, *args)
    total = spark.read.parquet(out).agg(F.sum("n_mentioning")).first()[0]
    whole_out, whole_ck, whole_src = (scratch_path(spark, n) for n in ("wout", "wck", "wsrc"))
    rows.write.parquet(whole_src)
    ST.stream_scores(spark, whole_src, whole_out, whole_ck, *args)
    # Rows 50..99 arrive twice and count once.
    assert total == spark.read.parquet(whole_out).agg(F.sum("n_mentioning")).first()[0] > half
    # No state is kept: repeats are found in the ledger.
    assert not (Path(ck) / "state").exists()
    ids = spark.read.parquet(f"{out}_ledger/ids")
    assert ids.select("row_id").distinct().count() == rows.select("row_id").distinct().count()


def test_compacted_sums_and_later_batches_add_up(spark):
    src, out, ck, small, smaller = (scratch_path(spark, n) for n in ("src", "out", "ck", "small", "smaller"))
    rows = table(spark, SF, "responses").select("row_id", "product_id", "text", "raw", "usage")
    rows.filter("row_id < 100").write.parquet(src)
    args = ({d: d for d in DIMS}, WEIGHTS, False, spark.read.parquet(src).schema)
    totals = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_total"))
    ST.stream_scores(spark, src, out, ck, *args)
    ST.compact_scores(spark, out, small)
    rows.filter("row_id >= 100").write.mode("append").parquet(src)
    ST.stream_scores(spark, src, out, ck, *args)
    ST.compact_scores(spark, out, smaller)
    want = {r[:2]: r[2:] for r in ST.running_scores(spark, out, totals).collect()}
    for place in (small, smaller):
        got = {r[:2]: r[2:] for r in ST.running_scores(spark, out, totals, compacted=place).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_csv_and_inventory(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("1—1", "0.5")], ["﻿product_id", "z_pc1"]).coalesce(1).write.option("header", True).csv(path)
    assert RD.read_csv(spark, path).columns == ["product_id", "z_pc1"]
    inv = RD.file_inventory(spark, SF, [".PARQUET"])
    assert inv.filter("item_id = 'lineitem'").count() == 1
    assert RD.file_inventory(spark, SF, [".png"]).count() == 0


def test_scorer_hook(spark):
    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    out = score_texts(df, lambda p: p.assign(score=p["text"].str.len() / 10.0)[["id", "score"]], "id int, score double")
    assert out.first()["score"] == 0.3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_pushed(spark):
    text = plan(SC.comment_mean(fmatches(spark, SF), ["product_id", "comment_id", "code"]))
    assert "l_shipdate" not in text and "l_extendedprice" not in text
    assert "ReadSchema" in text and "partial_avg" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scores_need_no_python_workers(spark):
    cells = SC.comment_cells(fmatches(spark, SF))
    assert "Python" not in plan(cells) and plan(cells).count("Exchange hashpartitioning") <= 2


def test_comments_in_several_responses_count_once(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    rows = table(spark, SF, "responses").select("row_id", "product_id", "text", "raw", "usage").withColumn("comment_id", F.col("row_id") % 40)
    first, second = rows.filter("row_id < 90"), rows.filter("row_id >= 60")
    first.write.parquet(src)
    args = ({d: d for d in DIMS}, WEIGHTS, False, spark.read.parquet(src).schema)
    ST.stream_scores(spark, src, out, ck, *args, comment="comment_id")
    second.write.mode("append").parquet(src)
    ST.stream_scores(spark, src, out, ck, *args, comment="comment_id")
    got = {(r.product_id, r.dimension): r.n_comments for r in ST.running_comments(spark, out).collect()}
    valid = R.explode_matches(R.checkpoint_rows(rows, DIMS), ["row_id", "product_id", "comment_id"])
    want = {(r.product_id, r.dimension): r.n for r in valid.groupBy("product_id", "dimension").agg(F.count_distinct("comment_id").alias("n")).collect()}
    assert got == want and max(want.values()) > 5
