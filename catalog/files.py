"""Sources, sinks and streaming. Files are written by Spark from the given tables to the shared folder."""

from pyspark.sql import functions as F

from opinara.operators import scoring as SC
from opinara.session import scratch_path
from opinara.sources import readers as RD
from opinara.sources import writers as W
from opinara.streaming import ingest as ST

from .base import WEIGHTS, Catalog, rd, rounded, table
from .texts import CHECKPOINT_COLS, CHECKPOINT_SQL, DIMS, ITEMS, PARSED

C = Catalog()


@C.add(
    "src_reviews",
    "SELECT row_id, file_name, comment_id, comment_text, price_text, nullif(regexp_extract(file_name, '^([0-9]+-[0-9]+)', 1), '') AS product_id FROM {order_reviews}",
)
def _(spark, sf):
    path = scratch_path(spark, "reviews")
    W.write_table(table(spark, sf, "order_reviews"), path)
    return RD.read_reviews(spark, path, "file_name", "row_id")


@C.add("src_csv_bom", "SELECT CAST(product_id AS VARCHAR) AS product_id, brand, CAST(p_size AS VARCHAR) AS p_size FROM {products}")
def _(spark, sf):
    path = scratch_path(spark, "bom")
    p = table(spark, sf, "products").select("product_id", "brand", "p_size")
    # A byte-order mark in front of the first header name, as spreadsheet exports write it.
    W.write_table(p.withColumnRenamed("product_id", "﻿product_id"), path, "csv")
    return RD.read_csv(spark, path)


@C.add("src_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    return RD.read_table(spark, f"{sf}/nation.parquet")


@C.add("src_lexicon", f"SELECT brand AS word, {rd('avg(p_size) / 50', 'weight')} FROM {{products}} GROUP BY brand")
def _(spark, sf):
    path = scratch_path(spark, "lexicon")
    w = table(spark, sf, "products").groupBy("brand").agg((F.avg("p_size") / 50).alias("w"))
    # Brands are a closed list, so one JSON object holds them.
    doc = w.agg(F.map_from_entries(F.collect_list(F.struct("brand", "w"))).alias("weight_lookup"))
    doc.coalesce(1).write.json(path)
    return rounded(RD.read_weight_lexicon(spark, path))


@C.add(
    "src_seed_lexicon",
    """SELECT DISTINCT 'type' AS family, p_type AS dimension, p_brand AS seed, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN -1 ELSE 0 END::INT AS polarity,
    p_size % 3 = 2 AS excluded FROM part""",
)
def _(spark, sf):
    path = scratch_path(spark, "seeds")
    part = table(spark, sf, "part")
    # Types and brands are closed lists: the nested document stays small.
    kind = lambda k: F.collect_set(F.when(F.col("p_size") % 3 == k, F.col("p_brand")))
    dims = part.groupBy("p_type").agg(
        F.struct(kind(0).alias("positive_seeds"), kind(1).alias("negative_seeds"), kind(2).alias("exclude_words")).alias("e")
    )
    doc = dims.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "e")))).alias("value"))
    doc.coalesce(1).write.text(path)
    return RD.read_seed_lexicon(spark, path, "type")


@C.add("prompt_table", """SELECT concept_id, prompt_polarity, (row_number() OVER (PARTITION BY concept_id, prompt_polarity ORDER BY prompt_text))::INT AS prompt_index, prompt_text
    FROM (SELECT DISTINCT p_type AS concept_id, CASE WHEN p_size < 25 THEN 'negative' ELSE 'positive' END AS prompt_polarity, p_brand AS prompt_text FROM part)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    pol = F.when(F.col("p_size") < 25, "negative").otherwise("positive")
    # Brands per type are a closed list.
    texts = part.groupBy(F.col("p_type").alias("concept_id"), pol.alias("polarity")).agg(F.sort_array(F.collect_set("p_brand")).alias("t"))
    nested = texts.groupBy("concept_id").agg(F.map_from_entries(F.collect_list(F.struct("polarity", "t"))).alias("prompts"))
    return RD.prompt_rows(nested)


@C.add("sink_table", f"SELECT product_id, brand, {rd('price', 'price')} FROM {{products}}")
def _(spark, sf):
    p = table(spark, sf, "products").select("product_id", "price", "brand")
    path, twin = scratch_path(spark, "sink"), scratch_path(spark, "sink-csv")
    W.write_table(p, path, "parquet", partition_by=["brand"])
    W.write_table(p, twin, "csv")
    a = RD.read_table(spark, path, p.schema)
    b = RD.read_csv(spark, twin, p.schema)
    # Both twins must hold the same rows; keep what they share.
    return rounded(a.intersectAll(b).select("product_id", "brand", "price"))


@C.add(
    "sink_metadata",
    f"""SELECT n_products, n_reviews, {rd('mean_size', 'mean_size')} FROM (SELECT count(*) AS n_products, avg(p_size) AS mean_size FROM {{products}}),
    (SELECT count(*) AS n_reviews FROM lineitem)""",
)
def _(spark, sf):
    p = table(spark, sf, "products").agg(F.count(F.lit(1)).alias("n_products"), F.avg("p_size").alias("mean_size"))
    r = table(spark, sf, "reviews").agg(F.count(F.lit(1)).alias("n_reviews"))
    meta = W.run_metadata({"products": p, "reviews": r}, {"epsilon": 0.001, "scale": "population z"})
    path = scratch_path(spark, "metadata")
    W.write_metadata(meta, path)
    back = spark.read.schema(meta.schema).json(path)
    return rounded(back.select("products.n_products", "reviews.n_reviews", "products.mean_size"))


@C.add("sink_checkpoint_append", "SELECT error, count(*) AS n FROM {checkpoint} GROUP BY error")
def _(spark, sf):
    ck = table(spark, sf, "checkpoint")
    path = scratch_path(spark, "checkpoint")
    # The first batch runs twice, as after a lost driver.
    for batch, rows in ((0, F.col("error") == ""), (0, F.col("error") == ""), (1, F.col("error").isNull() | (F.col("error") != ""))):
        W.append_results(ck.filter(rows), path, batch)
    return RD.read_table(spark, path).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def _arrivals(spark, sf) -> str:
    path = scratch_path(spark, "responses")
    table(spark, sf, "responses").select("row_id", "product_id", "text", "raw", "usage").write.parquet(path)
    return path


@C.add("stream_parse_validate", CHECKPOINT_SQL)
def _(spark, sf):
    src, out, ck = _arrivals(spark, sf), scratch_path(spark, "out"), scratch_path(spark, "ck")
    schema = spark.read.parquet(src).schema
    ST.stream_validate(spark, src, out, ck, DIMS, schema, max_files=4)
    return spark.read.parquet(out).select(*CHECKPOINT_COLS)


@C.add(
    "stream_running_scores",
    f"""WITH {PARSED}, {ITEMS}, v AS (SELECT product_id, row_id, dimension, avg(polarity * CASE degree_word WHEN 'very' THEN 1.0 ELSE 0.8 END) AS v FROM good GROUP BY ALL),
    n AS (SELECT lang AS product_id, count(*) AS n_total FROM documents GROUP BY lang)
    SELECT product_id, dimension, {rd('sum(v) / n_total', 'score')}, {rd('count(*) / n_total', 'coverage')} FROM v JOIN n USING (product_id) GROUP BY product_id, dimension, n_total""",
)
def _(spark, sf):
    src, out, ck = _arrivals(spark, sf), scratch_path(spark, "out"), scratch_path(spark, "ck")
    schema = spark.read.parquet(src).schema
    ST.stream_scores(spark, src, out, ck, {d: d for d in DIMS}, WEIGHTS, apply_negation=False, schema=schema, max_files=4)
    totals = SC.n_total(table(spark, sf, "documents").withColumnRenamed("lang", "product_id"))
    return rounded(ST.running_scores(spark, out, totals))
