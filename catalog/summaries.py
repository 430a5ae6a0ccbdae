"""Satisfaction, distributions, correlations, quantiles and multiple testing."""

from pyspark.sql import functions as F

from opinara.operators import multiple_testing as MT
from opinara.operators import sketches as K
from opinara.operators import summary as SM
from opinara.plans.satisfaction import OUTPUT as SAT_COLS
from opinara.plans.satisfaction import product_satisfaction

from .base import ORDER, Catalog, rd, rounded, table

C = Catalog()
ROW = "(l_orderkey, l_linenumber, l_suppkey, l_extendedprice)"

FIRST = f"""first AS (SELECT product_id, arg_min(price, {ROW}) FILTER (price IS NOT NULL) AS price,
    arg_min(brand, {ROW}) FILTER (brand IS NOT NULL) AS brand, count(comment_id) AS n_reviews_total FROM {{reviews}} GROUP BY product_id)"""
SENT = f"""sent AS (SELECT product_id, count(sentiment_score) AS n_reviews_used, avg(sentiment_score) AS sentiment_mean,
    stddev_samp(sentiment_score) AS sentiment_std, count(*) FILTER (sentiment_score > 0.1) AS n_pos,
    count(*) FILTER (sentiment_score < -0.1) AS n_neg, count(*) FILTER (sentiment_score BETWEEN -0.1 AND 0.1) AS n_neu
    FROM {{reviews}} GROUP BY product_id)"""


@C.add("agg_first_nonnull", f"WITH {FIRST} SELECT product_id, {rd('price', 'price')}, brand FROM first")
def _(spark, sf):
    return rounded(SM.first_non_null(table(spark, sf, "reviews"), "product_id", ["price", "brand"], ORDER))


@C.add("agg_count_nonnull", f"WITH {FIRST} SELECT product_id, n_reviews_total FROM first")
def _(spark, sf):
    return SM.count_non_null(table(spark, sf, "reviews"), "product_id", "comment_id", "n_reviews_total")


@C.add(
    "agg_sentiment",
    f"WITH {SENT} SELECT product_id, n_reviews_used, {rd('sentiment_mean', 'sentiment_mean')}, {rd('sentiment_std', 'sentiment_std')}, n_pos, n_neg, n_neu FROM sent",
)
def _(spark, sf):
    return rounded(SM.sentiment_summary(table(spark, sf, "reviews"), "product_id", "sentiment_score"))


def product_reviews(spark, sf):
    """Reviews with the columns of their product.

    A merge join leaves the rows of a product together and sorted, as the firsts by a struct need them: they are sorted
    once, in small partitions, and the products do not pass the driver.
    """
    products = table(spark, sf, "products").hint("merge")
    return table(spark, sf, "reviews").drop("brand", "price").join(products, "product_id")


@C.add(
    "product_satisfaction",
    f"""WITH {FIRST}, {SENT}, base AS (SELECT p.product_id, p.brand, p.price, p.favorable_rate AS favorable_rate_raw,
        ln((p.favorable_rate + 0.001) / (1 - p.favorable_rate + 0.001)) AS favorable_rate_logit, f.n_reviews_total, s.*  EXCLUDE (product_id)
      FROM {{products}} p JOIN first f USING (product_id) LEFT JOIN sent s USING (product_id)),
    z AS (SELECT *, (sentiment_mean - avg(sentiment_mean) OVER ()) / stddev_pop(sentiment_mean) OVER () AS sentiment_z,
      (favorable_rate_logit - avg(favorable_rate_logit) OVER ()) / stddev_pop(favorable_rate_logit) OVER () AS favrate_z FROM base)
    SELECT product_id, brand, {rd('price', 'price')}, n_reviews_total, n_reviews_used, n_pos, n_neu, n_neg, {rd('sentiment_mean', 'sentiment_mean')},
      {rd('sentiment_std', 'sentiment_std')}, {rd('favorable_rate_raw', 'favorable_rate_raw')}, {rd('favorable_rate_logit', 'favorable_rate_logit')},
      {rd('sentiment_z', 'sentiment_z')}, {rd('favrate_z', 'favrate_z')}, {rd('sentiment_z', 'Y_sentiment_only')}, {rd('favrate_z', 'Y_favrate_only')},
      {rd('0.5 * sentiment_z + 0.5 * favrate_z', 'Y_50_50')}, {rd('0.3 * sentiment_z + 0.7 * favrate_z', 'Y_30_70')},
      {rd('0.7 * sentiment_z + 0.3 * favrate_z', 'Y_70_30')}, n_reviews_total >= 20 AS included FROM z""",
)
def satisfaction(spark, sf):
    sat = product_satisfaction(
        product_reviews(spark, sf),
        table(spark, sf, "reviews"),
        order=ORDER,
        first_cols=["brand", "price", "favorable_rate"],
    )
    return rounded(sat.select(*SAT_COLS))


@C.add("agg_value_counts", "SELECT brand, count(*) AS n FROM {reviews} WHERE brand IS NOT NULL GROUP BY brand")
def _(spark, sf):
    return SM.value_counts(table(spark, sf, "reviews"), "brand")


@C.add(
    "agg_run_stats",
    """SELECT count(*) AS n_comments_total, count(*) FILTER (n_matches > 0) AS n_comments_with_match, sum(n_matches)::BIGINT AS n_total_matches,
    sum(in_tokens)::BIGINT AS n_input_tokens, sum(cached_tokens)::BIGINT AS n_cached_tokens, sum(out_tokens)::BIGINT AS n_output_tokens,
    round(count(*) FILTER (n_matches > 0) / count(*), 4) + 0.0 AS comment_match_rate, round(sum(n_matches) / count(*), 4) + 0.0 AS avg_matches_per_comment,
    round(sum(cached_tokens) / sum(in_tokens), 4) + 0.0 AS cache_hit_rate FROM {checkpoint}""",
)
def _(spark, sf):
    return rounded(SM.run_stats(table(spark, sf, "checkpoint")), 4)


@C.add(
    "agg_score_distribution",
    f"""SELECT count(*) AS n_total, count(sentiment_score) AS n_valid, count(*) FILTER (sentiment_score IS NULL) AS n_failed, {rd('avg(sentiment_score)', 'mean')},
    {rd('stddev_samp(sentiment_score)', 'std')}, {rd('min(sentiment_score)', 'min')}, {rd('max(sentiment_score)', 'max')}, {rd('median(sentiment_score)', 'median')},
    {rd('count(*) FILTER (sentiment_score > 0.1) / count(sentiment_score)', 'pct_positive')},
    {rd('count(*) FILTER (sentiment_score BETWEEN -0.1 AND 0.1) / count(sentiment_score)', 'pct_neutral')},
    {rd('count(*) FILTER (sentiment_score < -0.1) / count(sentiment_score)', 'pct_negative')} FROM {{reviews}}""",
)
def _(spark, sf):
    return rounded(SM.score_distribution(table(spark, sf, "reviews"), "sentiment_score"))


DCOLS = ["quantity", "discount", "tax", "spend", "gap"]
DESC = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, {rd(f'avg({c})', 'mean')}, {rd(f'stddev_samp({c})', 'sd')}, {rd(f'min({c})', 'min')}, {rd(f'max({c})', 'max')}, {rd(f'median({c})', 'p50')} FROM {{design}}"
    for c in DCOLS
)


@C.add("agg_describe", DESC)
def _(spark, sf):
    return rounded(SM.describe(table(spark, sf, "design"), DCOLS))


@C.add(
    "exact_quantiles",
    f"""SELECT l_returnflag, {rd('quantile_cont(l_extendedprice, 0.1)', 'q_0', 4)}, {rd('quantile_cont(l_extendedprice, 0.5)', 'q_1', 4)},
    {rd('quantile_cont(l_extendedprice, 0.975)', 'q_2', 4)} FROM {{lineitem}} GROUP BY l_returnflag""",
)
def _(spark, sf):
    from opinara.operators.quantiles import exact_quantiles

    return rounded(exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.975]), 4)


CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {rd(f'corr({a}, {b})', 'r')} FROM {{design}}" for a in DCOLS for b in DCOLS
)


@C.add("agg_corr_matrix", CORR)
def _(spark, sf):
    return rounded(SM.corr_matrix(table(spark, sf, "design"), DCOLS))


@C.add(
    "agg_corr_pairs",
    f"SELECT 'quantity' AS a, 'gap' AS b, {rd('corr(quantity, gap)', 'r')} FROM {{design}} UNION ALL SELECT 'spend', 'price', {rd('corr(spend, price)', 'r')} FROM {{design}}",
)
def _(spark, sf):
    return rounded(SM.corr_pairs(table(spark, sf, "design"), [("quantity", "gap"), ("spend", "price")]))


@C.add(
    "agg_sample_sizes",
    "SELECT count(*) AS n_all, count(*) FILTER (n_reviews >= 20) AS n_ge20, count(*) FILTER (n_reviews >= 30) AS n_ge30, count(*) FILTER (n_reviews >= 40) AS n_ge40 FROM {design}",
)
def _(spark, sf):
    return SM.sample_sizes(table(spark, sf, "design"), "n_reviews", [20, 30, 40])


@C.add("agg_group_mean_log", f"SELECT product_id, brand, {rd('ln(avg(price) OVER (PARTITION BY brand))', 'ln_brand_avg_price')} FROM {{products}}")
def _(spark, sf):
    p = SM.group_mean_log(table(spark, sf, "products"), "brand", "price", "ln_brand_avg_price")
    return rounded(p.select("product_id", "brand", "ln_brand_avg_price"))


@C.add("wide_to_long", " UNION ALL ".join(f"SELECT product_id, '{c}' AS variable, {rd(c, 'value')} FROM {{design}}" for c in DCOLS))
def _(spark, sf):
    return rounded(SM.to_long(table(spark, sf, "design"), ["product_id"], DCOLS))


@C.add("long_to_wide", f"SELECT product_id, {', '.join(rd(c, c) for c in DCOLS)} FROM {{design}}")
def _(spark, sf):
    long = SM.to_long(table(spark, sf, "design"), ["product_id"], DCOLS)
    return rounded(SM.long_to_wide(long, ["product_id"], "variable", "value", DCOLS))


BH = """raw AS (SELECT item, family, p, p * count(*) OVER (PARTITION BY family) / rank() OVER (PARTITION BY family ORDER BY p) AS lo,
      count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM {pvalues}),
    q AS (SELECT item, family, p, m, least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh FROM raw)"""


@C.add("fdr_bh", f"WITH {BH} SELECT item, family, {rd('p', 'p')}, {rd('bh', 'p_bh')} FROM q")
def _(spark, sf):
    return rounded(MT.fdr_bh(table(spark, sf, "pvalues"), "p", ["family"]).select("item", "family", "p", "p_bh"))


@C.add(
    "fdr_by",
    f"""WITH {BH}, h AS (SELECT m, sum(1.0::DOUBLE / i) AS c FROM (SELECT DISTINCT m FROM q) CROSS JOIN range(1, 100000) r(i) WHERE i <= m GROUP BY m)
    SELECT item, family, {rd('p', 'p')}, {rd('least(1.0, bh * c)', 'p_by')} FROM q JOIN h USING (m)""",
)
def _(spark, sf):
    return rounded(MT.fdr_by(table(spark, sf, "pvalues"), "p", ["family"]).select("item", "family", "p", "p_by"))


@C.add(
    "agg_distinct_comments",
    """SELECT l_linenumber AS line, count(DISTINCT l_orderkey) AS n_comments, true AS sketch_close FROM {lineitem} GROUP BY l_linenumber""",
)
def _(spark, sf):
    """Distinct comments by sketches of three batches that overlap, against the exact count (five standard errors)."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("comment"))
    part = F.pmod(F.xxhash64("comment"), F.lit(4))
    batches = [K.distinct_sketches(rows.filter(part.isin(*own)), ["line"], "comment") for own in ([0, 1], [1, 2], [3, 0])]
    guess = K.distinct_estimates(K.merged_sketches(batches[0].unionByName(batches[1]).unionByName(batches[2]), ["line"]), out="guess")
    both = K.distinct_exact(rows, ["line"], "comment", "n_comments").join(guess, "line")
    near = F.abs(F.col("guess") - F.col("n_comments")) <= 5 * 1.04 / 2 ** (K.LG_K / 2) * F.col("n_comments")
    return both.select("line", "n_comments", near.alias("sketch_close"))
