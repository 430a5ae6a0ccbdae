"""Product metadata, sentiment summaries, distributions and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .pairwise import pairwise_correlations
from .quantiles import exact_quantiles


def order_key(order: Sequence[str]) -> Column:
    """Comparable struct that stands for the row order."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_non_null(df: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-null value of each column per key, by the explicit row order."""
    o = order_key(order)
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in cols]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def count_non_null(df: DataFrame, key: str, col: str, out: str = "n") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(col).alias(out))


def sentiment_summary(df: DataFrame, key: str, score: str) -> DataFrame:
    x = F.col(score)
    cls = S.tri_class(x)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(x).alias("n_reviews_used"),
        F.avg(x).alias("sentiment_mean"),
        F.stddev_samp(x).alias("sentiment_std"),
        F.count_if(cls == "pos").alias("n_pos"),
        F.count_if(cls == "neg").alias("n_neg"),
        F.count_if(cls == "neu").alias("n_neu"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def score_distribution(df: DataFrame, col: str) -> DataFrame:
    """Validity, moments, median and class shares of one score column, one row."""
    x = S.finite(F.col(col))
    d = df.select(x.alias("x"))
    cls = S.tri_class(F.col("x"))
    n = F.count("x")
    stats = d.agg(
        F.count(F.lit(1)).alias("n_total"),
        n.alias("n_valid"),
        F.count_if(F.col("x").isNull()).alias("n_failed"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        S.ratio(F.count_if(cls == "pos"), n).alias("pct_positive"),
        S.ratio(F.count_if(cls == "neu"), n).alias("pct_neutral"),
        S.ratio(F.count_if(cls == "neg"), n).alias("pct_negative"),
    )
    median = exact_quantiles(d, [], "x", [0.5]).select("q_0")
    return stats.withColumn("median", median.scalar())


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "variable", val: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in cols], var, val)


def long_to_wide(df: DataFrame, ids: Sequence[str], var: str, val: str, values: Sequence[str]) -> DataFrame:
    aggs = [F.max(F.when(F.col(var) == v, F.col(val))).alias(v) for v in values]
    return df.groupBy(*ids).agg(*aggs)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N, mean, sd, min, median, max: one row per variable, exact median."""
    long = to_long(df, [], cols).withColumn("value", S.finite(F.col("value"))).filter(F.col("value").isNotNull())
    basic = long.groupBy("variable").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    medians = exact_quantiles(long, ["variable"], "value", [0.5]).withColumnRenamed("q_0", "p50")
    return basic.join(medians, "variable")


def corr_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], mirror: bool = False) -> DataFrame:
    """Pearson correlation of each pair over its complete rows, one pass.

    ``mirror`` also lists every pair the other way round.
    """
    used = list(dict.fromkeys(c for p in pairs for c in p))
    clean = df.select(*[S.finite(F.col(c).cast("double")).alias(c) for c in used])
    # corr skips rows where either side is null.
    row = clean.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entry = lambda a, b, i: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
    items = [entry(a, b, i) for i, (a, b) in enumerate(pairs)]
    if mirror:
        items += [entry(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    return row.select(F.inline(F.array(*items)))


def corr_matrix(df: DataFrame, cols: Sequence[str], complete: bool = False) -> DataFrame:
    """Long correlation matrix of any number of columns; pairwise complete, or on the rows complete in all columns."""
    if complete:
        df = df.dropna(subset=list(cols))
    return pairwise_correlations(df, cols)


def sample_sizes(df: DataFrame, col: str, thresholds: Sequence[int]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_all")]
    aggs += [F.count_if(F.col(col) >= t).alias(f"n_ge{t}") for t in thresholds]
    return df.agg(*aggs)


def group_mean_log(df: DataFrame, key: str, col: str, out: str = "ln_group_mean") -> DataFrame:
    """Log of the group mean attached to every row (aggregate and join, no window over hot groups)."""
    means = df.groupBy(key).agg(F.log(F.avg(col)).alias(out))
    return df.join(means, key, "left")


def run_stats(checkpoint: DataFrame, n_comments: int | None = None) -> DataFrame:
    """Match rate, matches per comment, token totals and cache hit rate, one row."""
    agg = checkpoint.agg(
        F.count(F.lit(1)).alias("n_comments_total"),
        F.count_if(F.col("n_matches") > 0).alias("n_comments_with_match"),
        F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_total_matches"),
        F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("n_input_tokens"),
        F.coalesce(F.sum("cached_tokens"), F.lit(0)).alias("n_cached_tokens"),
        F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("n_output_tokens"),
    )
    total = F.greatest(F.col("n_comments_total"), F.lit(1)) if n_comments is None else F.lit(max(n_comments, 1))
    share = lambda a, b: F.round(F.col(a).cast("double") / b, 4)
    return agg.withColumns(
        {
            "comment_match_rate": share("n_comments_with_match", total),
            "avg_matches_per_comment": share("n_total_matches", total),
            "cache_hit_rate": share("n_cached_tokens", F.greatest(F.col("n_input_tokens"), F.lit(1))),
        }
    )
