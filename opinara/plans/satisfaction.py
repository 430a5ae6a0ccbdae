"""Product satisfaction: platform rate and sentiment to five composite outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import composites, finite, logit
from ..operators.standardize import zscore
from ..operators.summary import order_key, sentiment_summary
from ..session import pin

MIN_REVIEWS = 20
Y_WEIGHTS = {"Y_sentiment_only": 1, "Y_favrate_only": 0, "Y_50_50": 0.5, "Y_30_70": 0.3, "Y_70_30": 0.7}

OUTPUT = [
    "product_id", "brand", "price", "n_reviews_total", "n_reviews_used", "n_pos", "n_neu", "n_neg",
    "sentiment_mean", "sentiment_std", "favorable_rate_raw", "favorable_rate_logit", "sentiment_z", "favrate_z",
    "Y_sentiment_only", "Y_favrate_only", "Y_50_50", "Y_30_70", "Y_70_30", "included",
]


def product_satisfaction(
    reviews: DataFrame,
    sentiment: DataFrame,
    order: Sequence[str],
    key: str = "product_id",
    comment: str = "comment_id",
    score: str = "sentiment_score",
    first_cols: Sequence[str] = ("brand", "price", "favorable_rate"),
    min_reviews: int = MIN_REVIEWS,
) -> DataFrame:
    """One row per product of ``reviews``: metadata, sentiment summary, z-scores, composites.

    Metadata are the first non-null values in row order; ``n_reviews_total``
    counts non-null comment ids. The result is pinned: the z statistics need a
    second look at the product table, not at the reviews.
    """
    o = order_key(order)
    meta = reviews.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in first_cols],
        F.count(comment).alias("n_reviews_total"),
    )
    rows = meta.withColumnRenamed("favorable_rate", "favorable_rate_raw").join(
        sentiment_summary(sentiment, key, score), key, "left"
    )
    rows = pin(rows.withColumn("favorable_rate_logit", logit(finite(F.col("favorable_rate_raw")))))
    z = zscore(
        rows,
        ["sentiment_mean", "favorable_rate_logit"],
        ddof=0,
        on_constant="zero",
        names={"sentiment_mean": "sentiment_z", "favorable_rate_logit": "favrate_z"},
    )
    out = composites(z, "sentiment_z", "favrate_z", Y_WEIGHTS)
    return out.withColumn("included", F.col("n_reviews_total") >= min_reviews)
