"""Merge scores, components and satisfaction into the product master."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id_dashes
from ..functions.scalars import to_numeric
from ..operators.joins import replace_from
from ..sources.readers import clean_names, cols_like


def normalised(df: DataFrame, key: str, norm=norm_id_dashes) -> DataFrame:
    return df.withColumn(key, norm(F.col(key)))


def build_master(
    scores: DataFrame,
    components: DataFrame,
    satisfaction: DataFrame,
    key: str = "product_id",
    replace: Sequence[str] = ("brand", "price", "n_reviews_total"),
    text: Sequence[str] = ("brand",),
    norm_key: bool = True,
) -> DataFrame:
    """Scores left-joined to ``z_pc*`` components and to the satisfaction columns; lower-case names.

    Merge joins: each table may have a row for every product, and Spark would judge it by its packed files and collect
    it on the driver for a broadcast.
    """
    pcs = components.select(key, *cols_like(components, "z_pc"))
    if norm_key:
        scores, pcs, satisfaction = (normalised(d, key) for d in (scores, pcs, satisfaction))
    scores = to_numeric(scores, [c for c in scores.columns if c not in (key, *text) and dict(scores.dtypes)[c] == "string"])
    out = scores.join(pcs.hint("merge"), key, "left")
    take = [c for c in replace if c in satisfaction.columns]
    rest = [c for c in satisfaction.columns if c not in (key, *take) and c not in out.columns]
    return clean_names(replace_from(out, satisfaction.hint("merge"), key, [*take, *rest]))


def derived_controls(
    reviews: DataFrame, key: str, discount: Column, free_shipping: Column, imperfection: Column, newest: Column, as_of: Column
) -> DataFrame:
    """Product controls from review rows: flags, log imperfection and inverse review age."""
    agg = reviews.groupBy(key).agg(
        discount.cast("double").alias("has_discount"),
        free_shipping.cast("double").alias("free_shipping"),
        F.log(imperfection + 1.0).alias("ln_imperfection"),
        newest.alias("_newest"),
    )
    age = F.datediff(as_of, F.col("_newest"))
    return agg.withColumn("recency_inv", 1.0 / (age + 1.0)).drop("_newest")
