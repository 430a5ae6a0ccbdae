"""False-discovery-rate control without whole-family windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import _by, running_counts


def harmonic(m: Column) -> Column:
    """Sum of 1/i for i = 1..m: added up to 30, beyond that the asymptotic series (error < 1e-14)."""
    short = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(30)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    x = m.cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(m <= 30, short).otherwise(series)


def _adjusted(df: DataFrame, p: str, family: Sequence[str], out: str, blocks: int | None) -> DataFrame:
    """Per (family, distinct p): running minimum from the right of p * m / rank, at most 1."""
    rc = running_counts(df, family, p, blocks=blocks)
    raw = rc.withColumn("_raw", F.col(p) * F.col("total") / F.col("cum_n"))
    from_right = Window.partitionBy(*family, "_block").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    raw = raw.withColumn("_min_in", F.min("_raw").over(from_right))
    later = (
        Window.partitionBy(*_by(family)).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = raw.groupBy(*family, "_block").agg(F.min("_raw").alias("_m"))
    edges = edges.select(*family, "_block", F.min("_m").over(later).alias("_min_later"))
    joined = raw.join(edges, [*family, "_block"])
    return joined.select(
        *family, p, F.least(F.col("_min_in"), F.col("_min_later"), F.lit(1.0)).alias(out), F.col("total").alias("_m")
    )


def _attach(df: DataFrame, q: DataFrame, p: str, family: Sequence[str]) -> DataFrame:
    """Back to the rows; one adjusted value per (family, p), so only the row side can be skewed and AQE splits it."""
    return df.join(q, [*family, p], "left")


def fdr(
    df: DataFrame, p: str, family: Sequence[str] = (), bh: str = "p_bh", by: str = "p_by", blocks: int | None = None
) -> DataFrame:
    """Benjamini-Hochberg and Benjamini-Yekutieli adjusted p-values in one pass; a null or NaN p gives nulls and does not count."""
    q = _adjusted(df, p, family, bh, blocks)
    # BH is capped at 1 before scaling; scaling by at least 1 and capping again gives the same value.
    q = q.withColumn(by, F.least(F.col(bh) * harmonic(F.col("_m")), F.lit(1.0)))
    return _attach(df, q.drop("_m"), p, family)


def fdr_bh(
    df: DataFrame, p: str, family: Sequence[str] = (), out: str = "p_bh", blocks: int | None = None
) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values per family; a null or NaN p gives null and does not count."""
    return _attach(df, _adjusted(df, p, family, out, blocks).drop("_m"), p, family)


def fdr_by(
    df: DataFrame, p: str, family: Sequence[str] = (), out: str = "p_by", blocks: int | None = None
) -> DataFrame:
    """Benjamini-Yekutieli: the BH value scaled by the harmonic number of the family size, at most 1."""
    return fdr(df, p, family, "_bh", out, blocks).drop("_bh")
