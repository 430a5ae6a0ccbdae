"""Distinct counts that add up: sketches beside the exact count.

A sketch of a group is a few kilobytes whatever its size, and sketches of batches merge without their rows, so a
running distinct count (comments of a product that come back in several responses, say) needs no past rows. The
relative standard error is about 1.04 / sqrt(2**lg_k). :func:`distinct_exact` is the way when an error will not do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12


def distinct_sketches(df: DataFrame, keys: Sequence[str], col: str, lg_k: int = LG_K, out: str = "sketch") -> DataFrame:
    """One sketch of the distinct values of ``col`` per group, built map-side; null values do not count."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, lg_k).alias(out))


def merged_sketches(parts: DataFrame, keys: Sequence[str], sketch: str = "sketch") -> DataFrame:
    """One sketch per group from sketches of any number of batches; a batch that comes twice changes nothing."""
    return parts.groupBy(*keys).agg(F.hll_union_agg(sketch, F.lit(True)).alias(sketch))


def distinct_estimates(sketches: DataFrame, sketch: str = "sketch", out: str = "n_distinct") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate(sketch)).drop(sketch)


def distinct_exact(df: DataFrame, keys: Sequence[str], col: str, out: str = "n_distinct") -> DataFrame:
    """Exact distinct values per group, by two groupings, so that a hot group is spread over its values."""
    pairs = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.lit(1).alias("_one"))
    counted = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.select(*keys).distinct().join(counted, list(keys), "left").fillna(0, [out])
