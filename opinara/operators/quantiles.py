"""Exact running counts and quantiles that do not depend on group sizes.

A window over a whole group puts the group into one task. Here the value axis
is cut at global quantiles, so a (group, block) cell holds at most about
1/blocks of the distinct rows however large the group is. Windows run inside
cells; a short window over the at most ``blocks`` cell totals of a group links
them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..session import pin


def block_count(df: DataFrame) -> int:
    """Blocks per group: the shuffle parallelism of the session, which follows the data."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_value_blocks(df: DataFrame, value: str, blocks: int | None = None) -> DataFrame:
    """Add ``_block``: index of the global quantile range the value falls in."""
    k = blocks or block_count(df)
    probs = [i / k for i in range(1, k)]
    cuts = sorted(set(df.approxQuantile(value, probs, 0.25 / k)))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn("_block", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol="_block", handleInvalid="error").transform(df)


def _by(groups: Sequence[str]) -> list[Column]:
    return [F.col(g) for g in groups] or [F.lit(0)]


def running_counts(
    df: DataFrame, groups: Sequence[str], value: str, weight: Column | None = None, blocks: int | None = None
) -> DataFrame:
    """Distinct values per group with ``n``, inclusive ``cum_n`` and group ``total``.

    Duplicates collapse map-side first. Null, NaN and infinite values are dropped.
    """
    rows = df.filter(finite(F.col(value)).isNotNull())
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # Pinned: the cut points and the windows both read it, the source is read once.
    d = pin(rows.groupBy(*groups, value).agg(n.alias("n")))
    b = with_value_blocks(d, value, blocks)
    inside = Window.partitionBy(*groups, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_in", F.sum("n").over(inside))
    totals = b.groupBy(*groups, "_block").agg(F.sum("n").alias("_tot"))
    across = Window.partitionBy(*_by(groups)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_by(groups))
    totals = totals.select(
        *groups,
        "_block",
        F.coalesce(F.sum("_tot").over(across), F.lit(0)).alias("_before"),
        F.sum("_tot").over(whole).alias("total"),
    )
    out = b.join(totals, [*groups, "_block"])
    return out.withColumn("cum_n", F.col("_before") + F.col("_in")).drop("_in", "_before")


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], blocks: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles ``q_0..`` per group, exact at any group size.

    A histogram over the blocks (one small row per group and block) tells which
    blocks hold the wanted ranks. Only the values of those blocks are shuffled
    and ordered. The target table is written first, so the join knows its size
    and is broadcast only when that is small.
    """
    rows = df.select(*groups, finite(F.col(value).cast("double")).alias(value)).filter(F.col(value).isNotNull())
    b = with_value_blocks(rows, value, blocks)
    hist = b.groupBy(*groups, "_block").agg(F.count(F.lit(1)).alias("_c"))
    across = Window.partitionBy(*_by(groups)).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*_by(groups))
    hist = hist.withColumns({"_upto": F.sum("_c").over(across), "total": F.sum("_c").over(whole)})
    before = F.col("_upto") - F.col("_c")
    holds = F.lit(False)
    for p in probs:
        for rank in _ranks(p):
            holds = holds | ((before <= rank) & (rank < F.col("_upto")))
    targets = pin(hist.filter(holds).select(*groups, "_block", before.alias("_before"), "total"))
    fine = b.join(targets, [*groups, "_block"]).groupBy(*groups, "_block", "_before", "total", value)
    fine = fine.agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*groups, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = fine.withColumn("_hi", F.col("_before") + F.sum("n").over(inside))
    aggs = [F.max("total").alias("_total")]
    for i, p in enumerate(probs):
        for name, rank in zip(("lo", "hi"), _ranks(p)):
            hit = (F.col("_hi") - F.col("n") <= rank) & (rank < F.col("_hi"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{i}"))
    q = placed.groupBy(*groups).agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        frac = pos - F.floor(pos)
        out.append((F.col(f"_lo_{i}") + frac * (F.col(f"_hi_{i}") - F.col(f"_lo_{i}"))).alias(f"q_{i}"))
    return q.select(*groups, *out)


def _ranks(p: float) -> tuple[Column, Column]:
    """0-based ranks on either side of the quantile position."""
    pos = F.lit(float(p)) * (F.col("total") - 1)
    return F.floor(pos), F.ceil(pos)
