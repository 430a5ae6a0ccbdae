"""Standardisation against global statistics.

The statistics are one row, attached as a scalar subquery: partial/final
aggregates over the table, then a projection. No unpartitioned window, no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ON_CONSTANT = ("zero", "zero_observed", "raise", "null")


#: Columns of one aggregate: with more than 100 fields Spark no longer compiles it, and each row costs many times as much.
BLOCK = 16

# Rounding noise of a constant column stays below this share of its mean.
NOISE = 1e-13


def _finite(c: str) -> str:
    """SQL text: the column as double, NaN and infinities as null."""
    x = f"cast(`{c}` AS double)"
    return f"CASE WHEN abs({x}) < double('infinity') THEN {x} END"


def column_stats(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """One row with ``stats`` = struct of mean m_i and sd s_i per column; s_i is null without variance.

    Many columns are taken in blocks, each a scan of its own columns.
    """
    sd = "stddev_pop" if ddof == 0 else "stddev_samp"

    def block(at: range) -> DataFrame:
        rows = df.selectExpr(*[f"{_finite(cols[i])} AS x{i}" for i in at])
        aggs = [a for i in at for a in (F.expr(f"avg(x{i}) AS m{i}"), F.expr(f"{sd}(x{i}) AS d{i}"))]
        fields = [f"m{i}, CASE WHEN d{i} > abs(m{i}) * {NOISE} THEN d{i} END AS s{i}" for i in at]
        return rows.agg(*aggs).selectExpr(f"struct({', '.join(fields)}) AS stats")

    blocks = [range(lo, min(lo + BLOCK, len(cols))) for lo in range(0, len(cols), BLOCK)]
    if len(blocks) < 2:
        return block(range(len(cols)))
    # A union, because Spark would merge aggregates of one table that stand side by side into one.
    parts = [block(at).select(*[F.col(f"stats.{v}{i}") for i in at for v in "ms"]) for at in blocks]
    firsts = [F.max(f"{v}{i}").alias(f"{v}{i}") for i in range(len(cols)) for v in "ms"]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*firsts)
    return whole.select(F.struct(*[f"{v}{i}" for i in range(len(cols)) for v in "ms"]).alias("stats"))


def zscore(
    df: DataFrame,
    cols: Sequence[str],
    ddof: int = 0,
    on_constant: str = "zero",
    names: Mapping[str, str] | None = None,
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """Add z-scores (default name ``<col>_z``).

    ``on_constant`` says what a column without variance gives: 0 for every row
    (``zero``), 0 where observed (``zero_observed``), an error (``raise``) or null.
    """
    if on_constant not in ON_CONSTANT:
        raise ValueError(f"on_constant must be one of {ON_CONSTANT}")
    names = names or {c: f"{c}_z" for c in cols}
    source = df if stats_from is None else stats_from
    with_stats = df.withColumn("_stats", column_stats(source, cols, ddof).scalar())
    out = {}
    for i, c in enumerate(cols):
        x = _finite(c)
        flat = {
            "zero": "0.0D",
            "zero_observed": f"CASE WHEN {x} IS NOT NULL THEN 0.0D END",
            "raise": f"cast(raise_error('cannot standardise {c}: invalid standard deviation') AS double)",
            "null": "cast(NULL AS double)",
        }[on_constant]
        out[names[c]] = F.expr(f"CASE WHEN _stats.s{i} IS NULL THEN {flat} ELSE ({x} - _stats.m{i}) / _stats.s{i} END")
    return with_stats.withColumns(out).drop("_stats")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every listed column is present (NaN and infinities count as missing)."""
    types = dict(df.dtypes)
    casts = {c: F.col(c).cast("double") for c in cols if types[c] != "double"}
    rows = (df.withColumns(casts) if casts else df).dropna(subset=list(cols))
    # Two predicates for any number of columns keep the optimiser's constraint sets small.
    sizes = [F.abs(F.col(c)) for c in dict.fromkeys(cols)]
    return rows.filter((F.greatest(*sizes) if len(sizes) > 1 else sizes[0]) < float("inf"))


def zscore_complete(
    df: DataFrame, cols: Sequence[str], ddof: int = 0, names: Mapping[str, str] | None = None
) -> DataFrame:
    """Z-scores over the complete cases of ``cols`` only."""
    return zscore(complete_cases(df, cols), cols, ddof=ddof, on_constant="zero", names=names)
