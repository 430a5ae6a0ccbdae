"""Data contracts: each check has a DataFrame form and, where useful, a failing form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not satisfy a declared contract."""


def require_columns(df: DataFrame, cols: Sequence[str], source: str = "table") -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ContractError(f"{source} is missing required columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    sample = duplicate_keys(df, keys).limit(5).collect()
    if sample:
        raise ContractError(f"{list(keys)} must be unique, for example {[tuple(r) for r in sample]}")
    return df


def positive_report(df: DataFrame, col: str) -> DataFrame:
    """One row: missing and non-positive counts of a column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(col).isNull()).alias("n_missing"),
        F.count_if(F.col(col) <= 0).alias("n_not_positive"),
    )


def assert_positive(df: DataFrame, col: str) -> DataFrame:
    """Lazy: the running query fails on the first missing or non-positive value."""
    bad = F.col(col).isNull() | (F.col(col) <= 0)
    message = F.lit(f"{col} must be positive and nonmissing")
    return df.withColumn(col, F.when(bad, F.raise_error(message).cast(df.schema[col].dataType)).otherwise(F.col(col)))


def key_gaps(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``side`` is ``missing`` or ``unexpected``."""
    have, want = df.select(key).distinct(), expected.select(key).distinct()
    missing = want.join(have, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = have.join(want, key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def assert_keys(df: DataFrame, expected: DataFrame, key: str, exact: bool = True) -> DataFrame:
    gaps = key_gaps(df, expected, key)
    if not exact:
        gaps = gaps.filter(F.col("side") == "missing")
    sample = gaps.limit(5).collect()
    if sample:
        raise ContractError(f"key mismatch on {key}, for example {[tuple(r) for r in sample]}")
    return df


class RidingChecks:
    """Checks of single rows that ride along with the action that reads a table anyway, instead of jobs of their own.

    ``attach`` returns the table to act on; after the action ``verify`` raises for every check that rows broke, with
    their number. Checks on whole keys (uniqueness, expected keys) need rows to meet and stay jobs.
    """

    def __init__(self, name: str = "checks"):
        self.observation = Observation(f"{name}-{uuid.uuid4().hex}")
        self.rules: list[tuple[str, Column]] = []

    def expect(self, message: str, holds: Column) -> RidingChecks:
        """``holds`` must be true; null counts as broken."""
        self.rules.append((message, ~F.coalesce(holds, F.lit(False))))
        return self

    def present(self, *cols: str) -> RidingChecks:
        for c in cols:
            self.expect(f"{c} must not be missing", F.col(c).isNotNull())
        return self

    def positive(self, *cols: str) -> RidingChecks:
        for c in cols:
            self.expect(f"{c} must be positive and nonmissing", F.col(c) > 0)
        return self

    def attach(self, df: DataFrame) -> DataFrame:
        counts = [F.count_if(broken).alias(f"broken_{i}") for i, (_, broken) in enumerate(self.rules)]
        return df.observe(self.observation, F.count(F.lit(1)).alias("n_rows"), *counts)

    def verify(self) -> int:
        """Number of rows seen, if they keep all checks. Waits for the action."""
        got = self.observation.get
        broken = [f"{message} ({got[f'broken_{i}']} rows)" for i, (message, _) in enumerate(self.rules) if got[f"broken_{i}"]]
        if broken:
            raise ContractError("; ".join(broken))
        return got["n_rows"]


def null_report(df: DataFrame, cols: Sequence[str], key: str | None = None) -> DataFrame:
    """Null count per column in one pass; absent columns are flagged, the key's distinct count added."""
    present = [c for c in cols if c in df.columns]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(present)]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    aggs.append((F.count_distinct(F.col(key)) if key else F.lit(None).cast("long")).alias("n_keys"))
    row = df.agg(*aggs)
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in present).alias("present"),
            (F.col(f"n_{present.index(c)}") if c in present else F.lit(None).cast("long")).alias("n_null"),
            F.col("n_rows").alias("n_rows"),
            F.col("n_keys").alias("n_keys"),
        )
        for c in cols
    ]
    return row.select(F.inline(F.array(*items)))


def order_mismatch(df: DataFrame, order: DataFrame, key: str, pos: str) -> DataFrame:
    """(position, key) pairs present on one side only; empty when the orders agree."""
    a, b = df.select(pos, key), order.select(pos, key)
    return a.exceptAll(b).withColumn("side", F.lit("output")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("input"))
    )


def assert_order(df: DataFrame, order: DataFrame, key: str, pos: str) -> DataFrame:
    if order_mismatch(df, order, key, pos).limit(1).collect():
        raise ContractError(f"output order of {key} differs from the input order")
    return df
