"""Joins of the pipeline. Small sides are left to the optimiser's size estimates:
AQE broadcasts a side only when its measured size is below the threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.contracts import assert_keys, assert_unique


def left_dim(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join; null keys on the dimension side never match."""
    return df.join(dim.filter(F.col(key).isNotNull()), key, "left")


def full_outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "full")


def attach_order(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    return df.join(order, key, "inner")


def todo(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done.select(key), key, "left_anti")


def join_one_to_one(a: DataFrame, b: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join that fails when a key repeats on either side."""
    assert_unique(a, [key])
    assert_unique(b, [key])
    return a.join(b, key, how)


def ordered_lookup(df: DataFrame, order: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Rows of ``df`` in the key list of ``order`` (with its position column); fails on missing keys."""
    if check:
        assert_keys(df, order, key, exact=False)
    return order.join(df, key, "inner")


def relabel(df: DataFrame, map_df: DataFrame, on: str) -> DataFrame:
    """Inner join to a label table: unknown labels drop out."""
    return df.join(map_df, on, "inner")


def results_to_rows(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Input rows with their results; rows without a result keep nulls."""
    return rows.join(results, key, "left")


def replace_from(df: DataFrame, other: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Drop ``cols`` from ``df`` and take them from ``other``."""
    return df.drop(*cols).join(other.select(key, *cols), key, "left")
