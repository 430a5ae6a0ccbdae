"""Row-level set work: dedupe, first-seen order, dense ids, unions, differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .summary import order_key


def first_seen(df: DataFrame, key: str, order: Sequence[str], out: str = "first_pos") -> DataFrame:
    """Keys with the row-order value of their first row; sort by it to restore the order."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order_key(order)).alias(out))


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest row per key."""
    cols = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_r"))
    return last.select(key, "_r.*").select(*df.columns)


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key by the explicit row order."""
    cols = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*cols), order_key(order)).alias("_r"))
    return first.select(key, "_r.*").select(*df.columns)


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based dense position of every row in the given total order.

    Range-partitioned sort, written to the shared folder so that recomputation
    cannot renumber rows; then each partition adds the sizes of the partitions before
    it (one row per partition, so the offset table is bounded).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    pinned = pin(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    block = F.shiftright("_mid", 33)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    placed = pinned.withColumns({"_blk": block, "_pos": pos}).drop("_mid")
    sizes = placed.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = placed.join(F.broadcast(offsets), "_blk")
    return joined.withColumn(out, F.col("_off") + F.col("_pos")).drop("_blk", "_pos", "_off")


def group_id(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Dense integer id (from 1) per distinct key in key order, joined back to the rows."""
    keys = dense_index(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], out)
    return df.join(keys.withColumn(out, F.col(out) + 1), key, "left")


def sort_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total order: the keys first, remaining columns as tie-break."""
    rest = [c for c in df.columns if c not in keys]
    return df.orderBy(*keys, *rest)


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def stack_rows(dfs: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that are absent from ``b``."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
