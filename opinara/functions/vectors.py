"""Vector expressions on array columns; sums run in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda a, x: a + x * x))


def vec_check(vec: Column, dim: int) -> Column:
    """ok, missing, bad_length, not_finite or zero."""
    v = as_double(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        F.when(vec.isNull(), "missing")
        .when(F.size(vec) != dim, "bad_length")
        .when(~finite, "not_finite")
        .when(F.forall(v, lambda x: x == 0), "zero")
        .otherwise("ok")
    )


def l2_normalize(vec: Column, on_zero: str = "raise") -> Column:
    v, n = as_double(vec), norm(vec)
    if on_zero == "raise":
        bad = F.raise_error(F.lit("zero vector cannot be normalised")).cast("array<double>")
    else:
        bad = F.lit(None).cast("array<double>")
    return F.when(n > 0, F.transform(v, lambda x: x / n)).when(vec.isNotNull(), bad)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cols_to_vec(df: DataFrame, cols: Sequence[str], out: str = "vec") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("float") for c in cols])).drop(*cols)


def vec_to_cols(df: DataFrame, vec: str, dim: int, prefix: str) -> DataFrame:
    width = max(3, len(str(dim - 1)))
    cols = [F.get(F.col(vec), F.lit(i)).alias(f"{prefix}{i:0{width}d}") for i in range(dim)]
    return df.select(*[c for c in df.columns if c != vec], *cols)
