"""Correlations of all pairs of columns, each over the rows where both are present, for tables of any width.

With a matrix of values and a mask of what is present, the counts, sums and cross-products of all pairs are products
of matrices, so a batch of rows costs four of them however many pairs there are. Means and centred products
of pairs from different tasks merge exactly, element by element.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import salts
from .standardize import NOISE

#: Rows of one set of matrix products; columns of the result that come out in one frame.
ROWS, ROWS_OUT = 4096, 64

_PARTS = ("n", "mean", "sxx", "sxy")
_SCHEMA = "salt int, n binary, mean binary, sxx binary, sxy binary"


@dataclass
class Pairs:
    """For the pair (i, j): rows, mean of i, centred square of i and centred product, over rows where both are present."""

    n: np.ndarray
    mean: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Pairs:
        there = np.isfinite(x)
        with np.errstate(invalid="ignore"):
            middle = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        z, mask = np.where(there, x - middle, 0.0), there.astype(float)
        n = mask.T @ mask
        some = np.maximum(n, 1)
        # First i then j: sums of i over the rows where j is there too.
        total = z.T @ mask
        mean = total / some
        sxx = (z * z).T @ mask - total * mean
        sxy = z.T @ z - total * mean.T
        return cls(n, mean + middle[:, None], np.maximum(sxx, 0.0), sxy)

    def __add__(self, other: Pairs) -> Pairs:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        mean = np.where(self.n > 0, self.mean + apart * share, other.mean)
        both = self.n * share
        return Pairs(n, mean, self.sxx + other.sxx + apart * apart * both, self.sxy + other.sxy + apart * apart.T * both)

    def correlations(self) -> np.ndarray:
        """NaN where a pair has fewer than two rows or a side without variance."""
        varies = self.sxx > self.n * (NOISE * self.mean) ** 2
        fine = (self.n > 1) & varies & varies.T
        with np.errstate(all="ignore"):
            r = self.sxy / np.sqrt(self.sxx * self.sxx.T)
        return np.where(fine, np.clip(r, -1.0, 1.0), np.nan)

    def record(self, salt: int) -> dict:
        return {"salt": salt} | {p: np.ascontiguousarray(getattr(self, p)).tobytes() for p in _PARTS}


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, r`` for every ordered pair of columns, a column with itself included; ``r`` is null where it has no value.

    NaN and infinities count as missing. One scan; partial results are added in two steps. Memory of a task: four
    matrices of columns x columns. Without columns or rows all values are null.
    """
    cols = list(cols)
    k, n_salts = len(cols), salts(df)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def read(record: dict) -> Pairs:
        return Pairs(*(np.frombuffer(record[p]).reshape(k, k) for p in _PARTS))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for lo in range(0, len(pdf), ROWS):
                part = Pairs.of(pdf.iloc[lo : lo + ROWS].to_numpy(dtype=float))
                total = part if total is None else total + part
        # Every task has a row, so that an empty table has a result.
        total = Pairs(*(np.zeros((k, k)) for _ in _PARTS)) if total is None else total
        yield pd.DataFrame([total.record(TaskContext.get().partitionId() % n_salts)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([reduce(Pairs.__add__, map(read, pdf.to_dict("records"))).record(0)])

    def long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for record in pdf.to_dict("records"):
                r = read(record).correlations()
                for lo in range(0, k, ROWS_OUT):
                    part = r[lo : lo + ROWS_OUT]
                    values = pd.Series(part.ravel()).astype(object)
                    yield pd.DataFrame({"a": np.repeat(cols[lo : lo + ROWS_OUT], k), "b": np.tile(cols, len(part)), "r": values.where(values.notna(), None)})

    if not cols:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    some = rows.mapInPandas(scan, _SCHEMA).groupBy("salt").applyInPandas(add, _SCHEMA)
    return some.groupBy("salt").applyInPandas(add, _SCHEMA).mapInPandas(long, "a string, b string, r double")
