"""Centred weighted moments of the same columns under many sets of weights at once.

A stack has, for each replicate, the weight sum, the weighted means and the centred cross-products of the columns.
Two stacks of the same replicates merge exactly, like :class:`.moments.Moments`, and a single row can be taken out of
centred moments by a rank-one term, so neither resampling nor leaving rows out ever forms sums of raw products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import Moments, salts

#: Replicates of one stack row, and rows of the table that meet them in one matrix product.
REP_BLOCK, ROW_BLOCK = 256, 4096

SCHEMA = "block int, n binary, sw binary, mean binary, s binary"


@dataclass
class Stack:
    """``n`` rows that count, weight sums ``sw``, means and centred cross-products ``s``, replicate first."""

    n: np.ndarray
    sw: np.ndarray
    mean: np.ndarray
    s: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray) -> Stack:
        """Moments of rows ``x`` (rows x columns) under weights ``w`` (replicates x rows)."""
        k = x.shape[1]
        # About the middle of these rows the sums of products are small, whatever the size of the means.
        middle = x.mean(axis=0)
        z = x - middle
        i, j = np.triu_indices(k)
        sw = w.sum(axis=1)
        some = np.maximum(sw, 1e-300)[:, None]
        first = (w @ z) / some
        half = w @ (z[:, i] * z[:, j]) - first[:, i] * first[:, j] * sw[:, None]
        s = np.zeros((len(w), k, k))
        s[:, i, j] = half
        s[:, j, i] = half
        return cls((w > 0).sum(axis=1).astype(np.int64), sw.astype(float), middle + first, s)

    @classmethod
    def rows(cls, parts: Sequence[Moments]) -> Stack:
        return cls(np.array([m.n for m in parts]), np.array([m.sw for m in parts], float), np.stack([m.mean for m in parts]), np.stack([m.s for m in parts]))

    def __add__(self, other: Stack) -> Stack:
        sw = self.sw + other.sw
        share = other.sw / np.maximum(sw, 1e-300)
        apart = np.where(((self.sw > 0) & (other.sw > 0))[:, None], other.mean - self.mean, 0.0)
        s = self.s + other.s + apart[:, :, None] * apart[:, None, :] * (self.sw * share)[:, None, None]
        mean = np.where((self.sw > 0)[:, None], self.mean + apart * share[:, None], other.mean)
        return Stack(self.n + other.n, sw, mean, s)

    def matrix(self) -> np.ndarray:
        """Gram matrices of (1, centred columns); what rounding leaves of a constant column is 0."""
        diagonal = np.diagonal(self.s, axis1=1, axis2=2)
        varies = diagonal > self.sw[:, None] * (1e-13 * self.mean) ** 2
        k = self.mean.shape[1]
        out = np.zeros((len(self.sw), k + 1, k + 1))
        out[:, 0, 0] = self.sw
        out[:, 1:, 1:] = self.s * (varies[:, :, None] & varies[:, None, :])
        return out


def without_each(whole: Moments, x: np.ndarray) -> Stack:
    """The moments of ``whole`` with one row of ``x`` taken out, for each of them; all weights are 1."""
    rest = whole.sw - 1
    apart = x - whole.mean
    s = whole.s - apart[:, :, None] * apart[:, None, :] * (whole.sw / max(rest, 1e-300))
    mean = whole.mean - apart / max(rest, 1e-300)
    return Stack(np.full(len(x), whole.n - 1), np.full(len(x), float(rest)), mean, s)


def _record(block: int, stack: Stack) -> dict:
    return {"block": block, "n": stack.n.tobytes(), "sw": stack.sw.tobytes(), "mean": stack.mean.tobytes(), "s": stack.s.tobytes()}


def _stack(record: dict) -> Stack:
    n, sw = np.frombuffer(record["n"], np.int64), np.frombuffer(record["sw"], float)
    mean = np.frombuffer(record["mean"], float).reshape(len(n), -1)
    k = mean.shape[1]
    return Stack(n, sw, mean, np.frombuffer(record["s"], float).reshape(len(n), k, k))


def replicate_moments(rows: DataFrame, cols: Sequence[str], reps: int, weights: Callable[[], Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]]) -> DataFrame:
    """Stack rows of ``reps`` replicates over ``rows`` (a long column ``_id`` and ``cols``, complete).

    ``weights()`` is called once per task and returns a function of (replicates, ids) that yields (places among the
    ids, weights of those rows by replicate). Weights are made where the rows are; only stacks are shuffled, and they
    are added in two steps so that no task meets those of all others.
    """
    cols = list(cols)
    n_salts = salts(rows)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw, state = weights(), {}
        for pdf in batches:
            x, ids = pdf[cols].to_numpy(dtype=float), pdf["_id"].to_numpy(dtype=np.int64)
            for lo in range(0, len(ids), ROW_BLOCK):
                part, own = x[lo : lo + ROW_BLOCK], ids[lo : lo + ROW_BLOCK]
                for block, first in enumerate(range(0, reps, REP_BLOCK)):
                    for at, w in draw(np.arange(first, min(first + REP_BLOCK, reps), dtype=np.int64), own):
                        new = Stack.of(part[at], w.astype(float))
                        state[block] = state[block] + new if block in state else new
        salt = TaskContext.get().partitionId() % n_salts
        for block, stack in state.items():
            yield pd.DataFrame([_record(block, stack) | {"salt": salt}])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_record(int(pdf["block"].iloc[0]), reduce(Stack.__add__, map(_stack, pdf.to_dict("records"))))])

    parts = rows.select("_id", *cols).mapInPandas(scan, SCHEMA + ", salt int")
    return parts.groupBy("block", "salt").applyInPandas(add, SCHEMA).groupBy("block").applyInPandas(add, SCHEMA)


def replicate_values(stacks: DataFrame, stat) -> DataFrame:
    """``rep, stat, value`` of a statistic in every replicate; one stack row is one stacked solve.

    Replicates without any weight have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(stat.names(), dtype=object)
        for pdf in batches:
            for record in pdf.to_dict("records"):
                stack = _stack(record)
                rep = record["block"] * REP_BLOCK + np.arange(len(stack.sw))
                some = stack.sw > 0
                stack = Stack(stack.n[some], stack.sw[some], stack.mean[some], stack.s[some])
                if some.any():
                    yield pd.DataFrame({"rep": np.repeat(rep[some], len(names)), "stat": np.tile(names, int(some.sum())), "value": stat.evaluate(stack).ravel()})

    return stacks.mapInPandas(run, "rep int, stat string, value double")


def replicate_sums(stacks: DataFrame) -> DataFrame:
    """``rep, n, sw``: rows that count and the weight sum of every replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for record in pdf.to_dict("records"):
                stack = _stack(record)
                yield pd.DataFrame({"rep": record["block"] * REP_BLOCK + np.arange(len(stack.sw)), "n": stack.n, "sw": stack.sw})

    return stacks.select("block", "n", "sw", "mean", "s").mapInPandas(run, "rep int, n long, sw double")


def evaluate_moments(rows: DataFrame, stat, key: str) -> DataFrame:
    """``key, stat, value`` of a statistic for every row of :func:`.moments.moments` (one frame); a batch is one stacked solve."""
    kind = rows.schema["by"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(stat.names(), dtype=object)
        k = len(stat.cols())
        for pdf in batches:
            for lo in range(0, len(pdf), REP_BLOCK):
                part = pdf.iloc[lo : lo + REP_BLOCK]
                stack = Stack(part["n"].to_numpy(), part["sw"].to_numpy(dtype=float), np.stack(part["mean"].to_numpy()), np.stack(part["s"].to_numpy()).reshape(-1, k, k))
                yield pd.DataFrame({"by": np.repeat(part["by"].to_numpy(), len(names)), "stat": np.tile(names, len(part)), "value": stat.evaluate(stack).ravel()})

    out = rows.select("by", "n", "sw", "mean", "s").mapInPandas(run, f"by {kind}, stat string, value double")
    return out.select(F.col("by").alias(key), "stat", "value")
