"""Centred second moments for many column sets in one scan.

A task keeps, for each group and column set, the row count, weight sum, means and centred cross-products of the rows
complete in that set. Two such summaries merge exactly (the means' distance enters the cross-products), so a mean
that is large against the spread costs no digits and no pass is needed for the means.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Summaries a task holds before it hands them on.
FLUSH = 2048
#: Rows per group below which groups share array operations, and rows of one such operation.
SHORT, SLICE = 48, 2048


@dataclass
class Moments:
    """Rows, weight sum, means and centred cross-products of some columns."""

    n: int
    sw: float
    mean: np.ndarray
    s: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray) -> Moments:
        sw = float(w.sum())
        mean = w @ x / sw
        apart = x - mean
        return cls(len(x), sw, mean, (apart * w[:, None]).T @ apart)

    def __add__(self, other: Moments) -> Moments:
        sw = self.sw + other.sw
        apart = other.mean - self.mean
        s = self.s + other.s + np.outer(apart, apart) * (self.sw * other.sw / sw)
        return Moments(self.n + other.n, sw, self.mean + apart * (other.sw / sw), s)

    def pick(self, at: np.ndarray) -> Moments:
        return Moments(self.n, self.sw, self.mean[at], self.s[np.ix_(at, at)])

    def matrix(self) -> np.ndarray:
        """Gram matrix of (1, centred columns); what rounding leaves of a constant column is 0."""
        varies = np.diag(self.s) > self.sw * (1e-13 * self.mean) ** 2
        out = np.zeros((len(self.mean) + 1,) * 2)
        out[0, 0], out[1:, 1:] = self.sw, self.s * np.outer(varies, varies)
        return out


def total(parts: Iterable[Moments]) -> Moments | None:
    out = None
    for p in parts:
        out = p if out is None else out + p
    return out


def salts(df: DataFrame) -> int:
    """Groups in which the partial results of all tasks are added first."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def complete_sets(fine: np.ndarray, where: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Distinct masks of the rows complete in a column set, each with the sets that have it."""
    found: dict[bytes, tuple[np.ndarray, list[int]]] = {}
    for i, at in enumerate(where):
        mask = fine[:, at].all(axis=1)
        found.setdefault(mask.tobytes(), (mask, []))[1].append(i)
    return (v for v in found.values() if v[0].any())


def matrix_rows(df: DataFrame, cols: Sequence[str], weight: str | None, by: str | None) -> DataFrame:
    """Columns as doubles under plain names: ``by``, ``weight``, ``c0`` .. ."""
    named = [F.col(by).alias("by")] if by else [F.lit(0).alias("by")]
    named.append((F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    return df.select(*named, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])


def groups_of(pdf: pd.DataFrame) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, columns, weights, finite cells) of a batch of :func:`matrix_rows`, split once."""
    x, w = pdf.iloc[:, 2:].to_numpy(dtype=float), pdf["weight"].to_numpy(dtype=float)
    fine = np.isfinite(x) & np.isfinite(w)[:, None]
    for key, rows in pdf.groupby("by", dropna=False, sort=False).indices.items():
        yield None if pd.isna(key) else key, x[rows], w[rows], fine[rows]


def runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def of_groups(x: np.ndarray, w: np.ndarray, first: np.ndarray) -> Iterator[Moments]:
    """Moments of runs of rows that begin at ``first``; short runs share the array operations of a slice."""
    ends = np.append(first[1:], len(x))
    if len(x) >= SHORT * len(first):
        yield from (Moments.of(x[a:b], w[a:b]) for a, b in zip(first.tolist(), ends.tolist()))
        return
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(ends, first[at] + SLICE, side="right")))
        low, high = int(first[at]), int(ends[stop - 1])
        own, weight, place = x[low:high], w[low:high], first[at:stop] - low
        size = ends[at:stop] - first[at:stop]
        sw = np.add.reduceat(weight, place)
        # Two steps: about each run's first row, then about its mean.
        near = own - np.repeat(own[place], size, axis=0)
        mean = np.add.reduceat(near * weight[:, None], place) / sw[:, None]
        apart = near - np.repeat(mean, size, axis=0)
        s = np.add.reduceat(apart[:, :, None] * (apart * weight[:, None])[:, None, :], place)
        mean = mean + own[place]
        yield from (Moments(int(n), float(v), m, c) for n, v, m, c in zip(size, sw, mean, s))
        at = stop


def merged(n: np.ndarray, sw: np.ndarray, mean: np.ndarray, s: np.ndarray, first: np.ndarray) -> Iterator[Moments]:
    """Sums of runs of summaries of the same columns, about the mean of each run."""
    size, k = np.diff(np.append(first, len(n))), mean.shape[1]
    near = mean - np.repeat(mean[first], size, axis=0)
    total_n, total_sw = np.add.reduceat(n, first), np.add.reduceat(sw, first)
    middle = np.add.reduceat(near * sw[:, None], first) / total_sw[:, None]
    apart = near - np.repeat(middle, size, axis=0)
    whole = np.add.reduceat(s.reshape(-1, k, k) + apart[:, :, None] * (apart * sw[:, None])[:, None, :], first)
    yield from (Moments(int(a), float(b), c, d) for a, b, c, d in zip(total_n, total_sw, middle + mean[first], whole))


def moments(df: DataFrame, frames: Sequence[Sequence[str]], weight: str | None = None, by: str | None = None) -> DataFrame:
    """One row per (group, frame) that has a complete row: ``by, frame, n, sw, mean, s``.

    One scan for any number of column sets; sets that miss the same rows of a batch share a matrix product. Weights
    must be positive. Any number of groups: tasks hand on what they hold every ``FLUSH`` summaries, partial results
    are added in two steps, so that no task meets those of all others, and each step runs over sorted rows.
    """
    cols = list(dict.fromkeys(c for f in frames for c in f))
    place = {c: i for i, c in enumerate(cols)}
    where = [np.array([place[c] for c in f], int) for f in frames]
    n_salts = salts(df)
    kind = df.schema[by].dataType.simpleString() if by else "int"
    schema = f"by {kind}, frame int, n long, sw double, mean array<double>, s array<double>"

    def frame_of(rows: dict[tuple, Moments], **extra) -> pd.DataFrame:
        out = pd.DataFrame({"by": pd.Series([k[0] for k in rows], dtype=object), "frame": [k[1] for k in rows]})
        values = list(rows.values())
        out["n"], out["sw"] = [m.n for m in values], [m.sw for m in values]
        out["mean"], out["s"] = [m.mean for m in values], [m.s.ravel() for m in values]
        return out.assign(**extra)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId() % n_salts
        state: dict[tuple, Moments] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            codes, keys = pd.factorize(pdf["by"], use_na_sentinel=False)
            keys = [None if pd.isna(k) else k for k in keys]
            order = np.argsort(codes, kind="stable")
            codes, x = codes[order], pdf.iloc[:, 2:].to_numpy(dtype=float)[order]
            w = pdf["weight"].to_numpy(dtype=float)[order]
            fine = np.isfinite(x) & np.isfinite(w)[:, None]
            for mask, sets in complete_sets(fine, where):
                at = np.unique(np.concatenate([where[i] for i in sets]))
                own = codes[mask]
                first = runs(own)
                for code, part in zip(own[first].tolist(), of_groups(x[mask][:, at], w[mask], first)):
                    for i in sets:
                        new, key = part.pick(np.searchsorted(at, where[i])), (keys[code], i)
                        state[key] = state[key] + new if key in state else new
            if len(state) >= FLUSH:
                yield frame_of(state, salt=salt)
                state = {}
        if state:
            yield frame_of(state, salt=salt)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds rows of one key, which come one after another; the last key of a batch may go on in the next."""
        held: tuple[tuple, Moments] | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            by_code, by_keys = pd.factorize(pdf["by"], use_na_sentinel=False)
            sets = pdf["frame"].to_numpy()
            first = runs(by_code.astype(np.int64) * len(frames) + sets)
            ends = np.append(first[1:], len(pdf))
            done: dict[tuple, Moments] = {}
            for i in np.unique(sets).tolist():
                own = np.flatnonzero(sets[first] == i)
                rows = np.concatenate([np.arange(a, b) for a, b in zip(first[own], ends[own])])
                part = pdf.iloc[rows]
                whole = merged(part["n"].to_numpy(), part["sw"].to_numpy(dtype=float), np.stack(part["mean"].to_numpy()), np.stack(part["s"].to_numpy()), np.concatenate([[0], np.cumsum(ends[own] - first[own])[:-1]]))
                for at, m in zip(own.tolist(), whole):
                    key = by_keys[by_code[first[at]]]
                    done[at] = (None if pd.isna(key) else key, i), m
            ordered = [done[at] for at in range(len(first))]
            if held is not None and held[0] == ordered[0][0]:
                ordered[0] = held[0], held[1] + ordered[0][1]
            elif held is not None:
                ordered.insert(0, held)
            held = ordered.pop()
            if ordered:
                yield frame_of(dict(ordered))
        if held is not None:
            yield frame_of(dict([held]))

    parts = matrix_rows(df, cols, weight, by).mapInPandas(scan, schema + ", salt int")
    first = parts.repartition("by", "frame", "salt").sortWithinPartitions("by", "frame", "salt").drop("salt").mapInPandas(add, schema)
    return first.repartition("by", "frame").sortWithinPartitions("by", "frame").mapInPandas(add, schema)


def of_row(r) -> Moments:
    """The summary held by one row of :func:`moments`."""
    mean = np.array(r["mean"], float)
    return Moments(int(r["n"]), float(r["sw"]), mean, np.array(r["s"], float).reshape(len(mean), len(mean)))
