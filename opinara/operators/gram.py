"""Cross-product matrices: the one scan behind every regression.

A Gram row holds, for one group, the sums of z_i * z_j with z = (1, columns).
Regressions, VIFs, indirect effects and replicates need nothing else from the
data, so only (k+1)^2 sums per group and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import salts
from .standardize import complete_cases

CONST = "_cons"
#: Smallest over largest eigenvalue of a design scaled to unit diagonal: below ``EXACT`` its columns count as
#: dependent, and below ``CLOSE`` too few digits would be left.
EXACT, CLOSE = 1e-13, 1e-10
# Above this many columns (constant included) generated code gets too wide and
# one matrix product per Arrow batch is faster than separate sums.
NATIVE_COLUMNS = 12
FLUSH_GROUPS = 2048


def gram(df: DataFrame, cols: Sequence[str], weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by.., n, sw, g): row count, weight sum and the flattened cross-product matrix.

    Rows with a missing value in any column are left out.
    """
    cols = list(cols)
    rows = complete_cases(df, cols + ([weight] if weight else []))
    if len(cols) + 1 <= NATIVE_COLUMNS:
        return _native(rows, cols, weight, by)
    return sum_partials(
        rows.select(*by, *cols, *([weight] if weight else [])).mapInPandas(
            _gram_task(cols, weight, list(by)), partial_schema(df, by)
        ),
        by,
    )


def _native(rows: DataFrame, cols: list[str], weight: str | None, by: Sequence[str]) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    z = [F.lit(1.0), *[F.col(c) for c in cols]]
    k = len(z)
    aggs = [F.sum(w * z[i] * z[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    cells = [F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]
    out = sums.select(*by, "n", F.col("s0_0").alias("sw"), F.array(*cells).alias("g"))
    return out.filter(F.col("n") > 0)


def partial_schema(df: DataFrame, by: Sequence[str]) -> str:
    keys = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    return f"{keys}n long, sw double, g array<double>"


def sum_partials(partials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the partial matrices of all tasks per group, in two steps so that no task meets those of all others."""
    sums = [F.sum("n").alias("n"), F.sum("sw").alias("sw")]
    salted = partials.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts(partials))))
    first = salted.groupBy(*by, "_salt").agg(*sums, Summarizer.sum(array_to_vector("g")).alias("_g"))
    whole = first.groupBy(*by).agg(*sums, Summarizer.sum(F.col("_g")).alias("_g"))
    return whole.filter(F.col("n") > 0).select(*by, "n", "sw", vector_to_array("_g").alias("g"))


def _gram_task(cols: list[str], weight: str | None, by: list[str]):
    def emit(state: dict) -> pd.DataFrame:
        out = pd.DataFrame([k for k in state], columns=by) if by else pd.DataFrame(index=range(len(state)))
        out["n"] = [v[0] for v in state.values()]
        out["sw"] = [v[1] for v in state.values()]
        out["g"] = [v[2].ravel() for v in state.values()]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(dtype=float)])
            w = pdf[weight].to_numpy(dtype=float) if weight else np.ones(len(pdf))
            groups = pdf.groupby(by, dropna=False).indices if by else {(): slice(None)}
            for key, rows in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                zw = z[rows] * w[rows][:, None]
                part = (len(zw), float(w[rows].sum()), zw.T @ z[rows])
                if key in state:
                    old = state[key]
                    part = (old[0] + part[0], old[1] + part[1], old[2] + part[2])
                state[key] = part
            if len(state) >= FLUSH_GROUPS:
                yield emit(state)
                state = {}
        if state:
            yield emit(state)

    return run


def index_of(cols: Sequence[str], names: Sequence[str]) -> np.ndarray:
    """Positions of names in a Gram over ``cols`` (the constant is position 0)."""
    pos = {CONST: 0, **{c: i + 1 for i, c in enumerate(cols)}}
    return np.array([pos[n] for n in names])


def solve(g: np.ndarray, cols: Sequence[str], y: str, x: Sequence[str]) -> np.ndarray:
    """Coefficients (constant first) for a stack of centred Grams.

    Exactly dependent columns share their effect (pseudo-inverse); a design so close to that that digits would be
    lost raises.
    """
    ix, iy = index_of(cols, [CONST, *x]), index_of(cols, [y])[0]
    a, b = g[..., ix[:, None], ix[None, :]], g[..., ix, iy]
    d = np.sqrt(np.maximum(np.diagonal(a, axis1=-2, axis2=-1), 1e-300))
    values, vectors = np.linalg.eigh(a / (d[..., :, None] * d[..., None, :]))
    size = np.abs(values)
    largest = np.maximum(size.max(axis=-1, keepdims=True), 1e-300)
    # A column without spread has an eigenvalue of 0 to the digit and is no sign of lost digits.
    near = (size > EXACT * largest) & (size < CLOSE * largest)
    if near.any():
        raise ValueError(f"{y} on {', '.join(x)}: the design is ill-conditioned")
    inverse = np.where(size > EXACT * largest, 1.0, 0.0) / np.where(size > EXACT * largest, values, 1.0)
    beta = np.einsum("...ij,...j,...kj,...k->...i", vectors, inverse, vectors, b / d, optimize=True)
    return beta / d


def scaled_eigenvalues(a: np.ndarray) -> np.ndarray:
    """Sizes of the eigenvalues of one Gram after scaling to unit diagonal."""
    d = np.sqrt(np.maximum(np.diagonal(a), 1e-300))
    return np.abs(np.linalg.eigvalsh(a / np.outer(d, d)))


def rank_of(a: np.ndarray) -> int:
    """Independent columns of one Gram, by the measure of :func:`scaled_inverse`."""
    values = scaled_eigenvalues(a)
    return int((values > 1e-12 * values.max()).sum())


def condition_of(a: np.ndarray) -> float:
    """Smallest over largest of the scaled eigenvalues."""
    values = scaled_eigenvalues(a)
    return float(values.min() / values.max())


def scaled_inverse(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse after scaling to unit diagonal, so units do not decide the rank."""
    d = np.sqrt(np.maximum(np.diagonal(a, axis1=-2, axis2=-1), 1e-300))
    scaled = a / (d[..., :, None] * d[..., None, :])
    inv = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True)
    return inv / (d[..., :, None] * d[..., None, :])


def correlation(g: np.ndarray) -> np.ndarray:
    """Correlation matrix of the columns (constant dropped) from one Gram."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov / np.outer(sd, sd)


def vif_values(g: np.ndarray, cols: Sequence[str], x: Sequence[str]) -> dict[str, float]:
    """1 / (1 - R^2) of each column on the others: the diagonal of the inverse correlation matrix."""
    ix = np.concatenate([[0], index_of(cols, x)])
    inv = np.linalg.pinv(correlation(g[np.ix_(ix, ix)]), hermitian=True)
    return {c: float(v) for c, v in zip(x, np.diag(inv))}
