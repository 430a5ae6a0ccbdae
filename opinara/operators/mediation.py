"""Indirect effects as functions of a stack of centred moments.

Each statistic names its outputs and evaluates them for a whole stack at once,
so the full sample, bootstrap replicates and leave-one-out samples all use the
same code. With observed variables and a recursive system the path coefficients
are equation-by-equation least squares on one shared sample. Moments are
centred, so means that are large against the spread cost no digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import solve
from .moments import moments
from .stacks import Stack, evaluate_moments


def _coef(g: np.ndarray, cols: Sequence[str], y: str, x: Sequence[str], want: Sequence[str]) -> np.ndarray:
    beta = solve(g, cols, y, x)
    pos = {c: i + 1 for i, c in enumerate(x)}
    return beta[..., [pos[c] for c in want]]


@dataclass(frozen=True)
class Parallel:
    """x -> each mediator -> y: a_i * b per predictor and channel, totals and their difference."""

    x: tuple[str, ...]
    mediators: tuple[str, ...]
    y: str
    controls: tuple[str, ...] = ()
    contrasts: bool = True

    def cols(self) -> list[str]:
        return [*self.x, *self.controls, *self.mediators, self.y]

    def names(self) -> list[str]:
        out = [f"ind|{m}|{x}" for m in self.mediators for x in self.x]
        if self.contrasts:
            out += [f"b|{m}" for m in self.mediators] + [f"total_abs|{m}" for m in self.mediators]
            if len(self.mediators) == 2:
                out.append("diff_abs")
        return out

    def evaluate(self, m: Stack) -> np.ndarray:
        g, cols, base = m.matrix(), self.cols(), [*self.x, *self.controls]
        b = _coef(g, cols, self.y, [*self.x, *self.mediators, *self.controls], self.mediators)
        ind = [_coef(g, cols, m, base, self.x) * b[..., [i]] for i, m in enumerate(self.mediators)]
        parts = list(ind)
        if self.contrasts:
            totals = [np.abs(e).sum(axis=-1, keepdims=True) for e in ind]
            parts += [b, *totals]
            if len(totals) == 2:
                parts.append(totals[0] - totals[1])
        return np.concatenate(parts, axis=-1)


@dataclass(frozen=True)
class Serial:
    """x -> first -> second -> y: a_i * d * b, the links and the total."""

    x: tuple[str, ...]
    chain: tuple[str, str]
    y: str
    controls: tuple[str, ...] = ()

    def cols(self) -> list[str]:
        return [*self.x, *self.controls, *self.chain, self.y]

    def names(self) -> list[str]:
        return [f"serial|{x}" for x in self.x] + ["d", "b_first", "b_second", "serial_total"]

    def evaluate(self, m: Stack) -> np.ndarray:
        g, cols, base = m.matrix(), self.cols(), [*self.x, *self.controls]
        first, second = self.chain
        a = _coef(g, cols, first, base, self.x)
        d = _coef(g, cols, second, [*base, first], [first])
        b = _coef(g, cols, self.y, [*base, first, second], [first, second])
        ind = a * d * b[..., [1]]
        return np.concatenate([ind, d, b, ind.sum(axis=-1, keepdims=True)], axis=-1)


@dataclass(frozen=True)
class Components:
    """Several components of one mediator: a_ic * b_c per component, and their total per predictor."""

    x: tuple[str, ...]
    components: tuple[str, ...]
    y: str
    controls: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()

    def cols(self) -> list[str]:
        return [*self.x, *self.controls, *self.covariates, *self.components, self.y]

    def names(self) -> list[str]:
        return [f"ind|{c}|{x}" for c in self.components for x in self.x] + [f"ind_total|{x}" for x in self.x]

    def evaluate(self, m: Stack) -> np.ndarray:
        g, cols, base = m.matrix(), self.cols(), [*self.x, *self.controls]
        full = [*self.x, *self.covariates, *self.components, *self.controls]
        b = _coef(g, cols, self.y, full, self.components)
        ind = [_coef(g, cols, c, base, self.x) * b[..., [i]] for i, c in enumerate(self.components)]
        return np.concatenate([*ind, sum(ind)], axis=-1)


@dataclass(frozen=True)
class Mean:
    """Column means."""

    of: tuple[str, ...]

    def cols(self) -> list[str]:
        return list(self.of)

    def names(self) -> list[str]:
        return [f"mean|{c}" for c in self.of]

    def evaluate(self, m: Stack) -> np.ndarray:
        return m.mean


@dataclass(frozen=True)
class Slope:
    """Coefficients of y on x."""

    x: tuple[str, ...]
    y: str

    def cols(self) -> list[str]:
        return [*self.x, self.y]

    def names(self) -> list[str]:
        return [f"beta|{c}" for c in self.x]

    def evaluate(self, m: Stack) -> np.ndarray:
        return solve(m.matrix(), self.cols(), self.y, list(self.x))[..., 1:]


def estimate(df: DataFrame, stat, by: str | None = None) -> DataFrame:
    """Full-sample value of every output of a statistic over its complete rows, per group."""
    found = evaluate_moments(moments(df, [stat.cols()], by=by), stat, by or "_all")
    return found if by else found.drop("_all")


def indirect_parallel(
    df: DataFrame, x: Sequence[str], mediators: Sequence[str], y: str, controls: Sequence[str] = (), contrasts: bool = False
) -> DataFrame:
    return estimate(df, Parallel(tuple(x), tuple(mediators), y, tuple(controls), contrasts))


def indirect_serial(
    df: DataFrame, x: Sequence[str], chain: tuple[str, str], y: str, controls: Sequence[str] = ()
) -> DataFrame:
    return estimate(df, Serial(tuple(x), tuple(chain), y, tuple(controls)))


def indirect_components(
    df: DataFrame,
    x: Sequence[str],
    components: Sequence[str],
    y: str,
    controls: Sequence[str] = (),
    covariates: Sequence[str] = (),
) -> DataFrame:
    return estimate(df, Components(tuple(x), tuple(components), y, tuple(controls), tuple(covariates)))


def indirect_contrasts(ind: DataFrame) -> DataFrame:
    """Sum of absolute indirect effects per channel, and the difference of the first two channels.

    Input: rows of :func:`indirect_parallel`.
    """
    parts = F.split("stat", r"\|")
    rows = ind.filter(parts[0] == "ind").select(parts[1].alias("channel"), F.abs("value").alias("v"))
    totals = rows.groupBy("channel").agg(F.sum("v").alias("value"))
    two = totals.agg(
        F.min_by("value", "channel").alias("a"), F.max_by("value", "channel").alias("b"), F.count(F.lit(1)).alias("n")
    )
    diff = two.filter(F.col("n") == 2).select(F.lit("diff_abs").alias("stat"), (F.col("a") - F.col("b")).alias("value"))
    return totals.select(F.concat(F.lit("total_abs|"), "channel").alias("stat"), "value").unionByName(diff)
