"""OLS with robust errors over any number of specifications, two scans in total.

First scan: centred moments of every distinct column set. Second scan: the robust meat of every specification.
Without groups the driver solves one k x k system per specification (k = predictors), as Spark's own linear models
do. With groups, of which there may be any number, executors solve: coefficients of a group are joined back to its rows
for the second scan, and nothing comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_upper, f_uppers, normal_two_sided, normal_two_sideds, t_quantile, t_two_sided, t_two_sideds
from ..functions.scalars import vif_flag
from ..session import pin
from .gram import CLOSE, CONST, EXACT, condition_of, correlation, gram, index_of, rank_of, scaled_inverse, sum_partials, vif_values
from .moments import FLUSH, Moments, complete_sets, groups_of, matrix_rows, moments, of_row, total
from .stacks import Stack
from .standardize import complete_cases, zscore_complete

RESULT = (
    "spec string, outcome string, term string, beta double, se double, t double, p double, "
    "ci_low double, ci_high double, n long, k int, r2 double, adj_r2 double, f double, f_p double, vif double"
)


@dataclass(frozen=True)
class Spec:
    """One model: outcome on predictors. The constant is added."""

    name: str
    y: str
    x: tuple[str, ...]

    @property
    def cols(self) -> tuple[str, ...]:
        return (*self.x, self.y)


def specs(entries: Sequence[tuple[str, str, Sequence[str]]]) -> list[Spec]:
    return [Spec(name, y, tuple(x)) for name, y, x in entries]


def ols(
    df: DataFrame,
    models: Sequence[Spec],
    weight: str | None = None,
    cov: str = "HC1",
    dist: str = "t",
    by: str | None = None,
    shared_mask: bool = False,
    vif: bool = False,
) -> DataFrame:
    """Long coefficient table, one row per (group, spec, term). Runs its one or two scans when it is called.

    ``weight``: analytic weights; rows of weight 0 are left out, negative weights raise. ``cov``: HC1 or classic. ``dist``: t or normal.
    ``by``: fit every group of a column on its own, any number of them (null is a group). ``shared_mask``: use only
    rows complete in the columns of all models. Columns that depend on each other exactly share their effect
    (pseudo-inverse); a design so close to that that digits would be lost raises, or with ``by`` has null estimates.
    """
    if by:
        return _grouped(_usable(df, models, weight, shared_mask), models, weight, cov, dist, by, vif)
    return _table(df, models, weight, cov, dist, by, shared_mask, vif, None)


def _usable(df: DataFrame, models: Sequence[Spec], weight: str | None, shared_mask: bool) -> DataFrame:
    if shared_mask:
        df = complete_cases(df, sorted({c for m in models for c in m.cols}))
    if weight:
        bad = F.raise_error(F.lit("negative weight"))
        df = df.filter(F.when(F.col(weight) < 0, bad).otherwise(F.col(weight) > 0))
    return df


def _frames(models: Sequence[Spec]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(sorted(set(m.cols))) for m in models))


def _grouped(df: DataFrame, models: Sequence[Spec], weight: str | None, cov: str, dist: str, by: str, vif: bool) -> DataFrame:
    """All groups on executors: a row of moments per group, solved in batches, joined to the rows for the meats.

    A join by the group splits a group with very many rows, because nothing after it needs the group together.
    """
    models, frames = list(models), _frames(models)
    frame_at = [frames.index(tuple(sorted(set(m.cols)))) for m in models]
    kind = df.schema[by].dataType.simpleString()
    head = f"by {kind}, "
    found = moments(df, frames, weight, by).groupBy("by").agg(F.collect_list(F.struct("frame", "n", "sw", "mean", "s")).alias("held"))
    found = pin(found)

    def solved(held: list) -> list[tuple[np.ndarray, Solved]]:
        """For each model, which groups of the batch have a row for it, and their solutions."""
        rows = [{r["frame"]: r for r in own} for own in held]
        out = []
        for m, f in zip(models, frame_at):
            at = np.array([i for i, r in enumerate(rows) if f in r], int)
            out.append((at, Solved.of(m, frames[f], [of_row(rows[i][f]) for i in at.tolist()])))
        return out

    cols = sorted({c for m in models for c in m.cols})
    place = {c: i for i, c in enumerate(cols)}

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for m, (at, fit) in zip(models, solved(pdf["held"])):
                part = np.full((len(pdf), 2 * len(m.x) + 2), math.nan)
                if len(at):
                    part[at] = np.concatenate([fit.x_mean, fit.y_mean[:, None], fit.beta], axis=1)
                parts.append(part)
            yield pd.DataFrame({"by": pdf["by"], "fit": [row.tobytes() for row in np.concatenate(parts, axis=1)]})

    def meats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, tuple[int, np.ndarray]] = {}

        def rows() -> pd.DataFrame:
            sums = list(state.values())
            out = pd.DataFrame({"by": pd.Series([k[0] for k in state], dtype=object), "model": [k[1] for k in state], "n": [v[0] for v in sums], "sw": 0.0})
            return out.assign(g=[v[1].ravel() for v in sums])

        for pdf in batches:
            if not len(pdf):
                continue
            fit = pdf.pop("fit")
            x, w = pdf.iloc[:, 2:].to_numpy(dtype=float), pdf["weight"].to_numpy(dtype=float)
            fine = np.isfinite(x) & np.isfinite(w)[:, None]
            for key, at in pdf.groupby("by", dropna=False, sort=False).indices.items():
                key, values, lo = None if pd.isna(key) else key, np.frombuffer(fit.iloc[at[0]]), 0
                for i, m in enumerate(models):
                    k = len(m.x)
                    mean, y_mean, beta = values[lo : lo + k], values[lo + k], values[lo + k + 1 : lo + 2 * k + 2]
                    lo += 2 * k + 2
                    xs, y = [place[c] for c in m.x], place[m.y]
                    own = at[fine[at][:, [*xs, y]].all(axis=1)]
                    if math.isnan(beta[0]) or not len(own):
                        continue
                    z = np.column_stack([np.ones(len(own)), x[own][:, xs] - mean])
                    ze = z * (w[own] * (x[own, y] - y_mean - z @ beta))[:, None]
                    n, part = state.get((key, i), (0, 0.0))
                    state[key, i] = (n + len(z), part + ze.T @ ze)
            if len(state) >= FLUSH:
                yield rows()
                state.clear()
        if state:
            yield rows()

    if cov == "HC1":
        coefs = found.mapInPandas(packed, head + "fit binary").withColumnRenamed("by", "_by")
        data = matrix_rows(df, cols, weight, by)
        joined = data.join(coefs, data["by"].eqNullSafe(coefs["_by"])).drop("_by")
        partial = joined.mapInPandas(meats, head + "model int, n long, sw double, g array<double>")
        sums = sum_partials(partial, ["by", "model"]).groupBy("by").agg(F.collect_list(F.struct("model", "g")).alias("meat"))
        sums = sums.withColumnRenamed("by", "_by")
        found = found.join(sums, found["by"].eqNullSafe(sums["_by"]), "left").drop("_by")
    else:
        found = found.withColumn("meat", F.lit(None).cast("array<struct<model:int,g:array<double>>>"))

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            meat = [{r["model"]: r["g"] for r in (own if own is not None else [])} for own in pdf["meat"]]
            for i, (m, (at, fit)) in enumerate(zip(models, solved(pdf["held"]))):
                if len(at):
                    k = len(m.x) + 1
                    own = np.stack([np.array(meat[j].get(i, np.zeros(k * k)), float).reshape(k, k) for j in at.tolist()]) if cov == "HC1" else None
                    yield fit.table(pdf["by"].to_numpy()[at], own, dist, vif)

    return found.mapInPandas(finished, head + RESULT).withColumnRenamed("by", by)


def _table(df, models, weight, cov, dist, by, shared_mask, vif, cuts: Sequence[int] | None) -> DataFrame:
    """As :func:`ols`; with ``cuts``, ``by`` counts the cuts that a row meets and a group is all rows that meet one."""
    df = _usable(df, models, weight, shared_mask)
    fits = _fit(df, models, weight, by, cuts)
    if cov == "HC1":
        _robust(df, fits, weight, by, cuts is not None)
    name, kind = ("cutoff", "int") if cuts is not None else (by, df.schema[by].dataType.simpleString() if by else "")
    head = f"`{name}` {kind}, " if by else ""
    label = (lambda g: int(cuts[g - 1])) if cuts is not None else (lambda g: g)
    rows = [((label(f.group),) if by else ()) + r for f in fits for r in _rows(f, cov, dist, vif)]
    return df.sparkSession.createDataFrame(rows, head + RESULT)


@dataclass
class Solved:
    """One model solved for a stack of groups; NaN where a design is ill-conditioned."""

    model: Spec
    cols: tuple[str, ...]
    n: np.ndarray
    x_mean: np.ndarray
    y_mean: np.ndarray
    g: np.ndarray
    beta: np.ndarray
    inv: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, m: Spec, cols: tuple[str, ...], parts: Sequence[Moments]) -> Solved:
        k = len(m.x) + 1
        if not parts:
            none = np.zeros((0, k))
            return cls(m, cols, np.zeros(0, int), none[:, 1:], none[:, 0], np.zeros((0, 0, 0)), none, np.zeros((0, k, k)), np.zeros(0, int))
        stack = Stack.rows(parts)
        g = stack.matrix()
        ix, iy = index_of(cols, [CONST, *m.x]), index_of(cols, [m.y])[0]
        a = g[:, ix[:, None], ix[None, :]]
        d = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))
        values, vectors = np.linalg.eigh(a / (d[:, :, None] * d[:, None, :]))
        size = np.abs(values)
        largest = np.maximum(size.max(axis=1, keepdims=True), 1e-300)
        near = (size.min(axis=1) > EXACT * largest[:, 0]) & (size.min(axis=1) < CLOSE * largest[:, 0])
        sound = size > 1e-12 * largest
        inv = np.einsum("gij,gj,gkj->gik", vectors, np.where(sound, 1.0 / np.where(sound, values, 1.0), 0.0), vectors) / (d[:, :, None] * d[:, None, :])
        inv[near] = math.nan
        beta = np.einsum("gij,gj->gi", inv, g[:, ix, iy])
        return cls(m, cols, stack.n, stack.mean[:, ix[1:] - 1], stack.mean[:, iy - 1], g, beta, inv, sound.sum(axis=1))

    def table(self, keys: np.ndarray, meat: np.ndarray | None, dist: str, vif: bool) -> pd.DataFrame:
        """Result rows of all groups; ``meat`` for robust errors, None for classic ones."""
        ix, iy = index_of(self.cols, [CONST, *self.model.x]), index_of(self.cols, [self.model.y])[0]
        k, n, g = len(ix), self.n.astype(float), self.g
        gxx, gxy, sst = g[:, ix[:, None], ix[None, :]], g[:, ix, iy], g[:, iy, iy]
        with np.errstate(all="ignore"):
            ssr = np.maximum(sst - 2 * np.einsum("gi,gi->g", self.beta, gxy) + np.einsum("gi,gij,gj->g", self.beta, gxx, self.beta), 0.0)
            r2 = np.where(sst > 0, 1 - ssr / sst, math.nan)
            dof = n - self.rank
            free = np.where(dof > 0, dof, math.nan)
            adj = 1 - (1 - r2) * (n - 1) / free
            scale = n / free if meat is not None else ssr / free
            v = (self.inv @ meat @ self.inv if meat is not None else self.inv) * scale[:, None, None]
            back = np.broadcast_to(np.eye(k), v.shape).copy()
            back[:, 0, 1:] = -self.x_mean
            beta = np.einsum("gij,gj->gi", back, self.beta)
            beta[:, 0] += self.y_mean
            se = np.sqrt(np.maximum(np.diagonal(back @ v @ back.transpose(0, 2, 1), axis1=1, axis2=2), 0.0))
            t = np.where(se > 0, beta / se, math.nan)
            p = t_two_sideds(t, free[:, None]) if dist == "t" else normal_two_sideds(t)
            crit = np.array([t_quantile(0.975, x) if x > 0 else math.nan for x in dof.tolist()])[:, None] if dist == "t" else 1.959963984540054
            wald, wald_p = np.full(len(n), math.nan), np.full(len(n), math.nan)
            known = np.flatnonzero(np.isfinite(v).all(axis=(1, 2)) & (dof > 0))
            if k > 1 and len(known):
                inner = np.linalg.pinv(v[known][:, 1:, 1:], hermitian=True)
                wald[known] = np.einsum("gi,gij,gj->g", self.beta[known, 1:], inner, self.beta[known, 1:]) / (k - 1)
                wald_p[known] = f_uppers(wald[known], k - 1, dof[known])
        wide = lambda x: np.repeat(x, k)
        out = {"by": wide(keys), "spec": self.model.name, "outcome": self.model.y, "term": np.tile([CONST, *self.model.x], len(n))}
        out |= {"beta": beta.ravel(), "se": se.ravel(), "t": t.ravel(), "p": p.ravel(), "ci_low": (beta - crit * se).ravel(), "ci_high": (beta + crit * se).ravel()}
        out |= {"n": wide(self.n), "k": k, "r2": wide(r2), "adj_r2": wide(adj), "f": wide(wald), "f_p": wide(wald_p)}
        table = pd.DataFrame(out)
        if vif:
            values = [vif_values(x, self.cols, self.model.x) for x in g]
            table["vif"] = [v.get(term) for v in values for term in (CONST, *self.model.x)]
        else:
            table["vif"] = None
        numbers = [c for c in table.columns if c not in ("by", "spec", "outcome", "term", "n", "k")]
        # Missing numbers are null, not NaN.
        table[numbers] = table[numbers].astype(object).where(table[numbers].notna(), None)
        return table


@dataclass
class Fit:
    """A solved model; ``cols``, ``g`` and ``beta`` are centred at ``mean``."""

    model: Spec
    group: object
    cols: tuple[str, ...]
    mean: np.ndarray
    g: np.ndarray
    n: int
    beta: np.ndarray
    inv: np.ndarray
    meat: np.ndarray | None = None

    def uncentred(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the columns as they are, and the matrix that moves the constant there."""
        means = dict(zip(self.cols, self.mean))
        back = np.eye(len(self.beta))
        back[0, 1:] = [-means[c] for c in self.model.x]
        beta = back @ self.beta
        beta[0] += means[self.model.y]
        return beta, back


def _solve(m: Spec, group: object, cols: tuple[str, ...], found: Moments) -> Fit:
    """One model on the moments of its columns."""
    g = found.matrix()
    ix, iy = index_of(cols, [CONST, *m.x]), index_of(cols, [m.y])[0]
    a = g[np.ix_(ix, ix)]
    if EXACT < condition_of(a) < CLOSE:
        raise ValueError(f"model {m.name}: the design is ill-conditioned")
    inv = scaled_inverse(a)
    return Fit(m, group, cols, found.mean, g, found.n, inv @ g[ix, iy], inv)


def _fit(df: DataFrame, models: Sequence[Spec], weight: str | None = None, by: str | None = None, cuts: Sequence[int] | None = None) -> list[Fit]:
    """First scan: moments of each distinct column set, then one solve per model (and cut)."""
    frames = _frames(models)
    held: dict[tuple, Moments] = {}
    for r in moments(df, frames, weight, by).collect():
        held[r["by"], r["frame"]] = of_row(r)
    groups: list = sorted({g for g, _ in held}, key=lambda g: (g is None, g)) if cuts is None else list(range(1, len(cuts) + 1))
    fits = []
    for m in models:
        frame = frames.index(tuple(sorted(set(m.cols))))
        for group in groups:
            found = held.get((group, frame)) if cuts is None else total(v for (g, i), v in held.items() if i == frame and g >= group)
            if found is not None:
                fits.append(_solve(m, group, frames[frame], found))
    return fits


def _robust(df: DataFrame, fits: list[Fit], weight: str | None, by: str | None, nested: bool) -> None:
    """Second scan: sum of (w e)^2 x x' for every fit, filled in place. ``nested``: a row counts in all groups up to its own."""
    cols = sorted({c for f in fits for c in f.cols})
    if not fits:
        return
    place = {c: i for i, c in enumerate(cols)}
    frames = list(dict.fromkeys(f.cols for f in fits))
    where = [np.array([place[c] for c in f], int) for f in frames]
    plan: dict = {}
    for i, f in enumerate(fits):
        means = dict(zip(f.cols, f.mean))
        x, y = [place[c] for c in f.model.x], place[f.model.y]
        plan.setdefault((f.group if by else 0, frames.index(f.cols)), []).append((i, x, np.array([means[c] for c in f.model.x]), y, means[f.model.y], f.beta))

    def meats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, tuple[int, np.ndarray]] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            for key, data, weights, fine in groups_of(pdf):
                for mask, sets in complete_sets(fine, where):
                    rows, w = data[mask], weights[mask]
                    own = [g for g in range(1, int(key) + 1)] if nested else [key]
                    for i, x, mean, y, y_mean, beta in (f for g in own for s in sets for f in plan.get((g, s), ())):
                        z = np.column_stack([np.ones(len(rows)), rows[:, x] - mean])
                        ze = z * (w * (rows[:, y] - y_mean - z @ beta))[:, None]
                        n, part = state.get(i, (0, 0.0))
                        state[i] = (n + len(z), part + ze.T @ ze)
        if state:
            sums = list(state.values())
            yield pd.DataFrame({"fit": list(state), "n": [v[0] for v in sums], "sw": 0.0, "g": [v[1].ravel() for v in sums]})

    partial = matrix_rows(df, cols, weight, by).mapInPandas(meats, "fit int, n long, sw double, g array<double>")
    for r in sum_partials(partial, ["fit"]).collect():
        k = len(fits[r["fit"]].beta)
        fits[r["fit"]].meat = np.array(r["g"]).reshape(k, k)


def _rows(f: Fit, cov: str, dist: str, vif: bool) -> list[tuple]:
    n, k = f.n, len(f.beta)
    ix, iy = index_of(f.cols, [CONST, *f.model.x]), index_of(f.cols, [f.model.y])[0]
    gxx, gxy, gyy = f.g[np.ix_(ix, ix)], f.g[ix, iy], f.g[iy, iy]
    sw = f.g[0, 0]
    ssr = max(float(gyy - 2 * f.beta @ gxy + f.beta @ gxx @ f.beta), 0.0)
    sst = float(gyy - f.g[0, iy] ** 2 / sw)
    r2 = 1 - ssr / sst if sst > 0 else math.nan
    dof = n - rank_of(gxx)
    adj = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else math.nan
    if dof <= 0:
        v = np.full((k, k), math.nan)
    elif cov == "HC1":
        v = n / dof * f.inv @ f.meat @ f.inv
    else:
        v = f.inv * (ssr / dof) * 1.0
    beta, back = f.uncentred()
    se = np.sqrt(np.maximum(np.diag(back @ v @ back.T), 0.0))
    crit = t_quantile(0.975, dof) if dist == "t" else 1.959963984540054
    wald, wald_p = math.nan, math.nan
    if k > 1 and dof > 0:
        wald = float(f.beta[1:] @ np.linalg.pinv(v[1:, 1:], hermitian=True) @ f.beta[1:] / (k - 1))
        wald_p = f_upper(wald, k - 1, dof)
    vifs = vif_values(f.g, f.cols, f.model.x) if vif else {}
    out = []
    for j, term in enumerate([CONST, *f.model.x]):
        b, s = float(beta[j]), float(se[j])
        t = b / s if s > 0 else math.nan
        p = t_two_sided(t, dof) if dist == "t" else normal_two_sided(t)
        out.append(
            (f.model.name, f.model.y, term, b, s, _num(t), _num(p), _num(b - crit * s), _num(b + crit * s),
             int(n), int(k), _num(r2), _num(adj), _num(wald), _num(wald_p), vifs.get(term))
        )
    return out


def _num(x: float) -> float | None:
    return None if math.isnan(x) else float(x)


def fit_stats(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per model: N, R2, adjusted R2, robust Wald F."""
    return fits.select(*by, "spec", "outcome", "n", "k", "r2", "adj_r2", "f", "f_p").distinct()


def residuals(df: DataFrame, model: Spec, fitted: str = "fitted", resid: str = "resid") -> DataFrame:
    """Complete rows with fitted values and residuals; the coefficients enter as literals."""
    fits = _fit(df, [model])
    rows = complete_cases(df, model.cols)
    # Without a complete row there is nothing to fit and no row to show.
    beta = fits[0].uncentred()[0] if fits else np.zeros(len(model.x) + 1)
    fit = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], model.x):
        fit = fit + F.lit(float(b)) * F.col(c)
    return rows.withColumn(fitted, fit).withColumn(resid, F.col(model.y) - F.col(fitted))


def ols_multi(df: DataFrame, outcomes: Sequence[str], x: Sequence[str], **options) -> DataFrame:
    """Several outcomes on the same predictors."""
    return ols(df, [Spec(y, y, tuple(x)) for y in outcomes], **options)


def ols_grid(
    df: DataFrame, outcomes: Sequence[str], targets: Sequence[str], base: Sequence[str], extra: Sequence[str] = (), **options
) -> DataFrame:
    """Every outcome x target, with and without the extra block of predictors."""
    models = []
    for y in outcomes:
        for t in targets:
            models.append(Spec(f"{y}|{t}|base", y, (t, *base)))
            if extra:
                models.append(Spec(f"{y}|{t}|extended", y, (t, *base, *extra)))
    return ols(df, models, **options)


def ols_standardized(df: DataFrame, y: str, x: Sequence[str], target: str | None = None, name: str = "std") -> DataFrame:
    """Standardise outcome and predictors on the complete cases, then HC1 OLS; optionally one term."""
    names = {c: f"{c}__z" for c in [y, *x]}
    z = zscore_complete(df, [y, *x], ddof=0, names=names)
    fits = ols(z, [Spec(name, names[y], tuple(names[c] for c in x))])
    fits = fits.withColumns(
        {"outcome": F.regexp_replace("outcome", "__z$", ""), "term": F.regexp_replace("term", "__z$", "")}
    )
    return fits if target is None else fits.filter(F.col("term") == target)


def ols_thresholds(
    df: DataFrame, models: Sequence[Spec], col: str, cuts: Sequence[int], weight: str | None = None, cov: str = "HC1", dist: str = "t",
    shared_mask: bool = False, vif: bool = False,
) -> DataFrame:
    """Models on the rows with ``col`` >= cut for every cut (column ``cutoff``).

    A row belongs to the bucket of its highest cut; moments of buckets add up to those of the cuts, so no row fans out.
    """
    cuts = sorted({int(c) for c in cuts})
    met = "_cuts_met"
    counted = sum((F.when(F.col(col) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    bucketed = df.withColumn(met, counted.cast("int")).filter(F.col(met) > 0)
    return _table(bucketed, models, weight, cov, dist, met, shared_mask, vif, cuts)


def pick_terms(fits: DataFrame, picks: Sequence[tuple[str, str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Selected (spec, term, label) rows in the given order."""
    items = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(i + 1).alias("path_order"), F.lit(l).alias("path"))
                      for i, (s, t, l) in enumerate(picks)])
    hit = F.filter(items, lambda i: (i["s"] == F.col("spec")) & (i["t"] == F.col("term")))
    rows = fits.withColumn("_pick", F.explode(hit))
    return rows.select(*by, "_pick.path_order", "_pick.path", "spec", "term", "beta", "se", "p", "n", "r2")


def vif(df: DataFrame, x: Sequence[str], spec: str = "all") -> DataFrame:
    """Variance inflation of every predictor, with tolerance and flag."""
    row = moments(df, [tuple(x)]).first()
    values = vif_values(of_row(row).matrix(), list(x), list(x)) if row else {}
    out = df.sparkSession.createDataFrame([(spec, c, v, 1.0 / v) for c, v in values.items()],
                                          "spec string, variable string, vif double, tolerance double")
    return out.withColumn("flag", vif_flag(F.col("vif")))


def single_factor(df: DataFrame, cols: Sequence[str], threshold: float = 50.0) -> DataFrame:
    """Share of variance of the first unrotated factor of the correlation matrix."""
    k = len(cols) + 1
    row = gram(zscore_complete(df, list(cols), names={c: c for c in cols}), list(cols)).first()
    if row is None:
        raise ValueError("no row is complete in " + ", ".join(cols))
    values = np.linalg.eigvalsh(correlation(np.array(row["g"]).reshape(k, k)))
    pct = float(values[-1] / values.sum() * 100)
    return df.sparkSession.createDataFrame(
        [(", ".join(cols), int(row["n"]), pct, threshold, pct < threshold)],
        "variables string, n long, first_factor_pct double, threshold_pct double, below_threshold boolean",
    )
