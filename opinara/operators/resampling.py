"""Bootstrap and jackknife over centred moments, with intervals.

``exact`` resamples n out of n: each task makes the counts of its own rows by splitting a multinomial
(:mod:`.splitting`), so only moments are shuffled. ``poisson`` gives every row an independent Poisson(1) count, known
by its key: no dense row index is needed, and replicate sizes vary around n. ``hashed`` is n out of n by one hash per
draw, counted per (row, replicate) and joined to the rows: plain SQL can repeat it, at the price of a shuffle of B * n
draws.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import normal_cdf, normal_quantile, normal_two_sided
from ..functions.hashing import MOD, hash_np, poisson_np
from .mediation import estimate
from .moments import moments, of_row
from .rows import dense_index
from .splitting import Splitter
from .stacks import ROW_BLOCK, Stack, evaluate_moments, replicate_moments, replicate_values, without_each
from .standardize import complete_cases

DRAW_CHUNK = 1 << 17


def hashed_weights(spark, n: int, reps: int, seed: int) -> DataFrame:
    """(idx, rep, w): how often row idx is drawn in replicate rep; undrawn rows are absent.

    Tasks expand (replicate, chunk) pairs into draws and count them before the shuffle.
    """
    chunks = -(-n // DRAW_CHUNK)
    parts = min(reps * chunks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = spark.range(0, reps * chunks, 1, parts).mapInPandas(_draw_task(n, chunks, seed), "rep int, idx long, c long")
    return counted.repartition("idx").groupBy("idx", "rep").agg(F.sum("c").cast("double").alias("w"))


def _draw_task(n: int, chunks: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rep, chunk in zip(*np.divmod(pdf["id"].to_numpy(), chunks)):
                draw = np.arange(chunk * DRAW_CHUNK, min(n, (chunk + 1) * DRAW_CHUNK), dtype=np.int64)
                high, low = hash_np(seed, rep, 2 * draw), hash_np(seed, rep, 2 * draw + 1)
                idx, c = np.unique((high * MOD + low) % n, return_counts=True)
                yield pd.DataFrame({"rep": rep, "idx": idx, "c": c})

    return run


def _indexed(df: DataFrame, cols: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    return dense_index(complete_cases(df, list(cols)).select(*dict.fromkeys([*order, *cols])), list(order), out)


def hashed_moments(df: DataFrame, cols: Sequence[str], order: Sequence[str], reps: int, seed: int) -> DataFrame:
    """Moments (``by`` is the replicate) of the n-out-of-n bootstrap over the complete cases, drawn by hashes."""
    rows = _indexed(df, cols, order, "idx")
    # Spark takes the size of the draws for that of the few (replicate, chunk) pairs and would send them all to the
    # driver for a broadcast; both sides stay partitioned by row instead.
    weighted = hashed_weights(df.sparkSession, rows.count(), reps, seed).join(rows.hint("merge"), "idx")
    return moments(weighted.select("rep", "w", *cols), [list(cols)], weight="w", by="rep")


def split_moments(df: DataFrame, cols: Sequence[str], order: Sequence[str], reps: int, seed: int) -> DataFrame:
    """Stacks of the n-out-of-n bootstrap over the complete cases, counts made in place by splitting."""
    rows = _indexed(df, cols, order, "_id").select("_id", *cols)
    n = rows.count()
    return replicate_moments(rows, cols, reps, lambda: Splitter(n, seed))


def poisson_moments(df: DataFrame, cols: Sequence[str], order: Sequence[str], reps: int, seed: int) -> DataFrame:
    """Stacks with independent Poisson(1) row counts, in one pass.

    A row is known by a single integer column itself, else by the hash of all ``order`` columns; null keys raise.
    """
    whole = len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.IntegralType)
    key = F.col(order[0]).cast("long") if whole else F.xxhash64(*order)
    null = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in order])
    key = F.when(null, F.raise_error(F.lit("null in the columns that identify the rows"))).otherwise(key)
    rows = complete_cases(df, list(cols)).select(key.alias("_id"), *cols)

    def weights():
        def draw(reps: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield np.arange(len(ids)), poisson_np(hash_np(seed, reps[:, None], ids[None, :]))

        return draw

    return replicate_moments(rows, cols, reps, weights)


def bootstrap(
    df: DataFrame,
    stat,
    reps: int,
    seed: int,
    order: Sequence[str],
    method: str = "exact",
) -> DataFrame:
    """Replicate values (rep, stat, value). ``order``: columns that identify and order the rows."""
    if method == "exact":
        return replicate_values(split_moments(df, stat.cols(), order, reps, seed), stat)
    if method == "poisson":
        return replicate_values(poisson_moments(df, stat.cols(), order, reps, seed), stat)
    if method == "hashed":
        return evaluate_moments(hashed_moments(df, stat.cols(), order, reps, seed), stat, "rep")
    raise ValueError("method must be exact, poisson or hashed")


def percentile_ci(draws: DataFrame, level: float = 0.95, by: Sequence[str] = ("stat",)) -> DataFrame:
    """Percentile interval per statistic. A group holds one value per replicate, so its size is a parameter."""
    tail = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return draws.groupBy(*by).agg(q.alias("q"), F.count("value").alias("reps")).select(
        *by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "reps"
    )


def boot_p(draws: DataFrame, by: Sequence[str] = ("stat",)) -> DataFrame:
    """Two-sided bootstrap p-value from the shares of draws on either side of zero."""
    n = F.count("value") + 1
    low = (F.count_if(F.col("value") <= 0) + 1) / n
    high = (F.count_if(F.col("value") >= 0) + 1) / n
    return draws.groupBy(*by).agg(F.least(F.lit(1.0), 2.0 * F.least(low, high)).alias("p_boot"))


def boot_se(draws: DataFrame, by: Sequence[str] = ("stat",)) -> DataFrame:
    return draws.groupBy(*by).agg(F.stddev_samp("value").alias("boot_se"), F.avg("value").alias("boot_mean"))


def normal_p(estimates: DataFrame, se: DataFrame) -> DataFrame:
    """Estimate, bootstrap standard error, z and its normal p-value (a diagnostic)."""
    rows = estimates.join(se, "stat")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = pdf["value"] / pdf["boot_se"].where(pdf["boot_se"] > 0)
            p = [normal_two_sided(v) if v == v else None for v in z]
            yield pd.DataFrame(
                {"stat": pdf["stat"], "estimate": pdf["value"], "boot_se": pdf["boot_se"], "z_normal": z, "p_normal": p}
            )

    return rows.select("stat", "value", "boot_se").mapInPandas(
        run, "stat string, estimate double, boot_se double, z_normal double, p_normal double"
    )


def jackknife_moments(df: DataFrame, stat) -> DataFrame:
    """Per statistic: n and the first three power sums of (leave-one-out value - full value).

    The full moments (k x k) go to the tasks; each row is taken out of them by a rank-one term, so there is one more
    pass and no refit. Complete cases only; fewer than two of them have no leave-one-out value and give no row.
    """
    cols = stat.cols()
    row = moments(df, [cols]).first()
    whole = of_row(row) if row else None
    schema = "stat string, n long, s1 double, s2 double, s3 double"
    parts = complete_cases(df, cols).select(*cols).mapInPandas(_jackknife_task(stat, whole), schema)
    return parts.groupBy("stat").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3")])


def _jackknife_task(stat, whole):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if whole is None or whole.n < 2:
            return
        cols, names = stat.cols(), stat.names()
        full = stat.evaluate(Stack.rows([whole]))[0]
        n, sums = 0, np.zeros((3, len(names)))
        for pdf in batches:
            for lo in range(0, len(pdf), ROW_BLOCK):
                x = pdf.iloc[lo : lo + ROW_BLOCK][cols].to_numpy(dtype=float)
                d = stat.evaluate(without_each(whole, x)) - full
                n += len(x)
                sums += np.stack([d.sum(axis=0), (d**2).sum(axis=0), (d**3).sum(axis=0)])
        if n:
            yield pd.DataFrame({"stat": names, "n": n, "s1": sums[0], "s2": sums[1], "s3": sums[2]})

    return run


def acceleration(moments: DataFrame) -> DataFrame:
    """BCa acceleration per statistic from the jackknife power sums."""
    n, m = F.col("n"), F.col("s1") / F.col("n")
    c2 = F.col("s2") - n * m * m
    # Third central moment of the deviations; the sign flips because BCa uses mean minus value.
    c3 = -(F.col("s3") - 3 * m * F.col("s2") + 2 * n * m * m * m)
    return moments.select("stat", "n", F.coalesce(F.try_divide(c3, 6 * F.pow(c2, F.lit(1.5))), F.lit(0.0)).alias("accel"))


def bca_ci(draws: DataFrame, point: DataFrame, moments: DataFrame, level: float = 0.95) -> DataFrame:
    """Bias-corrected accelerated interval per statistic; ties with the point estimate count half."""
    info = point.select("stat", F.col("value").alias("estimate")).join(acceleration(moments), "stat")
    rows = draws.join(info, "stat").select("stat", "value", "estimate", "accel")
    schema = "stat string, estimate double, z0 double, accel double, ci_low double, ci_high double, reps long"
    # One group is one statistic with one value per replicate.
    return rows.groupBy("stat").applyInPandas(_bca_task(level), schema)


def _bca_task(level: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].to_numpy()
        theta, a = float(pdf["estimate"].iloc[0]), float(pdf["accel"].iloc[0])
        b = len(v)
        share = ((v < theta).sum() + 0.5 * (v == theta).sum()) / b
        z0 = normal_quantile(min(max(share, 0.5 / b), 1 - 0.5 / b))
        ends = []
        for p in ((1 - level) / 2, (1 + level) / 2):
            z = z0 + normal_quantile(p)
            ends.append(float(np.quantile(v, normal_cdf(z0 + z / (1 - a * z)))))
        return pd.DataFrame([(pdf["stat"].iloc[0], theta, z0, a, ends[0], ends[1], b)],
                            columns=["stat", "estimate", "z0", "accel", "ci_low", "ci_high", "reps"])

    return run


def bootstrap_summary(
    df: DataFrame, stat, reps: int, seed: int, order: Sequence[str], method: str = "exact", level: float = 0.95
) -> DataFrame:
    """Estimate, percentile interval, bootstrap p and standard error per statistic."""
    draws = bootstrap(df, stat, reps, seed, order, method)
    point = estimate(df, stat).withColumnRenamed("value", "estimate")
    return (
        point.join(percentile_ci(draws, level), "stat").join(boot_p(draws), "stat").join(boot_se(draws), "stat")
    )
