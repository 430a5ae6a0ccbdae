"""Product table to mediation results: models, indirect effects, joint tests, sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import joint_p, log_plus, stars, verdict
from ..operators.gram import CONST
from ..operators.mediation import Components, Parallel, estimate
from ..operators.multiple_testing import fdr, fdr_bh
from ..operators.regression import Spec, ols, ols_thresholds, pick_terms
from ..operators.resampling import bca_ci, boot_p, boot_se, bootstrap, jackknife_moments, normal_p, percentile_ci
from ..operators.rows import stack_rows
from ..operators.standardize import zscore
from ..session import pin
from ..sources.contracts import RidingChecks, assert_unique, require_columns


@dataclass(frozen=True)
class Roles:
    """Which standardised columns play which part."""

    x: tuple[str, ...]
    affective: str
    functional: str
    y: str
    controls: tuple[str, ...]

    @property
    def base(self) -> tuple[str, ...]:
        return (*self.x, *self.controls)

    @property
    def full(self) -> tuple[str, ...]:
        return (*self.x, self.affective, self.functional, *self.controls)

    def parallel(self, contrasts: bool = True) -> Parallel:
        return Parallel(self.x, (self.affective, self.functional), self.y, self.controls, contrasts)


def prepare(
    master: DataFrame,
    cols: Sequence[str],
    key: str = "product_id",
    price: str = "price",
    reviews: str = "n_reviews_total",
    ddof: int = 1,
    present: Sequence[str] = (),
) -> DataFrame:
    """Contracts, logs and full-sample z-scores (suffix ``_s``); pinned, because every model scans it.

    Subsamples later keep these z-scores. Rows without a z-score of one of ``present`` count in the statistics but
    are not written.
    """
    require_columns(master, [key, price, reviews], "product master")
    # The checks of rows ride along with the one pass that writes the master; only the key column is read again.
    checks = RidingChecks("master").positive(reviews)
    master = pin(checks.attach(master))
    checks.verify()
    assert_unique(master, [key])
    logged = master.withColumns(
        {"lnprice": log_plus(F.col(price)), "lnreviews": log_plus(F.col(reviews).cast("double"))}
    )
    z = zscore(logged, list(cols), ddof=ddof, on_constant="raise", names={c: f"{c}_s" for c in cols})
    return pin(z.dropna(subset=[f"{c}_s" for c in present]) if present else z)


def main_specs(r: Roles) -> list[Spec]:
    """Affective, functional, total and full outcome models."""
    return [
        Spec("ME", r.affective, r.base),
        Spec("MF", r.functional, r.base),
        Spec("Y_total", r.y, r.base),
        Spec("Y_full", r.y, r.full),
    ]


def main_models(data: DataFrame, r: Roles, **options) -> DataFrame:
    return ols(data, main_specs(r), **options)


def outcome_variants(data: DataFrame, r: Roles, outcomes: Sequence[str]) -> DataFrame:
    return ols(data, [Spec(y, y, r.full) for y in outcomes])


def decomposition_pvalues(data: DataFrame, r: Roles, mediators: Sequence[str]) -> DataFrame:
    """All dimension mediators in one model, normal p-values, BH-adjusted, with stars."""
    fit = ols(data, [Spec("decomposition", r.y, (*r.x, *mediators, *r.controls))], dist="normal")
    rows = fit.filter(F.col("term").isin(*mediators)).select(F.col("term").alias("mediator"), "beta", "se", "t", "p")
    adj = fdr_bh(pin(rows), "p", out="p_fdr_bh")
    return adj.withColumns(
        {
            "sig_05": F.col("p_fdr_bh") <= 0.05,
            "sig_10": F.col("p_fdr_bh") <= 0.10,
            "stars_fdr": stars(F.col("p_fdr_bh"), none="ns"),
        }
    )


def model_specs(data: DataFrame, r: Roles, focal: Mapping[str, Sequence[str]]) -> DataFrame:
    """Named specifications that swap the functional measure(s); focal coefficients with VIFs."""
    specs = [Spec(name, r.y, (*r.x, r.affective, *cols, *r.controls)) for name, cols in focal.items()]
    fits = ols(data, specs, vif=True)
    keep = F.lit(False)
    for name, cols in focal.items():
        keep = keep | ((F.col("spec") == name) & F.col("term").isin(r.affective, *cols))
    worst = fits.filter(F.col("term") != CONST).groupBy("spec").agg(F.max("vif").alias("max_vif"))
    return fits.filter(keep).join(worst, "spec")


def a_paths(data: DataFrame, r: Roles, mediators: Sequence[str]) -> DataFrame:
    fits = ols(data, [Spec(m, m, r.base) for m in mediators])
    return fits.filter(F.col("term").isin(*r.x)).select(
        F.col("outcome").alias("mediator"), F.col("term").alias("x"), "beta", "se", "t", "p", "n", "r2", "adj_r2"
    )


def mediation_summary(
    data: DataFrame, stat, reps: int, seed: int, order: Sequence[str], method: str = "exact", bca: bool = True
) -> DataFrame:
    """Estimate, bootstrap se, normal z and p, percentile and BCa intervals, two-sided bootstrap p."""
    draws = pin(bootstrap(data, stat, reps, seed, order, method))
    point = estimate(data, stat)
    out = normal_p(point, boot_se(draws)).join(
        percentile_ci(draws).withColumnsRenamed({"ci_low": "pct_low", "ci_high": "pct_high"}), "stat"
    )
    out = out.join(boot_p(draws), "stat")
    if bca:
        ci = bca_ci(draws, point, jackknife_moments(data, stat))
        out = out.join(ci.select("stat", "z0", "accel", F.col("ci_low").alias("bca_low"), F.col("ci_high").alias("bca_high")), "stat")
    return out


def component_summary(
    data: DataFrame, r: Roles, components: Sequence[str], reps: int, seed: int, order: Sequence[str], method: str = "exact"
) -> DataFrame:
    """Indirect effects split over several functional components, plus their total."""
    stat = Components(r.x, tuple(components), r.y, r.controls, (r.affective,))
    return mediation_summary(data, stat, reps, seed, order, method, bca=False)


def joint_table(data: DataFrame, r: Roles, reps: int, seed: int, order: Sequence[str], method: str = "exact") -> DataFrame:
    """One row per predictor and channel: indirect effect, intervals, path p-values, joint p, BH, BY, verdict."""
    effects = mediation_summary(data, r.parallel(contrasts=False), reps, seed, order, method)
    parts = F.split("stat", r"\|")
    effects = effects.withColumns({"channel": parts[1], "x": parts[2]})
    fits = main_models(data, r)
    a = fits.filter(F.col("spec").isin("ME", "MF") & F.col("term").isin(*r.x)).select(
        F.col("outcome").alias("channel"), F.col("term").alias("x"), F.col("beta").alias("a"), F.col("se").alias("a_se"), F.col("p").alias("p_a")
    )
    b = fits.filter((F.col("spec") == "Y_full") & F.col("term").isin(r.affective, r.functional)).select(
        F.col("term").alias("channel"), F.col("beta").alias("b"), F.col("se").alias("b_se"), F.col("p").alias("p_b")
    )
    rows = effects.join(a, ["channel", "x"]).join(b, "channel").withColumn("p_joint", joint_p(F.col("p_a"), F.col("p_b")))
    rows = pin(rows)
    rows = fdr(rows, "p_joint")
    rows = rows.withColumn("bh_significant", F.col("p_bh") <= 0.05)
    return rows.withColumn(
        "result", verdict(F.col("bh_significant"), "Survives BH-FDR (adjusted p < 0.05)", "Does not survive BH-FDR")
    )


def core_picks(r: Roles, x_affective: str, x_functional: str) -> list[tuple[str, str, str]]:
    return [
        ("ME", x_affective, f"{x_affective} -> affective"),
        ("MF", x_functional, f"{x_functional} -> functional"),
        ("Y_full", r.affective, "affective -> outcome"),
        ("Y_full", r.functional, "functional -> outcome"),
    ]


def core_paths(data: DataFrame, r: Roles, x_affective: str, x_functional: str) -> DataFrame:
    """The four named coefficients of the main models, with stars."""
    rows = pick_terms(main_models(data, r), core_picks(r, x_affective, x_functional))
    return rows.withColumn("stars", stars(F.col("p")))


def sensitivity(
    data: DataFrame,
    r: Roles,
    x_affective: str,
    x_functional: str,
    volume: str,
    cuts: Sequence[int],
    weight: str | None = None,
) -> DataFrame:
    """Core paths on volume subsamples and with volume weights: one row per specification and path."""
    picks = core_picks(r, x_affective, x_functional) + [
        ("Y_full", x_affective, f"{x_affective} direct -> outcome"),
        ("Y_full", x_functional, f"{x_functional} direct -> outcome"),
    ]
    fits = ols_thresholds(data, main_specs(r), volume, cuts)
    parts = [
        pick_terms(fits, picks, by=["cutoff"]).withColumns(
            {"weighted": F.lit(0), "specification": F.concat(F.lit("reviews_ge"), F.col("cutoff").cast("string"))}
        )
    ]
    if weight:
        w = ols(data, main_specs(r), weight=weight)
        parts.append(
            pick_terms(w, picks).withColumns(
                {"cutoff": F.lit(0), "weighted": F.lit(1), "specification": F.lit("review_weighted")}
            )
        )
    return stack_rows(parts).withColumnRenamed("spec", "model")


def volume_summary(
    data: DataFrame, r: Roles, x_affective: str, x_functional: str, volume: str, cuts: Sequence[int], weight: str
) -> DataFrame:
    """Core paths for all rows, every volume cut and the weighted model, in a stable order."""
    rows = sensitivity(data, r, x_affective, x_functional, volume, [0, *cuts], weight).filter(F.col("path_order") <= 4)
    label = (
        F.when(F.col("weighted") == 1, "review-volume weighted")
        .when(F.col("cutoff") == 0, "all products")
        .otherwise(F.concat(F.lit(f"{volume} >= "), F.col("cutoff").cast("string")))
    )
    order = F.when(F.col("weighted") == 1, 999).otherwise(F.col("cutoff"))
    out = rows.withColumns({"specification": label, "spec_order": order, "stars": stars(F.col("p"))})
    return out.orderBy("spec_order", "path_order")
