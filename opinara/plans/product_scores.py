"""Matches to product scores: weights, comment means, densities, coverage, z-scores, composites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_DEGREE_WEIGHT, row_mean, row_nonnull
from ..operators.joins import full_outer
from ..operators.scoring import map_codes, product_profile, wide_of, wide_scores, with_final_value
from ..operators.standardize import zscore
from ..session import pin

METRICS = ("density", "abs_density", "coverage", "polarity", "intensity")


def valued_matches(
    matches: DataFrame,
    dims: Mapping[str, str],
    weights: Mapping[str, float],
    apply_negation: bool,
    label: str = "dimension",
    default: float = DEFAULT_DEGREE_WEIGHT,
) -> DataFrame:
    """Matches of known dimensions with ``code`` and ``final_value``."""
    return with_final_value(map_codes(matches, label, dims), weights, apply_negation, default)


def family_scores(
    valued: DataFrame,
    totals: DataFrame,
    codes: Sequence[str],
    letter: str,
    key: str = "product_id",
    comment: str = "comment_id",
    profile: DataFrame | None = None,
) -> DataFrame:
    """Wide scores, coverages, population z-scores and the two family composites.

    The product table is pinned before standardising: the global statistics are
    then a scan of that small table, not a second aggregation of the matches.
    A pinned ``joint_profile`` of these matches takes the place of a shuffle of their own.
    """
    wide = pin(wide_scores(valued, totals, codes, key, comment)) if profile is None else wide_of(profile, codes, key)
    z = zscore(wide, codes, ddof=0, on_constant="zero")
    return z.withColumns(
        {
            f"M_{letter}_avg": row_mean([F.col(f"{c}_z") for c in codes]),
            f"M_{letter}_avg_raw": row_mean([F.col(c) for c in codes]),
        }
    )


def combined_scores(affective: DataFrame, functional: DataFrame, key: str = "product_id") -> DataFrame:
    """Both families side by side (full outer join)."""
    return full_outer(affective.drop("n_total"), functional.withColumnRenamed("n_total", "n_reviews"), key)


def complete_metrics(
    valued: DataFrame,
    totals: DataFrame,
    codes: Sequence[str],
    key: str = "product_id",
    comment: str = "comment_id",
    ddof: int = 1,
    profile: DataFrame | None = None,
    by_dimension: bool = True,
) -> DataFrame:
    """Strict decomposition of one family: frequency, polarity and intensity apart from density.

    Polarity and intensity stay null where a product has no match in a dimension,
    and balanced means skip those dimensions. Columns ending in ``_s`` are the
    final measures, standardised where observed. ``profile`` as in
    :func:`family_scores`, with ``n_any`` of this family. Without ``by_dimension`` the columns of single dimensions
    are made but not written again.
    """
    profile = product_profile(valued, totals, codes, key, comment) if profile is None else profile
    blocks = []
    for c in codes:
        blocks += [
            f"`{c}_sum` / n_total AS `{c}_density`",
            f"`{c}_abs` / n_total AS `{c}_abs_density`",
            f"`{c}_h` / n_total AS `{c}_coverage`",
            f"try_divide(`{c}_sum`, `{c}_h`) AS `{c}_polarity`",
            f"try_divide(`{c}_abs`, `{c}_h`) AS `{c}_intensity`",
        ]
    h, total, absolute = (" + ".join(f"`{c}_{part}`" for c in codes) for part in ("h", "sum", "abs"))
    base = pin(
        profile.selectExpr(
            key,
            "n_total",
            "n_any",
            "n_any / n_total AS coverage_any",
            f"{h} AS pooled_h",
            f"try_divide({total}, {h}) AS polarity_pooled",
            f"try_divide({absolute}, {h}) AS intensity_pooled",
            f"({h}) / n_total AS match_frequency",
            f"({total}) / n_total AS signed_match_density",
            *blocks,
        )
    )
    cells = [f"{c}_{m}" for c in codes for m in METRICS]
    z = zscore(base, cells, ddof=0, on_constant="zero_observed")
    balanced = {f"{m}_balanced": row_mean([F.col(f"{c}_{m}_z") for c in codes]) for m in METRICS}
    z = z.withColumns({**balanced, "n_dimensions_observed": row_nonnull([F.col(f"{c}_polarity_z") for c in codes])})
    final = {
        "density_balanced": "density_s",
        "abs_density_balanced": "abs_density_s",
        "polarity_balanced": "polarity_s",
        "intensity_balanced": "intensity_s",
        "coverage_any": "coverage_any_s",
        "coverage_balanced": "coverage_balanced_s",
        "polarity_pooled": "polarity_pooled_s",
        "intensity_pooled": "intensity_pooled_s",
        "match_frequency": "match_frequency_s",
    }
    keep = [key, "n_total", "n_any", "pooled_h", "signed_match_density", "n_dimensions_observed", *(cells if by_dimension else ()), *final]
    return zscore(pin(z.select(*keep)), list(final), ddof=ddof, on_constant="zero_observed", names=final)
