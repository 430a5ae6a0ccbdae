"""Scoring core: degree weights, signed values, comment and product aggregates."""

from pyspark.sql import functions as F

from opinara.functions import scalars as S
from opinara.operators import scoring as SC
from opinara.operators import joins as J
from opinara.operators.standardize import zscore
from opinara.plans import product_scores as P
from opinara.session import pin

from .base import A_DIMS, F_DIMS, ME, MF, WEIGHTS, Catalog, rd, rounded, table

C = Catalog()

WEIGHT_SQL = "CASE trim(degree_word) WHEN 'very' THEN 1.0::DOUBLE WHEN 'fairly' THEN 0.7::DOUBLE WHEN 'slightly' THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END"
FVAL = f"polarity * ({WEIGHT_SQL})"
AVAL = f"(CASE WHEN negated THEN -1 ELSE 1 END) * polarity * ({WEIGHT_SQL})"
FCODE = "CASE WHEN fdim <> 'other' THEN 'MF' || fdim[10:] END"
ACODE = "CASE WHEN adim <> 'other' THEN 'ME' || adim[8:] END"
F_ROWS = f"fm AS (SELECT product_id, comment_id, {FCODE} AS code, {FVAL} AS v, polarity FROM {{matches}} WHERE fdim <> 'other')"
A_ROWS = f"am AS (SELECT product_id, comment_id, {ACODE} AS code, {AVAL} AS v, polarity FROM {{matches}} WHERE adim <> 'other')"
CELLS = "cm AS (SELECT product_id, comment_id, code, avg(v) AS v FROM fm GROUP BY ALL)"


def fmatches(spark, sf):
    m = SC.map_codes(table(spark, sf, "matches"), "fdim", F_DIMS)
    return SC.with_final_value(m, WEIGHTS, apply_negation=False)


def amatches(spark, sf):
    m = SC.map_codes(table(spark, sf, "matches"), "adim", A_DIMS)
    return SC.with_final_value(m, WEIGHTS, apply_negation=True)


@C.add("dim_code_map", f"SELECT {FCODE} AS code, count(*) AS n FROM {{matches}} WHERE fdim <> 'other' GROUP BY 1")
def _(spark, sf):
    m = SC.map_codes(table(spark, sf, "matches"), "fdim", F_DIMS)
    return m.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@C.add("degree_weight", f"SELECT product_id, comment_id, degree_word, {WEIGHT_SQL} AS degree_weight FROM {{matches}}")
def _(spark, sf):
    m = SC.with_degree_weight(table(spark, sf, "matches"), WEIGHTS)
    return m.select("product_id", "comment_id", "degree_word", "degree_weight")


@C.add("degree_weight_table", f"SELECT product_id, comment_id, degree_word, {WEIGHT_SQL} AS degree_weight FROM {{matches}}")
def _(spark, sf):
    lexicon = spark.createDataFrame(list(WEIGHTS.items()), "word string, weight double")
    m = SC.with_degree_lexicon(table(spark, sf, "matches"), lexicon)
    return m.select("product_id", "comment_id", "degree_word", "degree_weight")


@C.add("final_value_signed", f"SELECT product_id, comment_id, {rd(AVAL, 'final_value')} FROM {{matches}}")
def _(spark, sf):
    m = SC.with_final_value(table(spark, sf, "matches"), WEIGHTS, apply_negation=True)
    return rounded(m.select("product_id", "comment_id", "final_value"))


@C.add("final_value_unsigned", f"SELECT product_id, comment_id, {rd(FVAL, 'final_value')} FROM {{matches}}")
def _(spark, sf):
    m = SC.with_final_value(table(spark, sf, "matches"), WEIGHTS, apply_negation=False)
    return rounded(m.select("product_id", "comment_id", "final_value"))


@C.add("agg_n_total", "SELECT * FROM {totals}")
def _(spark, sf):
    return SC.n_total(table(spark, sf, "reviews"))


@C.add("agg_comment_mean", f"WITH {F_ROWS} SELECT product_id, comment_id, code, {rd('avg(v)', 'final_value')} FROM fm GROUP BY ALL")
def _(spark, sf):
    return rounded(SC.comment_mean(fmatches(spark, sf), ["product_id", "comment_id", "code"]))


@C.add(
    "agg_product_density",
    f"""WITH {F_ROWS}, {CELLS}
    SELECT product_id, code, {rd('sum(v)', 'sum_value')}, n_total, {rd('sum(v) / n_total', 'score')}
    FROM cm JOIN {{totals}} USING (product_id) GROUP BY product_id, code, n_total""",
)
def _(spark, sf):
    cm = SC.comment_mean(fmatches(spark, sf), ["product_id", "comment_id", "code"])
    return rounded(SC.density(cm, SC.n_total(table(spark, sf, "reviews"))))


@C.add(
    "agg_coverage",
    f"""WITH {F_ROWS}
    SELECT product_id, code, count(DISTINCT comment_id) AS n_mentioning, n_total,
           {rd('count(DISTINCT comment_id) / n_total', 'coverage')}
    FROM fm JOIN {{totals}} USING (product_id) GROUP BY product_id, code, n_total""",
)
def _(spark, sf):
    return rounded(SC.coverage(fmatches(spark, sf), SC.n_total(table(spark, sf, "reviews"))))


def _wide_sql(rows: str, src: str, dims: list[str], neg: str = "") -> str:
    cells = f"cm AS (SELECT product_id, comment_id, code, avg(v) AS v FROM {src} GROUP BY ALL)"
    per = "pd AS (SELECT product_id, code, sum(v) AS s, count(*) AS h FROM cm GROUP BY ALL)"
    cols = ", ".join(
        f"coalesce(max(s) FILTER (code = '{d}') / n_total, 0) AS {d}, "
        f"coalesce(max(h) FILTER (code = '{d}') / n_total, 0) AS cov_{d}"
        for d in dims
    )
    wide = f"wide AS (SELECT product_id, n_total, {cols} FROM {{totals}} LEFT JOIN pd USING (product_id) GROUP BY product_id, n_total)"
    return f"{rows}, {cells}, {per}, {wide}"


def wide(spark, sf, family: str):
    m, dims = (fmatches(spark, sf), MF) if family == "F" else (amatches(spark, sf), ME)
    return SC.wide_scores(m, SC.n_total(table(spark, sf, "reviews")), dims)


@C.add(
    "agg_pivot_scores",
    f"WITH {_wide_sql(F_ROWS, 'fm', MF)} SELECT product_id, n_total, "
    + ", ".join(f"{rd(d, d)}, {rd(f'cov_{d}', f'cov_{d}')}" for d in MF)
    + " FROM wide",
)
def _(spark, sf):
    return rounded(wide(spark, sf, "F"))


def _scored(spark, sf, family: str, totals=None, profile=None):
    valued, dims = (fmatches(spark, sf), MF) if family == "F" else (amatches(spark, sf), ME)
    return P.family_scores(valued, totals or SC.n_total(table(spark, sf, "reviews")), dims, family, profile=profile)


def both_profiles(spark, sf, totals):
    """Products with what the scores of both families and the functional metrics are made of, from one shuffle."""
    m = table(spark, sf, "matches")
    for letter, dim, dims in (("F", "fdim", F_DIMS), ("E", "adim", A_DIMS)):
        valued = SC.with_final_value(m, WEIGHTS, apply_negation=letter == "E")
        m = valued.withColumnRenamed("final_value", f"value_{letter}").withColumn(f"code_{letter}", S.map_label(F.col(dim), dims))
    profile = SC.joint_profile(m, totals, {"F": ("code_F", "value_F", MF), "E": ("code_E", "value_E", ME)})
    used = [*(f"{d}_{v}" for d in MF for v in ("sum", "abs", "h", "cells")), *(f"{d}_{v}" for d in ME for v in ("sum", "cells"))]
    return pin(profile.select("product_id", "n_total", F.col("n_any_F").alias("n_any"), *used))


def _scored_sql(rows, src, dims, family) -> str:
    z = ", ".join(f"({d} - avg({d}) OVER ()) / stddev_pop({d}) OVER () AS {d}_z" for d in dims)
    zs, raw = " + ".join(f"{d}_z" for d in dims), " + ".join(dims)
    out = ", ".join(f"{rd(d, d)}, {rd(f'{d}_z', f'{d}_z')}, {rd(f'cov_{d}', f'cov_{d}')}" for d in dims)
    return (
        f"WITH {_wide_sql(rows, src, dims)}, zs AS (SELECT *, {z} FROM wide) SELECT product_id, n_total, {out}, "
        f"{rd(f'({zs}) / {len(dims)}', f'M_{family}_avg')}, {rd(f'({raw}) / {len(dims)}', f'M_{family}_avg_raw')} FROM zs"
    )


AFFECTIVE_SQL = _scored_sql(A_ROWS, "am", ME, "E")
FUNCTIONAL_SQL = _scored_sql(F_ROWS, "fm", MF, "F")


@C.add("scores_affective", AFFECTIVE_SQL)
def scores_affective(spark, sf):
    return rounded(_scored(spark, sf, "E"))


@C.add("scores_functional", FUNCTIONAL_SQL)
def scores_functional(spark, sf):
    return rounded(_scored(spark, sf, "F"))


@C.add(
    "zscore_pop",
    "SELECT product_id, " + ", ".join(rd(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", f"{c}_z") for c in ["quantity", "discount"])
    + ", 0.0::DOUBLE AS flat_z FROM {design}",
)
def _(spark, sf):
    d = table(spark, sf, "design").withColumn("flat", F.lit(0.1))
    z = zscore(d, ["quantity", "discount", "flat"], ddof=0, on_constant="zero")
    return rounded(z.select("product_id", "quantity_z", "discount_z", "flat_z"))


@C.add(
    "zscore_sample",
    "SELECT product_id, " + ", ".join(rd(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()", f"{c}_s") for c in ["quantity", "gap"])
    + " FROM {design}",
)
def _(spark, sf):
    z = zscore(table(spark, sf, "design"), ["quantity", "gap"], ddof=1, on_constant="raise",
               names={"quantity": "quantity_s", "gap": "gap_s"})
    return rounded(z.select("product_id", "quantity_s", "gap_s"))


@C.add(
    "zscore_observed",
    f"SELECT product_id, {rd('(gap - avg(gap) OVER ()) / stddev_pop(gap) OVER ()', 'gap_z')}, "
    "CASE WHEN gap IS NOT NULL THEN 0.0::DOUBLE END AS flat_z FROM {design}",
)
def _(spark, sf):
    d = table(spark, sf, "design").withColumn("flat", F.when(F.col("gap").isNotNull(), 3.0))
    return rounded(zscore(d, ["gap", "flat"], ddof=0, on_constant="zero_observed").select("product_id", "gap_z", "flat_z"))


@C.add(
    "zscore_complete_case",
    "SELECT product_id, " + ", ".join(rd(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", f"{c}_z") for c in ["gap", "quantity"])
    + " FROM {design} WHERE gap IS NOT NULL",
)
def _(spark, sf):
    from opinara.operators.standardize import zscore_complete

    return rounded(zscore_complete(table(spark, sf, "design"), ["gap", "quantity"]).select("product_id", "gap_z", "quantity_z"))


@C.add(
    "fill_missing_dims",
    f"""WITH {F_ROWS} SELECT product_id, {', '.join(f"count(*) FILTER (code = '{d}')::DOUBLE AS {d}" for d in MF)},
    0.0::DOUBLE AS MF8 FROM fm GROUP BY product_id""",
)
def _(spark, sf):
    counts = fmatches(spark, sf).groupBy("product_id", "code").agg(F.count(F.lit(1)).cast("double").alias("n"))
    wide_ = SC.to_wide(counts, "product_id", "code", "n", MF, fill=None)
    return SC.fill_dims(wide_, [*MF, "MF8"])


DEC = "dec AS (SELECT product_id, code, n_total, coalesce(sum(v), 0) AS s, count(v) AS h, avg(v) AS pol, coalesce(sum(abs(v)), 0) AS a, avg(abs(v)) AS inten FROM {totals} CROSS JOIN (SELECT 'MF' || i AS code FROM range(1, 8) t(i)) LEFT JOIN cm USING (product_id, code) GROUP BY ALL)"


def decomposed(spark, sf):
    return SC.decompose(fmatches(spark, sf), SC.n_total(table(spark, sf, "reviews")), MF)


@C.add(
    "agg_decompose_dim",
    f"WITH {F_ROWS}, {CELLS}, {DEC} SELECT product_id, code, n_total, h, {rd('s / n_total', 'density')}, "
    f"{rd('a / n_total', 'abs_density')}, {rd('h / n_total', 'coverage')}, {rd('pol', 'polarity')}, {rd('inten', 'intensity')} FROM dec",
)
def _(spark, sf):
    return rounded(decomposed(spark, sf))


@C.add(
    "agg_any_coverage",
    f"""WITH {F_ROWS} SELECT product_id, n_total, count(DISTINCT comment_id) AS n_any,
    {rd('count(DISTINCT comment_id) / n_total', 'coverage_any')} FROM {{totals}} LEFT JOIN fm USING (product_id) GROUP BY product_id, n_total""",
)
def _(spark, sf):
    return rounded(SC.any_coverage(fmatches(spark, sf), SC.n_total(table(spark, sf, "reviews"))))


POOL = "pool AS (SELECT product_id, n_total, count(v) AS h, avg(v) AS pol, avg(abs(v)) AS inten, coalesce(sum(v), 0) AS s FROM {totals} LEFT JOIN cm USING (product_id) GROUP BY product_id, n_total)"


@C.add(
    "agg_pooled",
    f"WITH {F_ROWS}, {CELLS}, {POOL} SELECT product_id, h AS pooled_h, {rd('pol', 'polarity_pooled')}, {rd('inten', 'intensity_pooled')}, "
    f"{rd('h / n_total', 'match_frequency')}, {rd('s / n_total', 'signed_match_density')} FROM pool",
)
def _(spark, sf):
    return rounded(SC.pooled(fmatches(spark, sf), SC.n_total(table(spark, sf, "reviews"))))


@C.add(
    "agg_dim_diagnostics",
    f"WITH {F_ROWS}, {CELLS}, {DEC} SELECT code, count(*) FILTER (h > 0) AS products_with_match, count(*) FILTER (h = 0) AS products_without_match, "
    f"sum(h)::BIGINT AS matched_cells, {rd('avg(h / n_total)', 'mean_coverage')}, {rd('avg(pol)', 'mean_polarity')}, {rd('avg(inten)', 'mean_intensity')} FROM dec GROUP BY code",
)
def _(spark, sf):
    return rounded(SC.dim_diagnostics(decomposed(spark, sf)))


METRICS = list(P.METRICS)


def metric_table(spark, sf):
    """One grouped pivot gives all per-dimension blocks of a product."""
    dec = decomposed(spark, sf)
    aggs = [F.max(F.when(F.col("code") == d, F.col(m))).alias(f"{d}_{m}") for d in MF for m in METRICS]
    return dec.groupBy("product_id").agg(*aggs)


@C.add(
    "join_chain_metrics",
    f"WITH {F_ROWS}, {CELLS}, {DEC}, m AS (SELECT product_id, code, s / n_total AS density, a / n_total AS abs_density, h / n_total AS coverage, pol AS polarity, inten AS intensity FROM dec) SELECT product_id, "
    + ", ".join(rd(f"max({m}) FILTER (code = '{d}')", f"{d}_{m}") for d in MF for m in METRICS)
    + " FROM m GROUP BY product_id",
)
def _(spark, sf):
    return rounded(metric_table(spark, sf))


def metrics(spark, sf, totals=None, profile=None, by_dimension=True):
    totals = totals or SC.n_total(table(spark, sf, "reviews"))
    return P.complete_metrics(fmatches(spark, sf), totals, MF, profile=profile, by_dimension=by_dimension)


FINAL = {
    "density_s": "(" + " + ".join(f"{d}_density_z" for d in MF) + ") / 7",
    "polarity_s": "(" + " + ".join(f"coalesce({d}_polarity_z, 0)" for d in MF) + ") / nullif(nobs, 0)",
    "intensity_s": "(" + " + ".join(f"coalesce({d}_intensity_z, 0)" for d in MF) + ") / nullif(nobs, 0)",
    "coverage_balanced_s": "(" + " + ".join(f"{d}_coverage_z" for d in MF) + ") / 7",
}
COMPLETE_SQL = (
    f"WITH {F_ROWS}, {CELLS}, {DEC}, m AS (SELECT product_id, code, s / n_total AS density, h / n_total AS coverage, pol AS polarity, inten AS intensity, pol FROM dec), w AS (SELECT product_id, count(pol)::INT AS nobs, "
    + ", ".join(f"max({m}) FILTER (code = '{d}') AS {d}_{m}" for d in MF for m in ("density", "coverage", "polarity", "intensity"))
    + " FROM m GROUP BY product_id), z AS (SELECT product_id, nobs, "
    + ", ".join(f"({d}_{m} - avg({d}_{m}) OVER ()) / stddev_pop({d}_{m}) OVER () AS {d}_{m}_z" for d in MF for m in ("density", "coverage", "polarity", "intensity"))
    + " FROM w), f AS (SELECT product_id, nobs, "
    + ", ".join(f"{e} AS {n}" for n, e in FINAL.items())
    + " FROM z) SELECT product_id, nobs AS n_dimensions_observed, "
    + ", ".join(rd(f"({n} - avg({n}) OVER ()) / stddev_samp({n}) OVER ()", n) for n in FINAL)
    + " FROM f"
)


@C.add("complete_metrics", COMPLETE_SQL)
def _(spark, sf):
    return rounded(metrics(spark, sf).select("product_id", "n_dimensions_observed", *FINAL))


@C.add(
    "row_mean",
    f"WITH {F_ROWS}, {CELLS}, {DEC}, w AS (SELECT product_id, "
    + ", ".join(f"max(pol) FILTER (code = '{d}') AS {d}_p" for d in MF)
    + " FROM dec GROUP BY product_id) SELECT product_id, "
    + rd("(" + " + ".join(f"coalesce({d}_p, 0)" for d in MF) + ") / nullif(" + " + ".join(f"({d}_p IS NOT NULL)::INT" for d in MF) + ", 0)", "mean_polarity")
    + " FROM w",
)
def _(spark, sf):
    wide_ = SC.to_wide(decomposed(spark, sf), "product_id", "code", "polarity", MF, fill=None)
    return rounded(wide_.select("product_id", S.row_mean([F.col(d) for d in MF]).alias("mean_polarity")))


@C.add(
    "row_nonnull_count",
    f"WITH {F_ROWS}, {CELLS}, {DEC} SELECT product_id, count(pol)::INT AS n_observed FROM dec GROUP BY product_id",
)
def _(spark, sf):
    wide_ = SC.to_wide(decomposed(spark, sf), "product_id", "code", "polarity", MF, fill=None)
    return wide_.select("product_id", S.row_nonnull([F.col(d) for d in MF]).alias("n_observed"))


@C.add(
    "agg_crosscheck",
    f"WITH {F_ROWS}, {CELLS}, {DEC}, w AS (SELECT product_id, max(pol) FILTER (code = 'MF7') AS p FROM dec GROUP BY product_id) "
    "SELECT count(*) AS n_rows, 0.0::DOUBLE AS max_abs_error, count(*) FILTER (p IS NULL) AS missing_MF7_polarity FROM w",
)
def _(spark, sf):
    # Two code paths for one score: decomposition rebuilt versus the direct wide scores.
    rebuilt = metrics(spark, sf).select("product_id", "MF7_polarity", F.col("density_balanced").alias("rebuilt"))
    direct = _scored(spark, sf, "F").select("product_id", F.col("M_F_avg").alias("direct"))
    both = rebuilt.join(direct, "product_id")
    return rounded(SC.crosscheck(both, "rebuilt", "direct", ["MF7_polarity"]))


@C.add(
    "agg_polarity_counts",
    f"""SELECT product_id, count(*) AS match_n, count(*) FILTER (polarity > 0) AS pos_n, count(*) FILTER (polarity < 0) AS neg_n,
    count(*) FILTER (polarity = 0) AS neu_n, {rd('count(*) FILTER (polarity < 0) / count(*)', 'negative_ratio')},
    {rd('count(*) FILTER (polarity > 0) / count(*)', 'positive_ratio')}, {rd('ln(1 + count(*) FILTER (polarity < 0))', 'ln_neg_count')}
    FROM {{matches}} GROUP BY product_id""",
)
def _(spark, sf):
    return rounded(SC.polarity_counts(table(spark, sf, "matches")))


@C.add(
    "agg_polarity_one_dim",
    f"""SELECT product_id, count(*) AS mf2_match_n, count(*) FILTER (polarity > 0) AS mf2_pos_n, count(*) FILTER (polarity < 0) AS mf2_neg_n,
    count(*) FILTER (polarity = 0) AS mf2_neu_n, {rd('count(*) FILTER (polarity < 0) / count(*)', 'mf2_negative_ratio')},
    {rd('count(*) FILTER (polarity > 0) / count(*)', 'mf2_positive_ratio')}, {rd('ln(1 + count(*) FILTER (polarity < 0))', 'mf2_ln_neg_count')}
    FROM {{matches}} WHERE fdim IN ('function 2', 'MF2') GROUP BY product_id""",
)
def _(spark, sf):
    where = F.col("fdim").isin("function 2", "MF2")
    return rounded(SC.polarity_counts(table(spark, sf, "matches"), where=where, prefix="mf2_"))


@C.add(
    "agg_polarity_global",
    f"""WITH pp AS (SELECT p.product_id, count(polarity) AS match_n, count(*) FILTER (polarity > 0) AS pos_n, count(*) FILTER (polarity < 0) AS neg_n,
      count(*) FILTER (polarity = 0) AS neu_n FROM {{products}} p LEFT JOIN {{matches}} USING (product_id) GROUP BY p.product_id)
    SELECT count(*) AS n_products, count(*) FILTER (match_n > 0) AS products_with_matches, sum(match_n)::BIGINT AS matches_total,
      sum(pos_n)::BIGINT AS positive_total, sum(neg_n)::BIGINT AS negative_total, sum(neu_n)::BIGINT AS neutral_total,
      {rd('sum(neg_n) / sum(match_n)', 'negative_share_total')}, {rd('avg(coalesce(neg_n / nullif(match_n, 0), 0))', 'negative_ratio_product_mean')} FROM pp""",
)
def _(spark, sf):
    counts = SC.polarity_counts(table(spark, sf, "matches"))
    filled = J.left_dim(table(spark, sf, "products").select("product_id"), counts, "product_id").fillna(0)
    return rounded(SC.polarity_totals(filled))


@C.add("label_filter", "SELECT fdim, polarity, count(*) AS n FROM {matches} WHERE fdim IN ('function 2', 'function 5') GROUP BY ALL")
def _(spark, sf):
    m = SC.with_labels(table(spark, sf, "matches"), "fdim", ["function 2", "function 5"])
    return m.groupBy("fdim", "polarity").agg(F.count(F.lit(1)).alias("n"))


@C.add("safe_ratio", f"SELECT product_id, {rd('count(*) FILTER (polarity < 0) / nullif(count(*) FILTER (polarity <> 0), 0)', 'share')} FROM {{matches}} GROUP BY product_id")
def _(spark, sf):
    n = table(spark, sf, "matches").groupBy("product_id").agg(
        F.count_if(F.col("polarity") < 0).alias("a"), F.count_if(F.col("polarity") != 0).alias("b")
    )
    return rounded(n.select("product_id", S.ratio(F.col("a"), F.col("b")).alias("share")))
