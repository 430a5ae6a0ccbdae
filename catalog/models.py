"""Regressions, collinearity, factor share, mediation, resampling and joint tests."""

from pyspark.sql import functions as F

from opinara.functions.hashing import MOD, MULT, POISSON_CUTS, STEP_HIGH, STEP_REP, STEP_ROW, seed_state
from opinara.operators import gram as G
from opinara.operators import mediation as M
from opinara.operators import regression as R
from opinara.operators import resampling as B
from opinara.operators import vectors as OV
from opinara.operators.scoring import n_total
from opinara.operators.stacks import evaluate_moments, replicate_sums
from opinara.operators.standardize import zscore
from opinara.operators.summary import group_mean_log
from opinara.plans import inference as I
from opinara.plans.master import build_master, derived_controls
from opinara.session import pin

from .base import ME, MF, Catalog, rd, rounded, table
from .scoring import _scored, both_profiles, metrics
from .summaries import satisfaction

C = Catalog()


_TABLES: dict = {}


def shared(name):
    """Stage hand-off: a pinned table is built once per session and data folder, then read by later models."""

    def wrap(build):
        def get(spark, sf):
            key = (name, spark.sparkContext.applicationId, sf)
            if key not in _TABLES:
                _TABLES[key] = build(spark, sf)
            return _TABLES[key]

        return get

    return wrap


# --- closed forms ---------------------------------------------------------------------------------------------------
def one_x(src: str, y: str, x: str, w: str = "1.0::DOUBLE", where: str = "true") -> str:
    """CTEs for y on x with weights: fit(b, a, n, r2, se, t)."""
    return f"""d AS (SELECT {y} AS y, {x} AS x, {w} AS w FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL AND {where}),
      mom AS (SELECT count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM d),
      fit0 AS (SELECT n, mx, my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (y - my) * (y - my)) AS syy
        FROM d CROSS JOIN mom GROUP BY n, mx, my),
      fit AS (SELECT n, b, my - b * mx AS a, mx, my, 1 - sum(w * (y - my - b * (x - mx)) * (y - my - b * (x - mx))) / any_value(syy) AS r2,
        sqrt(n / (n - 2) * sum(w * w * (x - mx) * (x - mx) * (y - my - b * (x - mx)) * (y - my - b * (x - mx)))) / any_value(sxx) AS se FROM d CROSS JOIN fit0 GROUP BY n, b, mx, my)"""


def two_x(src: str, y: str, x1: str, x2: str) -> str:
    """CTEs for y on x1 and x2 by partialling out: fit(n, b1, b2, se1, se2, r2)."""
    return f"""d AS (SELECT {y} AS y, {x1} AS x1, {x2} AS x2 FROM {src} WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL),
      s AS (SELECT regr_slope(x1, x2) AS s12, regr_intercept(x1, x2) AS i12, regr_slope(x2, x1) AS s21, regr_intercept(x2, x1) AS i21, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM d),
      r AS (SELECT d.*, s.*, x1 - i12 - s12 * x2 AS r1, x2 - i21 - s21 * x1 AS r2 FROM d CROSS JOIN s),
      b AS (SELECT sum(r1 * y) / sum(r1 * r1) AS b1, sum(r2 * y) / sum(r2 * r2) AS b2 FROM r),
      e AS (SELECT r.*, b.*, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e FROM r CROSS JOIN b),
      fit AS (SELECT n, b1, b2, sqrt(n / (n - 3) * sum(r1 * r1 * e * e)) / sum(r1 * r1) AS se1, sqrt(n / (n - 3) * sum(r2 * r2 * e * e)) / sum(r2 * r2) AS se2,
        1 - sum(e * e) / sum((y - my) * (y - my)) AS r2 FROM e GROUP BY n, b1, b2)"""


def p_value(t: str, dof: str) -> str:
    """Two-sided p of Student's t: with t = sqrt(dof) tan(a) it is an integral of cos(a)^(dof - 1), here by Simpson's rule."""
    dof = f"({dof})"
    low = f"atan(abs({t}) / sqrt({dof}))"
    step = f"(least(pi() / 2 - {low}, 10 / sqrt({dof})) / 1000)"
    area = f"(SELECT sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(({dof} - 1) * ln(greatest(cos({low} + i * {step}), 1e-300)))) FROM range(0, 1001) r(i))"
    return f"(2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi()) * {area} * {step} / 3)"


def last_x(src: str, y: str, xs: list[str]) -> str:
    """CTEs for the last of ``xs`` in a model with all of them, by making each column orthogonal to those before: fit(n, b, se, r2)."""
    names = [f"x{i}" for i in range(len(xs))]
    sides = ", ".join(f"{x}::DOUBLE AS {v}" for x, v in zip(xs, names))
    parts = [f"g AS (SELECT {y}::DOUBLE AS y, {sides} FROM {src} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [y, *xs])})"]
    centred = ", ".join(f"{v} - avg({v}) OVER () AS {v}" for v in ["y", *names])
    parts.append(f"g0 AS (SELECT *, y AS y0 FROM (SELECT {centred} FROM g))")
    for i, u in enumerate(names):
        rest = ", ".join(f"{v} - {u} * (sum({v} * {u}) OVER () / sum({u} * {u}) OVER ()) AS {v}" for v in ["y", *names[i + 1 :]])
        parts.append(f"g{i + 1} AS (SELECT y0, {u}, {rest} FROM g{i})")
    u = names[-1]
    parts.append(f"""fit AS (SELECT count(*) AS n, sum({u} * y0) / sum({u} * {u}) AS b, sqrt(count(*) / (count(*) - {len(xs) + 1}) * sum({u} * {u} * y * y)) / sum({u} * {u}) AS se,
      1 - sum(y * y) / sum(y0 * y0) AS r2 FROM g{len(xs)})""")
    return ", ".join(parts)


COEF = ["term", "beta", "se", "t", "p", "n", "r2"]


def slope_rows(fits, *extra):
    return rounded(fits.filter(F.col("term") != G.CONST).select(*extra, *COEF))


def two_rows(spec_cols: str, x1: str, x2: str) -> str:
    row = lambda i, x: f"SELECT {spec_cols}'{x}' AS term, {rd(f'b{i}', 'beta')}, {rd(f'se{i}', 'se')}, {rd(f'b{i} / se{i}', 't')}, {rd(p_value(f'b{i} / se{i}', 'n - 3'), 'p')}, n, {rd('r2', 'r2')} FROM fit"
    return f"{row(1, x1)} UNION ALL {row(2, x2)}"


def design(spark, sf):
    return pin(table(spark, sf, "design"))


GX = ["quantity", "gap"]
GCELLS = " UNION ALL ".join(
    f"SELECT {i * 3 + j}::INT AS pos, {rd(f'sum({a} * {b})', 'g')} FROM {{design}} WHERE gap IS NOT NULL"
    for i, a in enumerate(["1", *GX])
    for j, b in enumerate(["1", *GX])
)


@C.add("gram_matrix", GCELLS)
def _(spark, sf):
    g = G.gram(table(spark, sf, "design"), GX)
    return rounded(g.select(F.posexplode("g").alias("pos", "g")))


@C.add("ols_fit", f"WITH {two_x('{design}', 'spend', 'quantity', 'gap')} SELECT product_id, {rd('my + b1 * (quantity - m1) + b2 * (gap - m2)', 'fitted')}, {rd('spend - (my + b1 * (quantity - m1) + b2 * (gap - m2))', 'resid')} FROM {{design}} CROSS JOIN s CROSS JOIN b WHERE gap IS NOT NULL")
def _(spark, sf):
    rows = R.residuals(table(spark, sf, "design"), R.Spec("m", "spend", ("quantity", "gap")))
    return rounded(rows.select("product_id", "fitted", "resid"))


@C.add("ols_hc1", f"WITH {two_x('{design}', 'spend', 'quantity', 'gap')} {two_rows('', 'quantity', 'gap')}")
def _(spark, sf):
    return slope_rows(R.ols(design(spark, sf), R.specs([("m", "spend", ["quantity", "gap"])])))


@C.add(
    "ols_r2",
    f"WITH {one_x('{design}', 'spend', 'gap')} SELECT 'm' AS spec, n, {rd('r2', 'r2')}, {rd('1 - (1 - r2) * (n - 1) / (n - 2)', 'adj_r2')}, {rd('(b / se) * (b / se)', 'f')} FROM fit",
)
def _(spark, sf):
    fits = R.ols(design(spark, sf), R.specs([("m", "spend", ["gap"])]))
    return rounded(R.fit_stats(fits).select("spec", "n", "r2", "adj_r2", "f"))


@C.add("ols_weighted", f"WITH {one_x('{design}', 'spend', 'gap', 'n_reviews::DOUBLE')} SELECT 'gap' AS term, {rd('b', 'beta')}, {rd('se', 'se')}, {rd('b / se', 't')}, {rd(p_value('b / se', 'n - 2'), 'p')}, n, {rd('r2', 'r2')} FROM fit")
def _(spark, sf):
    return slope_rows(R.ols(design(spark, sf), R.specs([("m", "spend", ["gap"])]), weight="n_reviews"))


ZD = "zd AS (SELECT product_id, (spend - avg(spend) OVER ()) / stddev_pop(spend) OVER () AS spend, (gap - avg(gap) OVER ()) / stddev_pop(gap) OVER () AS gap, (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () AS quantity FROM {design} WHERE gap IS NOT NULL)"


@C.add("ols_standardized", f"WITH {ZD}, {two_x('zd', 'spend', 'quantity', 'gap')} SELECT * FROM ({two_rows('', 'quantity', 'gap')}) WHERE term = 'gap'")
def _(spark, sf):
    return slope_rows(R.ols_standardized(design(spark, sf), "spend", ["quantity", "gap"], target="gap"))


# Not ``size``: ``gap`` is a multiple of it, and coefficients of dependent columns are not unique.
EXTRA = ["tax", "n_reviews"]
GRID = [(y, t) for y in ("spend", "price") for t in ("gap", "discount")]


def grid_rows(y: str, target: str, kind: str, xs: list[str]) -> list[str]:
    """A row for each predictor of one model, taken as the last one."""
    cols = f"{rd('b', 'beta')}, {rd('se', 'se')}, {rd('b / se', 't')}, {rd(p_value('b / se', f'n - {len(xs) + 1}'), 'p')}, n, {rd('r2', 'r2')}"
    return [
        f"SELECT * FROM (WITH {last_x('{design}', y, [c for c in xs if c != x] + [x])} SELECT '{y}|{target}|{kind}' AS spec, '{x}' AS term, {cols} FROM fit)"
        for x in xs
    ]


@C.add(
    "ols_grid",
    " UNION ALL ".join(r for y, t in GRID for kind, extra in (("base", []), ("extended", EXTRA)) for r in grid_rows(y, t, kind, [t, "quantity", *extra])),
)
def _(spark, sf):
    return slope_rows(R.ols_grid(design(spark, sf), ["spend", "price"], ["gap", "discount"], ["quantity"], extra=EXTRA), "spec")


@C.add(
    "ols_a_paths",
    " UNION ALL ".join(f"SELECT * FROM (WITH {two_x('{design}', y, 'quantity', 'tax')} {two_rows(f"'{y}' AS spec, ", 'quantity', 'tax')})" for y in ("spend", "discount")),
)
def _(spark, sf):
    return slope_rows(R.ols_multi(design(spark, sf), ["spend", "discount"], ["quantity", "tax"]), "spec")


@C.add(
    "ols_outcome_variants",
    " UNION ALL ".join(f"SELECT * FROM (WITH {one_x('{design}', y, 'quantity')} SELECT '{y}' AS spec, 'quantity' AS term, {rd('b', 'beta')}, {rd('se', 'se')}, {rd('b / se', 't')}, {rd(p_value('b / se', 'n - 2'), 'p')}, n, {rd('r2', 'r2')} FROM fit)" for y in ("spend", "discount", "tax", "price", "gap")),
)
def _(spark, sf):
    return slope_rows(R.ols_multi(design(spark, sf), ["spend", "discount", "tax", "price", "gap"], ["quantity"]), "spec")


CUTS = [20, 30, 36]
ZN = "zn AS (SELECT n_reviews, (spend - avg(spend) OVER ()) / stddev_samp(spend) OVER () AS spend_s, (tax - avg(tax) OVER ()) / stddev_samp(tax) OVER () AS tax_s FROM {design})"


@C.add(
    "ols_subsample",
    f"WITH {ZN} " + " UNION ALL ".join(f"SELECT * FROM (WITH {one_x('zn', 'spend_s', 'tax_s', where=f'n_reviews >= {c}')} SELECT {c}::INT AS cutoff, 'tax_s' AS term, {rd('b', 'beta')}, {rd('se', 'se')}, {rd('b / se', 't')}, {rd(p_value('b / se', 'n - 2'), 'p')}, n, {rd('r2', 'r2')} FROM fit)" for c in CUTS),
)
def _(spark, sf):
    z = zscore(design(spark, sf), ["spend", "tax"], ddof=1, on_constant="raise", names={"spend": "spend_s", "tax": "tax_s"})
    return slope_rows(R.ols_thresholds(z, R.specs([("m", "spend_s", ["tax_s"])]), "n_reviews", CUTS), "cutoff")


@C.add(
    "ols_by_group",
    f"""WITH mom AS (SELECT brand, count(*) AS n, avg(tax) AS mx, avg(spend) AS my FROM {{design}} GROUP BY brand),
      fit0 AS (SELECT brand, n, mx, my, sum((tax - mx) * (spend - my)) / sum((tax - mx) * (tax - mx)) AS b, sum((tax - mx) * (tax - mx)) AS sxx, sum((spend - my) * (spend - my)) AS syy
        FROM {{design}} JOIN mom USING (brand) GROUP BY brand, n, mx, my),
      e AS (SELECT *, spend - my - b * (tax - mx) AS e FROM {{design}} JOIN fit0 USING (brand)),
      fit AS (SELECT brand, n, b, sqrt(n / (n - 2) * sum((tax - mx) * (tax - mx) * e * e)) / sxx AS se, 1 - sum(e * e) / syy AS r2 FROM e GROUP BY brand, n, b, sxx, syy)
      SELECT brand, 'tax' AS term, {rd('b', 'beta')}, {rd('se', 'se')}, {rd('b / se', 't')}, {rd(p_value('b / se', 'n - 2'), 'p')}, n, {rd('r2', 'r2')} FROM fit""",
)
def _(spark, sf):
    return slope_rows(R.ols(design(spark, sf), R.specs([("m", "spend", ["tax"])]), by="brand"), "brand")


@C.add("vif", f"""WITH d AS (SELECT * FROM {{design}} WHERE gap IS NOT NULL), v AS (SELECT 1 / (1 - corr(gap, quantity) * corr(gap, quantity)) AS v FROM d)
  SELECT variable, {rd('v', 'vif')}, {rd('1 / v', 'tolerance')}, '' AS flag FROM v, (SELECT unnest(['gap', 'quantity']) AS variable)""")
def _(spark, sf):
    return rounded(R.vif(table(spark, sf, "design"), ["gap", "quantity"]).drop("spec"))


@C.add("pca_single_factor", f"SELECT count(*) AS n, {rd('(1 + abs(corr(gap, quantity))) / 2 * 100', 'first_factor_pct')} FROM {{design}} WHERE gap IS NOT NULL")
def _(spark, sf):
    return rounded(R.single_factor(table(spark, sf, "design"), ["gap", "quantity"]).select("n", "first_factor_pct"))


# --- mediation: residualising on the single predictor leaves two-variable closed forms ------------------------------
X, M1, M2, Y = "tax", "discount", "quantity", "spend"
RES = f"""co AS (SELECT {', '.join(f"regr_slope({v}, {X}) AS s_{v}, regr_intercept({v}, {X}) AS i_{v}" for v in (M1, M2, Y))} FROM {{design}}),
  res AS (SELECT {', '.join(f"{v} - i_{v} - s_{v} * {X} AS {v}" for v in (M1, M2, Y))} FROM {{design}} CROSS JOIN co),
  c AS (SELECT var_pop({M1}) AS v1, var_pop({M2}) AS v2, covar_pop({M1}, {M2}) AS c12, covar_pop({M1}, {Y}) AS c1y, covar_pop({M2}, {Y}) AS c2y FROM res),
  k AS (SELECT s_{M1} AS a1, s_{M2} AS a2, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2, c12 / v1 AS d12, c12 / v2 AS d21 FROM co CROSS JOIN c)"""


def stat_rows(pairs: list[tuple[str, str]]) -> str:
    return f"WITH {RES} " + " UNION ALL ".join(f"SELECT '{n}' AS stat, {rd(e, 'value')} FROM k" for n, e in pairs)


IND = [(f"ind|{M1}|{X}", "a1 * b1"), (f"ind|{M2}|{X}", "a2 * b2")]


@C.add("indirect_parallel", stat_rows(IND))
def _(spark, sf):
    return rounded(M.indirect_parallel(table(spark, sf, "design"), [X], [M1, M2], Y))


@C.add(
    "indirect_contrasts",
    stat_rows([(f"total_abs|{M1}", "abs(a1 * b1)"), (f"total_abs|{M2}", "abs(a2 * b2)"), ("diff_abs", "abs(a1 * b1) - abs(a2 * b2)")]),
)
def _(spark, sf):
    return rounded(M.indirect_contrasts(M.indirect_parallel(table(spark, sf, "design"), [X], [M1, M2], Y)))


@C.add("indirect_serial_a", stat_rows([(f"serial|{X}", "a1 * d12 * b2"), ("d", "d12"), ("b_first", "b1"), ("b_second", "b2"), ("serial_total", "a1 * d12 * b2")]))
def _(spark, sf):
    return rounded(M.indirect_serial(table(spark, sf, "design"), [X], (M1, M2), Y))


@C.add("indirect_serial_b", stat_rows([(f"serial|{X}", "a2 * d21 * b1"), ("d", "d21"), ("b_first", "b2"), ("b_second", "b1"), ("serial_total", "a2 * d21 * b1")]))
def _(spark, sf):
    return rounded(M.indirect_serial(table(spark, sf, "design"), [X], (M2, M1), Y))


@C.add("indirect_multi_component", stat_rows([*IND, (f"ind_total|{X}", "a1 * b1 + a2 * b2")]))
def _(spark, sf):
    return rounded(M.indirect_components(table(spark, sf, "design"), [X], [M1, M2], Y))


# --- resampling: the hash is 64-bit integer arithmetic, so SQL draws the same numbers --------------------------------
def mixed(src: str, col: str) -> str:
    for _ in range(2):
        src = f"(SELECT * REPLACE ((xor({col}, {col} >> 16) * {MULT}) % {MOD} AS {col}) FROM {src})"
    return f"(SELECT * REPLACE (xor({col}, {col} >> 16) AS {col}) FROM {src})"


def hashed(src: str, seed: int, rep: str, row: str, col: str) -> str:
    """Add column ``col`` = hash(seed, rep, row) to a sub-select."""
    src = mixed(f"(SELECT *, ({seed_state(seed)}::BIGINT + {rep}::BIGINT * {STEP_REP}) % {MOD} AS {col} FROM {src})", col)
    src = mixed(f"(SELECT * REPLACE (({col} + ({row}::BIGINT % {MOD}) * {STEP_ROW}) % {MOD} AS {col}) FROM {src})", col)
    return mixed(f"(SELECT * REPLACE (({col} + ({row}::BIGINT // {MOD}) * {STEP_HIGH}) % {MOD} AS {col}) FROM {src})", col)


REPS, SEED = 40, 20260716
EXACT = f"""rowsx AS (SELECT row_number() OVER (ORDER BY product_id) - 1 AS idx, spend, quantity FROM {{design}} WHERE spend IS NOT NULL AND quantity IS NOT NULL),
  nn AS (SELECT count(*) AS n FROM rowsx),
  dr AS (SELECT r.i AS rep, q.i AS draw FROM range({REPS}) r(i) CROSS JOIN (SELECT unnest(range(n)) AS i FROM nn) q),
  hh AS (SELECT * FROM {hashed(hashed('dr', SEED, 'rep', '(2 * draw)', 'h1'), SEED, 'rep', '(2 * draw + 1)', 'h2')}),
  pick AS (SELECT rep, (h1 * {MOD} + h2) % n AS idx FROM hh CROSS JOIN nn),
  boot AS (SELECT rep, avg(spend) AS m, regr_slope(spend, quantity) AS b FROM pick JOIN rowsx USING (idx) GROUP BY rep),
  draws AS (SELECT rep, 'mean|spend' AS stat, m AS value FROM boot UNION ALL SELECT rep, 'beta|quantity', b FROM boot)"""
MEAN, SLOPE = M.Mean(("spend",)), M.Slope(("quantity",), "spend")


@shared("draws")
def exact_draws(spark, sf):
    found = pin(B.hashed_moments(table(spark, sf, "design"), ["quantity", "spend"], ["product_id"], REPS, SEED))
    means = evaluate_moments(found, M.Mean(("quantity", "spend")), "rep").filter(F.col("stat") == "mean|spend")
    return pin(means.unionByName(evaluate_moments(found, SLOPE, "rep")))


@C.add("bootstrap_exact", f"WITH {EXACT} SELECT rep::INT AS rep, stat, {rd('value', 'value')} FROM draws")
def _(spark, sf):
    return rounded(exact_draws(spark, sf))


@C.add("bootstrap_split", f"SELECT r.i::INT AS rep, count(*)::DOUBLE AS sw FROM range({REPS}) r(i) CROSS JOIN {{design}} WHERE spend IS NOT NULL AND quantity IS NOT NULL GROUP BY r.i")
def _(spark, sf):
    """Counts made by splitting add up to n in every replicate; the tests walk the tree row by row."""
    return replicate_sums(B.split_moments(table(spark, sf, "design"), ["quantity", "spend"], ["product_id"], REPS, SEED)).select("rep", "sw")


POISSON_COUNT = " + ".join(f"(h >= {c})::INT" for c in POISSON_CUTS)
POISSON = f"""dr AS (SELECT r.i AS rep, o_orderkey, o_totalprice / 1000 AS v FROM range({REPS}) r(i) CROSS JOIN orders),
  hh AS (SELECT rep, v, {POISSON_COUNT} AS w FROM {hashed('dr', SEED, 'rep', 'o_orderkey', 'h')})"""


@C.add("bootstrap_poisson", f"WITH {POISSON} SELECT rep::INT AS rep, 'mean|v' AS stat, {rd('sum(w * v) / sum(w)', 'value')} FROM hh GROUP BY rep")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("v"))
    return rounded(B.bootstrap(o, M.Mean(("v",)), REPS, SEED, ["o_orderkey"], "poisson"))


@C.add("ci_percentile", f"WITH {EXACT} SELECT stat, {rd('quantile_cont(value, 0.025)', 'ci_low')}, {rd('quantile_cont(value, 0.975)', 'ci_high')}, count(*) AS reps FROM draws GROUP BY stat")
def _(spark, sf):
    return rounded(B.percentile_ci(exact_draws(spark, sf)))


@C.add("boot_p_two_sided", f"WITH {EXACT} SELECT stat, {rd('least(1.0, 2 * least((count(*) FILTER (value <= 0) + 1) / (count(*) + 1), (count(*) FILTER (value >= 0) + 1) / (count(*) + 1)))', 'p_boot')} FROM draws GROUP BY stat")
def _(spark, sf):
    return rounded(B.boot_p(exact_draws(spark, sf)))


@C.add("boot_se", f"WITH {EXACT} SELECT stat, {rd('stddev_samp(value)', 'boot_se')}, {rd('avg(value)', 'boot_mean')} FROM draws GROUP BY stat")
def _(spark, sf):
    return rounded(B.boot_se(exact_draws(spark, sf)))


NORMAL_P = "(SELECT 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) + i * 0.006, 2) / 2)) * 0.006 / 3 / sqrt(2 * pi()) FROM range(0, 2001) r(i))"


@C.add(
    "boot_normal_p",
    f"""WITH {EXACT}, est AS (SELECT 'mean|spend' AS stat, avg(spend) AS estimate FROM rowsx UNION ALL SELECT 'beta|quantity', regr_slope(spend, quantity) FROM rowsx),
    zs AS (SELECT stat, any_value(estimate) AS estimate, stddev_samp(value) AS boot_se, any_value(estimate) / stddev_samp(value) AS z FROM draws JOIN est USING (stat) GROUP BY stat)
    SELECT stat, {rd('estimate', 'estimate')}, {rd('boot_se', 'boot_se')}, {rd('z', 'z_normal')}, {rd(NORMAL_P, 'p_normal')} FROM zs""",
)
def _(spark, sf):
    d = table(spark, sf, "design").filter("spend IS NOT NULL AND quantity IS NOT NULL")
    point = M.estimate(d, MEAN).unionByName(M.estimate(d, SLOPE))
    return rounded(B.normal_p(point, B.boot_se(exact_draws(spark, sf))))


@C.add(
    "jackknife_stats",
    f"""WITH t AS (SELECT count(*) AS n, sum(gap) AS s FROM {{design}} WHERE gap IS NOT NULL), j AS (SELECT n, (s - gap) / (n - 1) AS v FROM {{design}} CROSS JOIN t WHERE gap IS NOT NULL),
    c AS (SELECT *, avg(v) OVER () AS m FROM j) SELECT 'mean|gap' AS stat, any_value(n) AS n, {rd('sum((m - v) ** 3) / (6 * sum((m - v) ** 2) ** 1.5)', 'accel')} FROM c""",
)
def _(spark, sf):
    return rounded(B.acceleration(B.jackknife_moments(table(spark, sf, "design"), M.Mean(("gap",)))))


@C.add("ci_bca")
def _(spark, sf):
    """No SQL twin: needs the normal quantile; checked against numpy in the tests."""
    d = pin(table(spark, sf, "design").select("product_id", "spend", "quantity"))
    draws = pin(B.bootstrap(d, SLOPE, 200, SEED, ["product_id"]))
    return rounded(B.bca_ci(draws, M.estimate(d, SLOPE), B.jackknife_moments(d, SLOPE)))


# --- the product master and the inference plans (26 columns: numpy-checked in the tests) -----------------------------
PCS = [f"z_pc{i}" for i in range(1, 8)]
CONTROLS = ["lnprice", "lnreviews", "has_discount", "free_shipping", "ln_imperfection", "ln_brand_avg_price", "recency_inv"]
LOGS = CONTROLS[:2]  # made by ``prepare``
YS = ["y_favrate_only", "y_50_50", "y_30_70", "y_70_30", "y_sentiment_only"]
DIMZ = [f"{d.lower()}_z" for d in [*ME, *MF]]
S_ = lambda names: tuple(f"{n}_s" for n in names)
ROLES = I.Roles(S_(PCS), "m_e_avg_s", "m_f_avg_s", "y_favrate_only_s", S_(CONTROLS))


@shared("totals")
def totals(spark, sf):
    return pin(n_total(table(spark, sf, "reviews")))


@shared("profiles")
def profiles(spark, sf):
    """Read by the master and by the metrics, so the matches are shuffled once for them all."""
    return both_profiles(spark, sf, totals(spark, sf))


def master(spark, sf):
    affective, functional = (_scored(spark, sf, family, totals(spark, sf), profiles(spark, sf)) for family in "EF")
    # Merge joins where both sides have a row for every product, as in ``build_master``.
    scores = affective.drop("n_total").join(functional.hint("merge"), "product_id")
    pcs = OV.pca_scores(table(spark, sf, "vectors"), "vec_id", "embedding", 7).withColumnRenamed("vec_id", "product_id")
    sat = satisfaction(spark, sf)
    merged = build_master(scores, pcs, sat, norm_key=False)
    controls = derived_controls(
        table(spark, sf, "reviews"), "product_id", F.avg("l_discount") > 0.05, F.avg("l_tax") < 0.04,
        F.avg((F.col("sentiment_score") < 0).cast("double")), F.max("l_shipdate"), F.lit("2002-01-01").cast("date"),
    )
    brand = group_mean_log(table(spark, sf, "products"), "brand", "price", "ln_brand_avg_price").select("product_id", "ln_brand_avg_price")
    return merged.join(controls.hint("merge"), "product_id").join(brand.hint("merge"), "product_id")


@C.add("product_master")
def _(spark, sf):
    return rounded(master(spark, sf))


@shared("complete")
def complete(spark, sf):
    """Products with component scores: the model sample. Columns of the master that models use; the others would be written twice."""
    scored = [*YS, "m_e_avg", "m_f_avg", *PCS, *CONTROLS, *DIMZ]
    used = ["product_id", "price", "n_reviews_total", "sentiment_z", *(c for c in scored if c not in LOGS)]
    return I.prepare(master(spark, sf).select(*used), scored, present=PCS)


@C.add("main_models")
def _(spark, sf):
    return rounded(I.main_models(complete(spark, sf), ROLES))


@C.add("outcome_variants_full")
def _(spark, sf):
    return rounded(I.outcome_variants(complete(spark, sf), ROLES, S_(YS)))


@C.add("decomp_pvalues")
def _(spark, sf):
    return rounded(I.decomposition_pvalues(complete(spark, sf), ROLES, S_(DIMZ)))


@C.add("vif_specs")
def _(spark, sf):
    d = complete(spark, sf)
    sets = {"controls": ROLES.controls, "full_mediation": ROLES.full, "decomposition": (*ROLES.x, *S_(DIMZ), *ROLES.controls)}
    parts = [R.vif(d, x, name) for name, x in sets.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@C.add("single_factor_full")
def _(spark, sf):
    return rounded(R.single_factor(complete(spark, sf), [*DIMZ, "sentiment_z"]))


FOCAL = {
    "M1_main_density": ["m_f_avg_s"],
    "M2_strict_polarity": ["polarity_s"],
    "M3_polarity_intensity": ["polarity_s", "intensity_s"],
    "M4_polarity_coverage": ["polarity_s", "coverage_any_s"],
    "M5_full_decomposition": ["polarity_s", "intensity_s", "coverage_any_s"],
    "S1_abs_density": ["polarity_s", "abs_density_s"],
    "S2_pooled_full": ["polarity_pooled_s", "intensity_pooled_s", "coverage_any_s"],
}


@shared("with_metrics")
def with_metrics(spark, sf):
    extra = ["abs_density_s", "polarity_s", "intensity_s", "coverage_any_s", "polarity_pooled_s", "intensity_pooled_s"]
    measures = metrics(spark, sf, totals(spark, sf), profiles(spark, sf), by_dimension=False).select("product_id", *extra)
    return pin(complete(spark, sf).join(measures.hint("merge"), "product_id", "left"))


@C.add("ols_model_specs")
def _(spark, sf):
    return rounded(I.model_specs(with_metrics(spark, sf), ROLES, FOCAL))


@C.add("a_paths_full")
def _(spark, sf):
    return rounded(I.a_paths(with_metrics(spark, sf), ROLES, ["m_f_avg_s", "polarity_s", "intensity_s", "coverage_any_s"]))


@C.add("core_paths")
def _(spark, sf):
    return rounded(I.core_paths(complete(spark, sf), ROLES, "z_pc3_s", "z_pc6_s"))


@C.add("sensitivity_long")
def _(spark, sf):
    return rounded(I.sensitivity(complete(spark, sf), ROLES, "z_pc3_s", "z_pc6_s", "n_reviews_total", [20, 25, 30], "n_reviews_total"))


@C.add("volume_summary")
def _(spark, sf):
    return rounded(I.volume_summary(complete(spark, sf), ROLES, "z_pc3_s", "z_pc6_s", "n_reviews_total", [20, 25, 30], "n_reviews_total"))


@C.add("indirect_components_boot")
def _(spark, sf):
    return rounded(I.component_summary(with_metrics(spark, sf), ROLES, ["polarity_s", "intensity_s", "coverage_any_s"], 200, SEED, ["product_id"]))


@C.add("joint_significance_table")
def _(spark, sf):
    return rounded(I.joint_table(complete(spark, sf), ROLES, 200, SEED, ["product_id"]))
