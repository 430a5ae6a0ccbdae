"""Weighted opinion scores: match -> comment -> product.

Every step is a decomposable aggregate, so Spark combines map-side and a
product holding a large share of the rows does not end up in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.text import strip_ws

#: Reviews of a product that one task adds up; the comments of a product with more are dealt to several.
SHARE_ROWS = 1 << 16
#: Rows of a task of :func:`joint_profile`: what it holds does not grow with the table.
TASK_ROWS = 1 << 18


def with_degree_weight(
    df: DataFrame, weights: Mapping[str, float], word: str = "degree_word", default: float = S.DEFAULT_DEGREE_WEIGHT
) -> DataFrame:
    return df.withColumn("degree_weight", S.degree_weight(F.col(word), weights, default))


def with_degree_lexicon(
    df: DataFrame, lexicon: DataFrame, word: str = "degree_word", default: float = S.DEFAULT_DEGREE_WEIGHT
) -> DataFrame:
    """Degree weights from a table (``word, weight``) of any size; a word listed twice takes its largest weight.

    Null, empty and unknown words get ``default``. The plan decides whether the lexicon is broadcast.
    """
    known = lexicon.groupBy(strip_ws(F.col("word")).alias("_word")).agg(F.max("weight").cast("double").alias("_weight"))
    joined = df.join(known, strip_ws(F.col(word)) == F.col("_word"), "left")
    return joined.withColumn("degree_weight", F.coalesce("_weight", F.lit(default))).drop("_word", "_weight")


def with_final_value(
    df: DataFrame,
    weights: Mapping[str, float],
    apply_negation: bool,
    default: float = S.DEFAULT_DEGREE_WEIGHT,
) -> DataFrame:
    """Add ``final_value``; affective matches flip on ``negated``, functional ones do not."""
    w = S.degree_weight(F.col("degree_word"), weights, default)
    if apply_negation:
        value = S.signed_value(F.col("polarity"), w, F.col("negated"))
    else:
        value = S.unsigned_value(F.col("polarity"), w)
    return df.withColumn("final_value", value)


def map_codes(df: DataFrame, col: str, mapping: Mapping[str, str], out: str = "code") -> DataFrame:
    """Keep rows whose label is in ``mapping`` and add its code."""
    return df.withColumn(out, S.map_label(F.col(col), mapping)).filter(F.col(out).isNotNull())


def n_total(df: DataFrame, key: str = "product_id") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_total"))


def comment_mean(df: DataFrame, keys: Sequence[str], value: str = "final_value") -> DataFrame:
    """Mean value per key combination; rows with a null key are dropped."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(value).alias(value))


def density(cm: DataFrame, totals: DataFrame, key: str = "product_id", dim: str = "code") -> DataFrame:
    """Sum of comment means over all reviews of the product."""
    sums = cm.groupBy(key, dim).agg(F.sum("final_value").alias("sum_value"))
    return sums.join(totals, key, "left").withColumn("score", S.ratio(F.col("sum_value"), F.col("n_total")))


def coverage(
    df: DataFrame,
    totals: DataFrame,
    key: str = "product_id",
    dim: str = "code",
    comment: str = "comment_id",
    approx: bool = False,
) -> DataFrame:
    """Share of a product's reviews that mention the dimension."""
    distinct = F.approx_count_distinct(comment) if approx else F.count_distinct(F.col(comment))
    n = df.dropna(subset=[key, dim]).groupBy(key, dim).agg(distinct.alias("n_mentioning"))
    return n.join(totals, key, "left").withColumn("coverage", S.ratio(F.col("n_mentioning"), F.col("n_total")))


def any_coverage(df: DataFrame, totals: DataFrame, key: str = "product_id", comment: str = "comment_id") -> DataFrame:
    """Share of reviews with a match in any dimension; products without matches get 0."""
    n = df.dropna(subset=[key]).groupBy(key).agg(F.count_distinct(F.col(comment)).alias("n_any"))
    out = totals.join(n, key, "left").fillna(0, subset=["n_any"])
    return out.withColumn("coverage_any", S.ratio(F.col("n_any"), F.col("n_total")))


def to_wide(
    df: DataFrame, key: str, dim: str, value: str, dims: Sequence[str], prefix: str = "", fill: float | None = 0.0
) -> DataFrame:
    """Long to wide with a fixed column list, one row per key."""
    aggs = [F.max(F.when(F.col(dim) == d, F.col(value))).alias(f"{prefix}{d}") for d in dims]
    wide = df.groupBy(key).agg(*aggs)
    return wide if fill is None else wide.fillna(fill, subset=[f"{prefix}{d}" for d in dims])


def fill_dims(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Add absent columns and replace nulls by ``value``."""
    present = set(df.columns)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(value)) if c in present else F.lit(value) for c in cols}
    )


def comment_cells(
    matches: DataFrame, key: str = "product_id", comment: str = "comment_id", dim: str = "code"
) -> DataFrame:
    """Mean value ``v`` per (product, comment, dimension); rows with a null key are dropped."""
    keys = [key, comment, dim]
    return matches.dropna(subset=keys).groupBy(*keys).agg(F.avg("final_value").alias("v"))


def by_share(rows: DataFrame, totals: DataFrame, key: str, comment: str, partitions: int | None = None) -> DataFrame:
    """Rows shuffled by product and ``_share``, a group of a product's comments.

    Nearly every comment has one row, so nothing is gained by adding up before the shuffle: it would only sort and
    spill all rows. After it, comments are whole in a task, and sums of a product's comments shrink before they are
    shuffled again: to one row a product, as most have a single share. Only products with more than ``SHARE_ROWS``
    reviews have more and are spread over as many tasks; there are at most ``1 / SHARE_ROWS`` as many as reviews, so
    their list is broadcast.
    """
    shares = F.ceil(F.max("n_total") / F.lit(SHARE_ROWS)).alias("_shares")
    hot = totals.filter(F.col("n_total") > SHARE_ROWS).groupBy(F.col(key).alias("_hot")).agg(shares)
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    share = F.when(F.col("_shares").isNotNull(), F.pmod(F.xxhash64(comment), F.col("_shares"))).otherwise(F.lit(0))
    # By number, because joined partitions would no longer fit in a task's memory.
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*rows.columns, share.cast("int").alias("_share")).repartition(n, key, "_share")


def wide_scores(
    matches: DataFrame,
    totals: DataFrame,
    dims: Sequence[str],
    key: str = "product_id",
    comment: str = "comment_id",
    dim: str = "code",
) -> DataFrame:
    """Scores and coverages of all dimensions, every product of ``totals``, absent = 0.

    Two shuffles: rows by share of a product, then products. A cell already stands for one
    comment, so counting cells is the distinct count and the pivot is a set of
    conditional sums in the same aggregate.
    """
    aggs: list[Column] = []
    for d in dims:
        hit = F.col(dim) == d
        aggs += [F.sum(F.when(hit, F.col("v"))).alias(d), F.count_if(hit).alias(f"cov_{d}")]
    keys = [key, comment, dim]
    rows = by_share(matches.dropna(subset=keys).select(*keys, "final_value"), totals, key, comment)
    cells = rows.groupBy(key, "_share", comment, dim).agg(F.avg("final_value").alias("v"))
    per_product = cells.groupBy(key).agg(*aggs)
    wide = totals.join(per_product, key, "left")
    cols = [*dims, *[f"cov_{d}" for d in dims]]
    return wide.withColumns({c: F.coalesce(S.ratio(F.col(c), F.col("n_total")), F.lit(0.0)) for c in cols})


def product_profile(
    matches: DataFrame,
    totals: DataFrame,
    dims: Sequence[str],
    key: str = "product_id",
    comment: str = "comment_id",
    dim: str = "code",
) -> DataFrame:
    """Per product: ``n_any`` and per dimension ``<d>_sum``, ``<d>_abs``, ``<d>_h`` over comment means.

    One scan and two shuffles for every measure: one row per comment holds the
    means of all dimensions, so distinct comments are a plain count.
    """
    rows = by_share(matches.dropna(subset=[key, comment, dim]).select(key, comment, dim, "final_value"), totals, key, comment)
    means = [F.avg(F.when(F.col(dim) == d, F.col("final_value"))).alias(d) for d in dims]
    comments = rows.groupBy(key, "_share", comment).agg(*means)
    aggs = [F.count(F.lit(1)).alias("n_any")]
    for d in dims:
        aggs += [
            F.coalesce(F.sum(d), F.lit(0.0)).alias(f"{d}_sum"),
            F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias(f"{d}_abs"),
            F.count(d).alias(f"{d}_h"),
        ]
    out = totals.join(comments.groupBy(key).agg(*aggs), key, "left")
    return out.fillna(0, subset=[c for c in out.columns if c not in (key, "n_total")])


def joint_profile(
    matches: DataFrame,
    totals: DataFrame,
    families: Mapping[str, tuple[str, str, Sequence[str]]],
    key: str = "product_id",
    comment: str = "comment_id",
) -> DataFrame:
    """:func:`product_profile` of several families of dimensions of the same matches, from one shuffle of the rows.

    ``families``: name to the columns of code and value and the codes, at most 63 and different between families. A
    row takes part in the families whose code it has. Per family ``n_any_<name>``, per dimension besides ``<d>_sum``,
    ``<d>_abs`` and ``<d>_h`` the comments that mention it, ``<d>_cells``. Select what is needed before writing: the
    rest is then not computed. ``totals`` is read three times, so let it be pinned.
    """
    codes = [d for _, _, dims in families.values() for d in dims]
    if len(set(codes)) < len(codes) or any(len(dims) > 63 for _, _, dims in families.values()):
        raise ValueError("codes must differ between families, at most 63 in each")
    known = functools.reduce(lambda a, b: a | b, [F.col(code).isNotNull() for code, _, _ in families.values()])
    parts, means, aggs = [], [], []
    for name, (code, value, dims) in families.items():
        # A code becomes a bit: a comment's dimensions are one number, and an unlisted code is none of them.
        bits = {d: F.lit(1 << i).cast("long") for i, d in enumerate(dims)}
        bit = functools.reduce(lambda c, d: c.when(F.col(code) == d, bits[d]), dims[1:], F.when(F.col(code) == dims[0], bits[dims[0]]))
        parts += [F.when(F.col(code).isNotNull(), bit.otherwise(F.lit(0).cast("long"))).alias(f"_bit_{name}"), F.col(value).alias(f"_value_{name}")]
        means.append(F.bit_or(f"_bit_{name}").alias(f"_bits_{name}"))
        aggs.append(F.count(f"_bits_{name}").alias(f"n_any_{name}"))
        for d in dims:
            means.append(F.avg(F.when(F.col(f"_bit_{name}") == bits[d], F.col(f"_value_{name}"))).alias(d))
            aggs += [
                F.coalesce(F.sum(d), F.lit(0.0)).alias(f"{d}_sum"),
                F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias(f"{d}_abs"),
                F.count(d).alias(f"{d}_h"),
                F.count_if(F.col(f"_bits_{name}").bitwiseAND(bits[d]) != 0).alias(f"{d}_cells"),
            ]
    least = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = -(-(totals.agg(F.sum("n_total")).first()[0] or 0) // TASK_ROWS)
    rows = by_share(matches.dropna(subset=[key, comment]).filter(known).select(key, comment, *parts), totals, key, comment, max(least, tasks))
    per_product = rows.groupBy(key, "_share", comment).agg(*means).groupBy(key).agg(*aggs)
    out = totals.join(per_product, key, "left")
    return out.fillna(0, subset=[c for c in out.columns if c not in (key, "n_total")])


def wide_of(profile: DataFrame, dims: Sequence[str], key: str = "product_id") -> DataFrame:
    """The columns of :func:`wide_scores` out of a :func:`joint_profile`."""
    ratio = lambda c: F.coalesce(S.ratio(F.col(c), F.col("n_total")), F.lit(0.0))
    cols = [c for d in dims for c in (ratio(f"{d}_sum").alias(d), ratio(f"{d}_cells").alias(f"cov_{d}"))]
    return profile.select(key, "n_total", *cols)


def decompose(
    matches: DataFrame,
    totals: DataFrame,
    dims: Sequence[str],
    key: str = "product_id",
    comment: str = "comment_id",
    dim: str = "code",
) -> DataFrame:
    """Dense product x dimension grid with density, absolute density, coverage, polarity, intensity.

    Polarity and intensity stay null where the product has no match.
    """
    cells = comment_cells(matches, key, comment, dim)
    stats = cells.groupBy(key, dim).agg(
        F.sum("v").alias("sum_signed"),
        F.count("v").alias("h"),
        F.avg("v").alias("polarity"),
        F.sum(F.abs("v")).alias("sum_abs"),
        F.avg(F.abs("v")).alias("intensity"),
    )
    grid = totals.withColumn(dim, F.explode(F.array(*[F.lit(d) for d in dims])))
    out = grid.join(stats, [key, dim], "left").fillna(0.0, subset=["sum_signed", "sum_abs"]).fillna(0, subset=["h"])
    n = F.col("n_total")
    return out.select(
        key,
        dim,
        "n_total",
        "h",
        S.ratio(F.col("sum_signed"), n).alias("density"),
        S.ratio(F.col("sum_abs"), n).alias("abs_density"),
        S.ratio(F.col("h"), n).alias("coverage"),
        "polarity",
        "intensity",
    )


def pooled(
    matches: DataFrame,
    totals: DataFrame,
    key: str = "product_id",
    comment: str = "comment_id",
    dim: str = "code",
) -> DataFrame:
    """Measures pooled over all (comment, dimension) cells of a product."""
    cells = comment_cells(matches, key, comment, dim)
    agg = cells.groupBy(key).agg(
        F.count("v").alias("pooled_h"),
        F.avg("v").alias("polarity_pooled"),
        F.avg(F.abs("v")).alias("intensity_pooled"),
        F.sum("v").alias("sum_signed"),
    )
    out = totals.join(agg, key, "left").fillna(0, subset=["pooled_h"]).fillna(0.0, subset=["sum_signed"])
    n = F.col("n_total")
    return out.select(
        key,
        "pooled_h",
        "polarity_pooled",
        "intensity_pooled",
        S.ratio(F.col("pooled_h"), n).alias("match_frequency"),
        S.ratio(F.col("sum_signed"), n).alias("signed_match_density"),
    )


def dim_diagnostics(dec: DataFrame, dim: str = "code") -> DataFrame:
    """Per dimension, over the dense grid of :func:`decompose`."""
    return dec.groupBy(dim).agg(
        F.count_if(F.col("h") > 0).alias("products_with_match"),
        F.count_if(F.col("h") == 0).alias("products_without_match"),
        F.sum("h").alias("matched_cells"),
        F.avg("coverage").alias("mean_coverage"),
        F.avg("polarity").alias("mean_polarity"),
        F.avg("intensity").alias("mean_intensity"),
    )


def crosscheck(df: DataFrame, a: str, b: str, observed: Sequence[str] = ()) -> DataFrame:
    """Largest absolute difference of two computations of one score, and missing counts."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in observed]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs_error"), *missing
    )


def polarity_counts(
    df: DataFrame, key: str = "product_id", polarity: str = "polarity", where: Column | None = None, prefix: str = ""
) -> DataFrame:
    """Match, positive, negative and neutral counts with their shares per product."""
    p = S.to_double(F.col(polarity).cast("string"))
    rows = df.withColumn("_p", p).filter(F.col("_p").isNotNull() & F.col(key).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}match_n"),
        F.count_if(F.col("_p") > 0).alias(f"{prefix}pos_n"),
        F.count_if(F.col("_p") < 0).alias(f"{prefix}neg_n"),
        F.count_if(F.col("_p") == 0).alias(f"{prefix}neu_n"),
    )
    n = F.col(f"{prefix}match_n")
    return out.withColumns(
        {
            f"{prefix}negative_ratio": S.ratio(F.col(f"{prefix}neg_n"), n),
            f"{prefix}positive_ratio": S.ratio(F.col(f"{prefix}pos_n"), n),
            f"{prefix}ln_neg_count": S.log1p_count(F.col(f"{prefix}neg_n")),
        }
    )


def polarity_totals(per_product: DataFrame, prefix: str = "") -> DataFrame:
    """One row of totals and shares over a product table with (filled) polarity counts."""
    c = lambda name: F.col(f"{prefix}{name}")
    return per_product.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.count_if(c("match_n") > 0).alias("products_with_matches"),
        F.sum(c("match_n")).alias("matches_total"),
        F.sum(c("pos_n")).alias("positive_total"),
        F.sum(c("neg_n")).alias("negative_total"),
        F.sum(c("neu_n")).alias("neutral_total"),
        S.ratio(F.sum(c("neg_n")), F.sum(c("match_n"))).alias("negative_share_total"),
        F.avg(c("negative_ratio")).alias("negative_ratio_product_mean"),
    )


def with_labels(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    return df.filter(F.col(col).isin(*labels))
