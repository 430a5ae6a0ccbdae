"""Numeric and label expressions used by the scoring and inference plans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip_ws

FULL_WIDTH = "０１２３４５６７８９．－"
HALF_WIDTH = "0123456789.-"

DEFAULT_DEGREE_WEIGHT = 0.8
LOGIT_EPSILON = 0.001


def finite(col: Column) -> Column:
    """NaN and infinities become null (null is the only missing value downstream)."""
    # NaN sorts above infinity, so one comparison rejects all three kinds of bad value.
    return F.when(F.abs(col) < float("inf"), col)


def to_double(col: Column) -> Column:
    """Text to double; bad text, NaN and infinities become null."""
    return finite(col.try_cast("double"))


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in cols})


def inf_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in cols})


def map_label(col: Column, mapping: Mapping[str, str]) -> Column:
    """Label to code; labels outside the mapping give null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(col, F.lit("")))


def degree_weight(word: Column, weights: Mapping[str, float], default: float = DEFAULT_DEGREE_WEIGHT) -> Column:
    """Weight of a degree word; null, empty and unknown words get ``default``."""
    table = F.create_map(*[F.lit(x) for w, v in weights.items() for x in (w, float(v))])
    return F.coalesce(F.try_element_at(table, F.coalesce(strip_ws(word), F.lit(""))), F.lit(default))


def signed_value(polarity: Column, weight: Column, negated: Column) -> Column:
    sign = F.when(F.coalesce(negated, F.lit(False)), -1.0).otherwise(1.0)
    return sign * polarity * weight


def unsigned_value(polarity: Column, weight: Column) -> Column:
    return polarity.cast("double") * weight


def logit(p: Column, eps: float = LOGIT_EPSILON) -> Column:
    return F.log((p + eps) / (1.0 - p + eps))


def log_plus(x: Column, c: float = 1.0) -> Column:
    return F.log(x + c)


def log_clip(x: Column, lower: float = 1.0) -> Column:
    """``ln(max(x, lower))``; a null stays null (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(float(lower)))))


def log1p_count(n: Column) -> Column:
    return F.log1p(n)


def parse_score(text: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """First number in the text, clamped to [lo, hi]; null when there is none."""
    number = F.regexp_extract(F.translate(text, FULL_WIDTH, HALF_WIDTH), r"(-?[0-9]+\.?[0-9]*)", 1)
    value = number.try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), value)))


def tri_class(x: Column, neg: float = -0.1, pos: float = 0.1) -> Column:
    return F.when(x > pos, "pos").when(x < neg, "neg").when(x.isNotNull(), "neu")


def composites(df: DataFrame, a: str, b: str, weights: Mapping[str, float]) -> DataFrame:
    """One column per weighting ``w*a + (1-w)*b``; weights 1 and 0 copy a and b."""
    out = {}
    for name, w in weights.items():
        if w == 1:
            out[name] = F.col(a)
        elif w == 0:
            out[name] = F.col(b)
        else:
            out[name] = F.lit(float(w)) * F.col(a) + F.lit(float(round(1 - w, 12))) * F.col(b)
    return df.withColumns(out)


def at_least(df: DataFrame, col: str, thresholds: Iterable[int], prefix: str = "ge_") -> DataFrame:
    return df.withColumns({f"{prefix}{t}": F.col(col) >= F.lit(t) for t in thresholds})


def stars(p: Column, none: str = "") -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").when(p.isNotNull(), none)


def vif_flag(v: Column) -> Column:
    return F.when(v >= 10, "SEVERE(>=10)").when(v >= 5, "elevated(5-10)").when(v.isNotNull(), "")


def verdict(flag: Column, yes: str, no: str) -> Column:
    return F.when(flag, yes).otherwise(no)


def ratio(num: Column, den: Column) -> Column:
    """Share; a zero or null denominator gives null instead of an error."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean across columns, nulls skipped; null when every column is null."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.try_divide(total, row_nonnull(cols).cast("double"))


def row_nonnull(cols: Sequence[Column]) -> Column:
    n = F.lit(0)
    for c in cols:
        n = n + c.isNotNull().cast("int")
    return n


def joint_p(pa: Column, pb: Column) -> Column:
    """Joint significance: both paths must be significant, so the larger p counts."""
    return F.when(pa.isNotNull() & pb.isNotNull(), F.greatest(pa, pb))
