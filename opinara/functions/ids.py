"""Product-id normalisers. Each input convention has its own named variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws


def product_id_from_name(name: Column) -> Column:
    """Leading ``digits-digits`` of a file name, null when absent."""
    return F.nullif(F.regexp_extract(name, r"^([0-9]+-[0-9]+)", 1), F.lit(""))


def norm_id_dashes(col: Column) -> Column:
    """Four dash variants become ``-``; ideographic and plain spaces go; null becomes ''."""
    return F.coalesce(F.translate(strip_ws(col), "—–－‐　 ", "----"), F.lit(""))


def norm_id_digits(col: Column) -> Column:
    """First two digit runs as integers, ``a-b``; other text is kept, dashes unified."""
    text = F.translate(strip_ws(col), "—–", "--")
    runs = F.regexp_extract_all(text, F.lit("([0-9]+)"), 1)
    plain = F.transform(runs, lambda r: F.regexp_replace(r, "^0+([0-9])", "$1"))
    return F.when(F.size(runs) >= 2, F.concat_ws("-", plain[0], plain[1])).otherwise(text)


def norm_id_paren(col: Column) -> Column:
    """``(n)`` becomes ``n``, repeated dashes collapse; null unless ``digits-digits``."""
    text = F.regexp_replace(strip_ws(col), r"\(([0-9]+)\)", "$1")
    text = F.regexp_replace(text, "-+", "-")
    return F.when(text.rlike("^[0-9]+-[0-9]+$"), text)


def norm_id_two_dash(col: Column) -> Column:
    """Two dash variants become ``-``, then outer whitespace goes."""
    return strip_ws(F.translate(col, "—–", "--"))
