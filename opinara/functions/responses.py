"""Parsing and validation of model responses with VARIANT, all inside one row.

Python's rules for the raw JSON are kept: ``1.0`` and ``true`` are accepted as
polarity 1, the text ``"1"`` is not; any non-empty text is a true ``negated``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip_fence, strip_ws


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def parse_matches(df: DataFrame, raw: str) -> DataFrame:
    """Add ``matches`` (array of variant, null on failure) and ``parse_error`` (null on success)."""
    body = strip_fence(F.col(raw))
    step = df.withColumn("_body", body)
    step = step.withColumn("_whole", F.try_parse_json("_body"))
    block = F.regexp_extract("_body", r"(?s)(\{.*\})", 1)
    step = step.withColumn("_block", F.when(F.col("_whole").isNull(), F.nullif(block, F.lit(""))))
    step = step.withColumn("_doc", F.coalesce(F.col("_whole"), F.try_parse_json("_block")))
    step = step.withColumn("_list", _get(F.col("_doc"), "$.matches"))
    error = (
        F.when(F.col(raw).isNull() | (F.col(raw) == ""), "empty")
        .when(F.col("_whole").isNull() & F.col("_block").isNull(), "no_json_block")
        .when(F.col("_doc").isNull(), "json_parse_fail")
        .when(~_type(F.col("_doc")).startswith("OBJECT") | F.col("_list").isNull(), "no_matches_key")
        .when(~_type(F.col("_list")).startswith("ARRAY"), "matches_not_list")
    )
    step = step.withColumn("parse_error", error)
    items = F.when(F.col("parse_error").isNull(), F.try_variant_get(F.col("_doc"), "$.matches", "array<variant>"))
    return step.withColumn("matches", items).drop("_body", "_whole", "_block", "_doc", "_list")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def polarity_value(v: Column) -> Column:
    """-1, 0 or 1 when the element holds such a number or boolean, else null."""
    p = _get(v, "$.polarity")
    kind = _type(p)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$.polarity", "boolean").cast("double")).when(
        (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
        F.try_variant_get(v, "$.polarity", "double"),
    )
    return F.when(number.isin(-1.0, 0.0, 1.0), number.cast("int"))


def truthy(v: Column, path: str) -> Column:
    """Truth value of any JSON value; missing and null are false, non-empty text is true."""
    x = _get(v, path)
    kind = _type(x)
    text = F.try_variant_get(v, path, "string")
    return (
        F.when(x.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
        .when(kind == "STRING", F.length(text) > 0)
        .when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double") != 0)
        .otherwise(~text.isin("[]", "{}"))
    )


def match_defaults(v: Column) -> tuple[Column, Column]:
    """(degree_word, negated) with their defaults '' and false."""
    word = F.when(truthy(v, "$.degree_word"), F.coalesce(_text(v, "$.degree_word"), F.lit(""))).otherwise("")
    return word, truthy(v, "$.negated")


def _typed(v: Column, text: Column, dims: Sequence[str]) -> Column:
    """One element as a typed match plus its verdict ``ok``."""
    span, dim = _text(v, "$.span"), _text(v, "$.dimension")
    word, negated = match_defaults(v)
    polarity = polarity_value(v)
    ok = (
        _type(v).startswith("OBJECT")
        & (_type(_get(v, "$.dimension")) == "STRING")
        & dim.isin(*dims)
        & (_type(_get(v, "$.span")) == "STRING")
        & (F.length(span) > 0)
        & polarity.isNotNull()
        & F.contains(text, span)
    )
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.struct(
            dim.alias("dimension"),
            span.alias("span"),
            polarity.alias("polarity"),
            word.alias("degree_word"),
            negated.alias("negated"),
        ).alias("match"),
    )


def validate_matches(df: DataFrame, text: str, dims: Sequence[str], matches: str = "matches") -> DataFrame:
    """Add ``valid`` (array of typed matches) and ``n_invalid``.

    Kept: objects whose span is non-empty text found in the review, with a known
    dimension and a polarity of -1, 0 or 1.
    """
    items = F.coalesce(F.col(matches), F.array().cast("array<variant>"))
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_typed", F.transform(items, lambda v: _typed(v, body, dims)))
    valid = F.transform(F.filter("_typed", lambda t: t["ok"]), lambda t: t["match"])
    out = out.withColumn("valid", valid)
    return out.withColumn("n_invalid", F.size("_typed") - F.size("valid")).drop("_typed")


def explode_matches(df: DataFrame, keep: Sequence[str], col: str = "valid") -> DataFrame:
    """One row per match with its position ``match_id``."""
    # The outer form keeps the optimiser from inferring a filter on the array's
    # size, which would parse every response a second time below the scan.
    rows = df.select(*keep, F.posexplode_outer(col).alias("match_id", "_m")).filter(F.col("match_id").isNotNull())
    return rows.select(*keep, "match_id", "_m.*")


def usage_tokens(usage: Column) -> Column:
    """Cached prompt tokens from a usage JSON.

    ``prompt_tokens_details`` is used when it is an object or absent; only when it
    is present as something else do the flat fallback fields count.
    """
    doc = F.try_parse_json(usage)
    details = _get(doc, "$.prompt_tokens_details")
    nested = F.coalesce(F.try_variant_get(doc, "$.prompt_tokens_details.cached_tokens", "long"), F.lit(0))
    flat = F.coalesce(
        F.try_variant_get(doc, "$.cached_tokens", "long"),
        F.try_variant_get(doc, "$.prompt_cache_hit_tokens", "long"),
        F.try_variant_get(doc, "$.input_cache_hit_tokens", "long"),
        F.lit(0),
    )
    use_nested = details.isNull() | _type(details).startswith("OBJECT")
    return F.when(usage.isNull() | doc.isNull(), F.lit(0).cast("long")).when(use_nested, nested).otherwise(flat)


def usage_count(usage: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(usage), f"$.{field}", "long"), F.lit(0).cast("long"))


def checkpoint_rows(df: DataFrame, dims: Sequence[str], text: str = "text", raw: str = "raw", usage: str = "usage") -> DataFrame:
    """Raw responses to checkpoint rows: counts, token usage, error code and valid matches."""
    parsed = validate_matches(parse_matches(df, raw), text, dims)
    blank = F.coalesce(F.length(strip_ws(F.col(text))), F.lit(0)) == 0
    error = F.when(blank, "empty_text").otherwise(F.coalesce("parse_error", F.lit("")))
    zero = F.lit(0).cast("long")
    good = error == ""
    none = F.array().cast("array<struct<dimension:string,span:string,polarity:int,degree_word:string,negated:boolean>>")
    return parsed.withColumns(
        {
            "error": error,
            "n_matches": F.when(good, F.size("valid")).otherwise(0),
            "n_invalid_spans": F.when(good, F.col("n_invalid")).otherwise(0),
            "valid": F.when(good, F.col("valid")).otherwise(none),
            "in_tokens": F.when(blank, zero).otherwise(usage_count(F.col(usage), "prompt_tokens")),
            "cached_tokens": F.when(blank, zero).otherwise(usage_tokens(F.col(usage))),
            "out_tokens": F.when(blank, zero).otherwise(usage_count(F.col(usage), "completion_tokens")),
        }
    ).drop("matches", "parse_error", "n_invalid")
