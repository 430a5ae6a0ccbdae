"""Explicit schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


RAW_RESPONSES = _struct(row_id=T.LongType(), text=T.StringType(), raw=T.StringType(), usage=T.StringType())

CHECKPOINT = _struct(
    row_id=T.LongType(),
    n_matches=T.IntegerType(),
    n_invalid_spans=T.IntegerType(),
    in_tokens=T.LongType(),
    cached_tokens=T.LongType(),
    out_tokens=T.LongType(),
    error=T.StringType(),
)

MATCH = _struct(
    dimension=T.StringType(),
    span=T.StringType(),
    polarity=T.IntegerType(),
    degree_word=T.StringType(),
    negated=T.BooleanType(),
)

MATCHES = _struct(
    row_id=T.LongType(),
    product_id=T.StringType(),
    comment_id=T.StringType(),
    match_id=T.IntegerType(),
    dimension=T.StringType(),
    span=T.StringType(),
    polarity=T.IntegerType(),
    degree_word=T.StringType(),
    negated=T.BooleanType(),
)

SENTIMENT = _struct(
    row_id=T.LongType(), product_id=T.StringType(), comment_id=T.StringType(), sentiment_score=T.DoubleType()
)


def visual_components(k: int = 7) -> T.StructType:
    return _struct(product_id=T.StringType(), **{f"z_pc{i}": T.DoubleType() for i in range(1, k + 1)})
