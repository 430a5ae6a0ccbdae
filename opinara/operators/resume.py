"""Resumable work: which rows are done, failed or new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import keep_last


def done_no_error(error: str = "error") -> Column:
    """Extraction rule: any non-empty error, also ``empty_text``, is tried again."""
    return F.coalesce(F.col(error), F.lit("")) == ""


def done_has_score(score: str = "sentiment_score") -> Column:
    """Sentiment rule: rows without a score are tried again."""
    return F.col(score).isNotNull()


def valid_checkpoint(checkpoint: DataFrame, key: str, seq: str, done_when: Column) -> DataFrame:
    """Latest row per key, only rows that count as done (the rewrite of the checkpoint)."""
    return keep_last(checkpoint, key, seq).filter(done_when)


def resume_plan(df: DataFrame, checkpoint: DataFrame, key: str, seq: str, done_when: Column) -> DataFrame:
    """Input keys with ``status``: done, failed (tried, to be retried) or new."""
    last = checkpoint.groupBy(key).agg(F.max_by(F.coalesce(done_when, F.lit(False)), F.col(seq)).alias("_done"))
    out = df.select(key).join(last, key, "left")
    status = F.when(F.col("_done").isNull(), "new").when(F.col("_done"), "done").otherwise("failed")
    return out.select(key, status.alias("status"))
