"""Streaming ingestion of model responses.

Responses arrive as files. Parsing and validation are stateless and reach the
Parquet sink exactly once; running scores keep per-batch partial sums that a
reader adds up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.responses import checkpoint_rows, explode_matches
from ..functions.scalars import DEFAULT_DEGREE_WEIGHT, ratio
from ..operators.scoring import with_final_value
from ..operators.sketches import distinct_estimates, distinct_sketches, merged_sketches
from ..schemas import RAW_RESPONSES
from .ledger import Ledger


def read_responses(spark: SparkSession, in_dir: str, schema=RAW_RESPONSES, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(in_dir)


def stream_validate(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    dims: Sequence[str],
    schema=RAW_RESPONSES,
    max_files: int | None = None,
) -> None:
    """Process every response file not yet processed: checkpoint rows with their valid matches."""
    rows = checkpoint_rows(read_responses(spark, in_dir, schema, max_files), dims).drop("raw", "usage", "text")
    query = (
        rows.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_scores(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    dims: Mapping[str, str],
    weights: Mapping[str, float],
    apply_negation: bool,
    schema=RAW_RESPONSES,
    key: str = "product_id",
    max_files: int | None = None,
    default: float = DEFAULT_DEGREE_WEIGHT,
    buckets: int = 16,
    comment: str | None = None,
) -> None:
    """Append per-batch partial sums (key, code, sum_value, n_mentioning).

    A response holds all matches of its comment, so the comment mean needs no
    state. A repeated response counts once: a batch leaves out the row ids of
    earlier batches, which the :class:`.ledger.Ledger` beside ``out_dir`` finds
    without reading them whole, and of repeats within a batch the one with the
    smallest hash stays. Nothing is kept in a state store; ids lie on disk only.
    A batch writes sums and ids to folders of its own, so a replayed batch
    overwrites itself.

    ``comment`` names the comment of a response, where a comment may come in
    several responses: a sketch of the distinct comments with a mention is then
    kept beside the sums (:func:`running_comments`).
    """
    stream = read_responses(spark, in_dir, schema, max_files)
    id_type = next(f.dataType.simpleString() for f in stream.schema.fields if f.name == "row_id")
    ledger = Ledger(spark, f"{out_dir}_ledger", "row_id", id_type, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = ledger.unseen(batch, batch_id)
        one = new.groupBy("row_id").agg(F.min_by(F.struct(*new.columns), F.xxhash64(*new.columns)).alias("r")).select("r.*")
        valid = checkpoint_rows(one, list(dims))
        rows = explode_matches(valid, ["row_id", key, *([comment] if comment else [])])
        values = with_final_value(rows, weights, apply_negation, default)
        per_comment = values.groupBy(key, "row_id", "dimension").agg(F.avg("final_value").alias("v"))
        part = per_comment.groupBy(key, "dimension").agg(
            F.sum("v").alias("sum_value"), F.count(F.lit(1)).alias("n_mentioning")
        )
        part.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        if comment:
            distinct_sketches(values, [key, "dimension"], comment).write.mode("overwrite").parquet(f"{out_dir}_comments/batch_id={batch_id}")
        ledger.add(batch, batch_id)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def running_comments(spark: SparkSession, out_dir: str, key: str = "product_id") -> DataFrame:
    """Estimated distinct comments with a mention, by (key, dimension), from the sketches of all batches so far."""
    parts = spark.read.parquet(f"{out_dir}_comments")
    return distinct_estimates(merged_sketches(parts, [key, "dimension"]), out="n_comments")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("sum_value", "n_mentioning")]


def compact_scores(spark: SparkSession, out_dir: str, to_dir: str, key: str = "product_id") -> None:
    """Write the sums of all batches so far to ``to_dir``, a new folder, with the last batch they cover."""
    parts = spark.read.parquet(out_dir)
    upto = parts.agg(F.max("batch_id")).first()[0]
    sums = parts.filter(F.col("batch_id") <= upto).groupBy(key, "dimension").agg(*_sums())
    sums.withColumn("upto", F.lit(upto)).write.parquet(to_dir)


def running_scores(
    spark: SparkSession, out_dir: str, totals: DataFrame, key: str = "product_id", compacted: str | None = None
) -> DataFrame:
    """Scores and coverage from all partial sums written so far; with ``compacted``, only later batches are read."""
    parts = spark.read.parquet(out_dir)
    if compacted:
        whole = spark.read.parquet(compacted)
        upto = whole.agg(F.max("upto")).first()[0]
        if upto is not None:
            later = parts.filter(F.col("batch_id") > upto)
            parts = later.drop("batch_id").unionByName(whole.drop("upto"))
    parts = parts.groupBy(key, "dimension").agg(*_sums())
    out = parts.join(totals, key, "left")
    n = F.col("n_total")
    return out.select(
        key,
        "dimension",
        ratio(F.col("sum_value"), n).alias("score"),
        ratio(F.col("n_mentioning"), n).alias("coverage"),
    )
