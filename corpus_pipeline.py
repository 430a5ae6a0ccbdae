"""Documents to packed training sequences in five stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import mixing, packing, quality, simhash, substring_dedup
from opinara.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's fertility bands."""
    return quality.quality_filter(docs, scratch_path(spark, "bands"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at three or fewer bits of fingerprints of 3-word shingles."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of passages that occur elsewhere; texts without such words stay as they are.

    ``n_chars``, where there is such a column, follows a changed text. A text that goes whole stays as an empty row.
    """
    was = "text_as_it_was"
    out = substring_dedup.drop_repeats(docs.withColumn(was, F.col("text")))
    changed = F.col("n_removed") > 0
    columns = {"text": F.when(changed, F.col("text")).otherwise(F.col(was))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 3, 1, 2: a row for each copy taken, a part at the end of a run cut short.

    ``n_chars``, where there is such a column, is the length of the text in the row.
    """
    out = mixing.mix(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens, ids included."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Tokeniser ids, fingerprints and fertility are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
