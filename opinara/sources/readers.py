"""Readers. Text comes in as text; coercion is a separate, explicit step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import product_id_from_name


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Parquet rows for heavy per-row work.

    A file with few row groups gives few tasks; then rows are spread over the
    cores by ``key``. Inputs that already have enough splits are not shuffled.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header as RFC 4180 has it: quotes are doubled and quoted fields may hold line breaks.

    A UTF-8 byte-order mark is dropped. Without schema all columns are text; an empty field is null. A file that may hold quoted line
    breaks cannot be split: one task reads it. Use many files, or Parquet, for large tables.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def reviews_from(df: DataFrame, file_col: str, row_id: str) -> DataFrame:
    """All-text review rows with an explicit row id and the product id taken from the file name."""
    text = [F.col(c).cast("string").alias(c) for c in df.columns if c != row_id]
    named = df.select(F.col(row_id).cast("long").alias("row_id"), *text)
    return named.withColumn("product_id", product_id_from_name(F.col(file_col)))


def read_reviews(
    spark: SparkSession, path: str, file_col: str, row_id: str, fmt: str = "parquet", columns: Sequence[str] = ()
) -> DataFrame:
    """Review table from Parquet or CSV.

    ``row_id`` names the column that fixes the row order: files carry no order
    that survives a distributed read.
    """
    df = read_table(spark, path) if fmt == "parquet" else read_csv(spark, path)
    keep = [c for c in df.columns if c != row_id and (not columns or c in columns)]
    return reviews_from(df.select(row_id, *keep), file_col, row_id)


def read_weight_lexicon(spark: SparkSession, path: str, field: str = "weight_lookup") -> DataFrame:
    """JSON object ``{field: {word: weight}}`` to (word, weight); ``_``-prefixed entries are notes."""
    raw = spark.read.text(path, wholetext=True)
    table = F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,double>")
    rows = raw.select(F.explode(table).alias("word", "weight"))
    return rows.filter(~F.col("word").startswith("_"))


def read_word_list(spark: SparkSession, path: str, field: str) -> DataFrame:
    """JSON array of words at ``field`` (dots go deeper) to one column ``word``; a missing field gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json(F.get_json_object("value", f"$.{field}"), "array<string>")).alias("word"))


SEED_ENTRY = "struct<positive_seeds:array<string>,negative_seeds:array<string>,trigger_words:array<string>,exclude_words:array<string>,excluded_words:array<string>>"


def read_seed_lexicon(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Nested dictionary to (family, dimension, seed, polarity, excluded).

    Positive and negative seeds carry +1 and -1; trigger words, whose polarity
    depends on the sentence, carry 0.
    """
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", f"map<string,{SEED_ENTRY}>")).alias("dimension", "e"))
    entries = entries.filter(~F.col("dimension").startswith("_"))
    kinds = [
        ("positive_seeds", 1, False),
        ("negative_seeds", -1, False),
        ("trigger_words", 0, False),
        ("exclude_words", 0, True),
        ("excluded_words", 0, True),
    ]

    def block(name: str, polarity: int, excluded: bool) -> Column:
        words = F.coalesce(F.col(f"e.{name}"), F.array().cast("array<string>"))
        return F.transform(
            words, lambda s: F.struct(s.alias("seed"), F.lit(polarity).alias("polarity"), F.lit(excluded).alias("excluded"))
        )

    blocks = [block(*k) for k in kinds]
    rows = entries.select(F.lit(family).alias("family"), "dimension", F.inline(F.concat(*blocks)))
    return rows.distinct()


def prompt_rows(nested: DataFrame, concept: str = "concept_id", prompts: str = "prompts") -> DataFrame:
    """(concept, map polarity -> array of texts) to one row per prompt, index from 1."""
    by_polarity = nested.select(F.col(concept).alias("concept_id"), F.explode(prompts).alias("prompt_polarity", "texts"))
    rows = by_polarity.select("concept_id", "prompt_polarity", F.posexplode("texts").alias("pos", "prompt_text"))
    return rows.select("concept_id", "prompt_polarity", (F.col("pos") + 1).alias("prompt_index"), "prompt_text")


def file_inventory(spark: SparkSession, directory: str, suffixes: Sequence[str]) -> DataFrame:
    """Files below a directory by suffix (any case): id = file stem, path, suffix, size. Content is not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length")
    )
    wanted = [s.lower() for s in suffixes]
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("item_id"),
        name.alias("file_name"),
        F.col("path").alias("file_path"),
        F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"),
        F.col("length").alias("n_bytes"),
    )
    return out.filter(F.col("suffix").isin(*wanted))


def cols_like(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def clean_names(df: DataFrame) -> DataFrame:
    """Lower-case names; characters other than letters, digits and ``_`` become ``_``."""
    names = ["".join(ch if ch.isalnum() or ch == "_" else "_" for ch in c.lower()) for c in df.columns]
    return df.toDF(*names)
