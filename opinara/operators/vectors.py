"""Concept centroids, concept scores and component scores over embedding tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, l2_normalize, vec_check
from ..session import pin
from .gram import sum_partials

#: Vectors and centroids of a block, centroid blocks that a vector block meets in one place, rows of one result frame.
VECTOR_BLOCK, CENTROID_BLOCK, COLUMN_BLOCKS, OUTPUT_ROWS = 1024, 512, 16, 1 << 16


def centroids(df: DataFrame, vec: str, keys: Sequence[str], out: str = "centroid") -> DataFrame:
    """Element-wise mean per key, re-normalised to unit length.

    ``Summarizer`` aggregates whole vectors map-side: the shuffle carries one
    partial vector per key and task, not one row per vector element.
    """
    v = array_to_vector(as_double(F.col(vec)))
    mean = df.groupBy(*keys).agg(Summarizer.mean(v).alias("_mean"))
    return mean.select(*keys, l2_normalize(vector_to_array("_mean")).alias(out))


def _key_kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"k{i} array<{df.schema[k].dataType.simpleString()}>" for i, k in enumerate(keys))


def _packed(df: DataFrame, keys: Sequence[str], vec: str, size: int) -> DataFrame:
    """Rows of at most ``size`` vectors: keys as arrays ``k0``.., ``m`` vectors as one binary, whatever their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                row = {f"k{i}": [part[f"k{i}"].tolist()] for i in range(len(keys))}
                yield pd.DataFrame(row | {"m": [len(part)], "body": [np.stack(part["v"].to_numpy()).astype(float).tobytes()]})

    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(vec).alias("v"))
    return rows.mapInPandas(run, f"{_key_kinds(df, keys)}, m int, body binary")


def _products(vectors: DataFrame, cents: DataFrame, id_col: str, vec: str, keys: Sequence[str], body: str, schema: str, values) -> DataFrame:
    """Blocks of vectors against blocks of centroids; ``values`` turns two matrices into columns of results.

    Both sides are tables of packed blocks that Spark joins, so neither passes the driver. Centroid blocks are dealt
    to columns of at most ``COLUMN_BLOCKS`` and copied to every row of the deal, vector blocks to a row and copied to
    every column: each pair meets once, and the vectors are read once. Where the centroids are few (one column), the
    vectors stay where they are and Spark broadcasts the other side, by its own check of its size.
    """
    spark = vectors.sparkSession
    # Equal blocks out of any layout: a block is filled within a partition.
    right = pin(_packed(cents.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), keys, body, CENTROID_BLOCK))
    columns = max(1, -(-right.count() // COLUMN_BLOCKS))
    rows = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(vectors, [id_col], vec, VECTOR_BLOCK).select(F.col("k0").alias("ids"), F.col("m").alias("m_v"), F.col("body").alias("v"), cut("body", rows).alias("r"))
    left = left.withColumn("c", every(columns))
    right = right.withColumn("c", cut("body", columns)).withColumn("r", every(rows))
    met = left.join(right, ["r", "c"]).drop("r", "c")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                v, c = np.frombuffer(row["v"]).reshape(row["m_v"], -1), np.frombuffer(row["body"]).reshape(row["m"], -1)
                unit, ids = _unit(v), np.asarray(row["ids"])
                step = max(1, OUTPUT_ROWS // len(c))
                for lo in range(0, len(v), step):
                    part = slice(lo, lo + step)
                    out = {id_col: np.repeat(ids[part], len(c))}
                    out.update({k: np.tile(np.asarray(row[f"k{i}"], dtype=object), len(ids[part])) for i, k in enumerate(keys)})
                    yield pd.DataFrame(out | {name: x.ravel() for name, x in values(unit[part], c).items()})

    return met.mapInPandas(run, schema)


def cross_concepts(vectors: DataFrame, cents: DataFrame, id_col: str, vec: str, keys: Sequence[str]) -> DataFrame:
    """Cosine of every vector with every centroid: rows (id, keys.., similarity). Either table may have any size.

    Without a centroid there is no row; a zero vector is an error.
    """
    key_types = ", ".join(f"{k} {cents.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, {key_types}, similarity double"
    return _products(vectors, cents, id_col, vec, keys, "centroid", schema, lambda v, c: {"similarity": v @ c.T})


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in double precision; a zero vector is an error."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    if (n == 0).any():
        raise ValueError("zero vector cannot be normalised")
    return v / n


def concept_scores(
    vectors: DataFrame,
    cents: DataFrame,
    id_col: str,
    vec: str,
    concept: str = "concept_id",
    polarity: str = "prompt_polarity",
    positive: str = "positive",
    negative: str = "negative",
) -> DataFrame:
    """Rows (id, concept, sim_pos, sim_neg, score = sim_pos - sim_neg) for concepts with both centroids."""
    side = lambda p: F.max(F.when(F.col(polarity) == p, F.col("centroid")))
    pairs = cents.groupBy(concept).agg(side(positive).alias("_pos"), side(negative).alias("_neg"))
    pairs = pairs.dropna(subset=["_pos", "_neg"]).select(concept, F.concat("_pos", "_neg").alias("_both"))
    ctype = cents.schema[concept].dataType.simpleString()
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, {concept} {ctype}, sim_pos double, sim_neg double, score double"

    def values(v: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        pos, neg = (v @ side.T for side in np.split(c, 2, axis=1))
        return {"sim_pos": pos, "sim_neg": neg, "score": pos - neg}

    return _products(vectors, pairs, id_col, vec, [concept], "_both", schema, values)


def progress(inventory: DataFrame, vectors: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """Per inventory key: is a valid vector present?"""
    checked = vectors.select(key, vec_check(F.col(vec), dim).alias("_state"))
    out = inventory.select(key).join(checked, key, "left")
    return out.select(key, F.coalesce(F.col("_state") == "ok", F.lit(False)).alias("done"))


def pca_scores(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """Component scores z_pc1..k of standardised vectors; signs fixed, scores standardised (ddof 0).

    The only matrix that leaves the executors is the d x d correlation matrix.
    """
    base = df.select(id_col, as_double(F.col(vec)).alias("_v"))
    row = base.agg(Summarizer.metrics("mean", "std").summary(array_to_vector("_v")).alias("s")).select("s.mean", "s.std").first()
    mean, std = row["mean"].toArray(), row["std"].toArray()
    scale = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
    d = len(mean)
    gram = base.select("_v").mapInPandas(_moment_task(mean, scale), "n long, sw double, g array<double>")
    total = sum_partials(gram, []).first()
    corr, n = np.array(total["g"]), total["n"]
    values, vectors_ = np.linalg.eigh(corr.reshape(d, d) / max(n, 1))
    top = vectors_[:, ::-1][:, :k]
    lam = values[::-1][:k]
    # A component's sign is free: make its largest loading positive.
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(k)])
    project = (top / np.sqrt(np.maximum(lam, 1e-300))) * scale[:, None]
    fields = ", ".join(f"z_pc{i} double" for i in range(1, k + 1))
    id_type = df.schema[id_col].dataType.simpleString()
    return base.mapInPandas(_project_task(mean, project, id_col), f"{id_col} {id_type}, {fields}")


def _moment_task(mean: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = (np.stack(pdf["_v"].to_numpy()) - mean) * scale
            total = z.T @ z if total is None else total + z.T @ z
            n += len(z)
        if total is not None:
            yield pd.DataFrame({"n": [n], "sw": [float(n)], "g": [total.ravel()]})

    return run


def _project_task(mean: np.ndarray, project: np.ndarray, id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = (np.stack(pdf["_v"].to_numpy()) - mean) @ project
            out = pd.DataFrame(z, columns=[f"z_pc{i + 1}" for i in range(project.shape[1])])
            out.insert(0, id_col, pdf[id_col].to_numpy())
            yield out

    return run
