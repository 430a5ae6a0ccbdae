"""Embedding checks, normalisation, centroids, concept scores, components."""

from pyspark.sql import functions as F

from opinara.functions import vectors as V
from opinara.operators import vectors as OV

from .base import Catalog, rd, rounded, table

C = Catalog()
DIM = 64
D = "list_transform(embedding, lambda x: x::DOUBLE)"
UNIT = f"unit AS (SELECT vec_id, concept_id, prompt_polarity, list_transform({D}, lambda x: x / sqrt(list_sum(list_transform({D}, lambda y: y * y)))) AS u, {D} AS d FROM {{vectors}})"
CENT = """el AS (SELECT concept_id, prompt_polarity, generate_subscripts(d, 1) AS i, unnest(d) AS x FROM unit),
  mean AS (SELECT concept_id, prompt_polarity, i, avg(x) AS m FROM el GROUP BY ALL),
  cent AS (SELECT concept_id, prompt_polarity, list(m / n ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY concept_id, prompt_polarity)) AS n FROM mean) GROUP BY ALL)"""
SIM = "sim AS (SELECT vec_id, cent.concept_id, cent.prompt_polarity, list_dot_product(u, c) AS s FROM unit CROSS JOIN cent)"


def cents(spark, sf):
    return OV.centroids(table(spark, sf, "vectors"), "embedding", ["concept_id", "prompt_polarity"])


@C.add("vec_validate", f"SELECT vec_id, CASE WHEN len(embedding) <> {DIM} THEN 'bad_length' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'ok' END AS state FROM {{vectors}}")
def _(spark, sf):
    return table(spark, sf, "vectors").select("vec_id", V.vec_check(F.col("embedding"), DIM).alias("state"))


@C.add("vec_l2_normalize", f"WITH {UNIT} SELECT vec_id, i, {rd('x', 'x')} FROM (SELECT vec_id, generate_subscripts(u, 1)::INT AS i, unnest(u) AS x FROM unit)")
def _(spark, sf):
    u = table(spark, sf, "vectors").select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return rounded(u.select("vec_id", (F.col("i") + 1).alias("i"), "x"))


@C.add("vec_columns", "SELECT vec_id, " + ", ".join(rd(f"embedding[{i + 1}]", f"dim_{i:03d}") for i in range(DIM)) + " FROM {vectors}")
def _(spark, sf):
    v = table(spark, sf, "vectors").select("vec_id", "embedding")
    wide = V.vec_to_cols(v, "embedding", DIM, "dim_")
    back = V.cols_to_vec(wide, [c for c in wide.columns if c.startswith("dim_")], "embedding")
    return rounded(V.vec_to_cols(back, "embedding", DIM, "dim_"))


@C.add("vec_centroid", f"WITH {UNIT}, {CENT} SELECT concept_id, prompt_polarity, i, {rd('x', 'x')} FROM (SELECT concept_id, prompt_polarity, generate_subscripts(c, 1)::INT AS i, unnest(c) AS x FROM cent)")
def _(spark, sf):
    c = cents(spark, sf).select("concept_id", "prompt_polarity", F.posexplode("centroid").alias("i", "x"))
    return rounded(c.withColumn("i", F.col("i") + 1))


@C.add("join_cross_concepts", f"WITH {UNIT}, {CENT}, {SIM} SELECT vec_id, concept_id, prompt_polarity, {rd('s', 'similarity')} FROM sim")
def _(spark, sf):
    return rounded(OV.cross_concepts(table(spark, sf, "vectors"), cents(spark, sf), "vec_id", "embedding", ["concept_id", "prompt_polarity"]))


@C.add(
    "vec_concept_score",
    f"""WITH {UNIT}, {CENT}, {SIM}, w AS (SELECT vec_id, concept_id, max(s) FILTER (prompt_polarity = 'positive') AS p, max(s) FILTER (prompt_polarity = 'negative') AS n FROM sim GROUP BY ALL)
    SELECT vec_id, concept_id, {rd('p', 'sim_pos')}, {rd('n', 'sim_neg')}, {rd('p - n', 'score')} FROM w""",
)
def concept(spark, sf):
    return rounded(OV.concept_scores(table(spark, sf, "vectors"), cents(spark, sf), "vec_id", "embedding"))


@C.add("progress_table", "SELECT p_partkey AS key, vec_id IS NOT NULL AS done FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def _(spark, sf):
    inv = table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    vecs = table(spark, sf, "vectors").select(F.col("vec_id").alias("key"), "embedding")
    return OV.progress(inv, vecs, "key", "embedding", DIM)


@C.add("pca_scores")
def components(spark, sf):
    """Seven component scores per vector (eigenvectors have no SQL twin; checked against numpy in the tests)."""
    return rounded(OV.pca_scores(table(spark, sf, "vectors"), "vec_id", "embedding", 7))
