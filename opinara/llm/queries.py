"""The registered queries over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import hard_negatives, language_mix, masked_lm, mixing, packing, prefix_trie, quality, simhash, substring_dedup, token_counts, token_files, topk, toxicity
from opinara.session import pin, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    back = token_files.read_token_files(spark, folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = pin(quality.measures(table(spark, sf_dir, "documents")).select("doc_id", "lang", "quality"))
    edges = pin(quality.bands(measured))
    return quality.judged(measured, edges).select("doc_id", *[f"quality.{c}" for c in quality.COUNTS], "base_failed", "kept", *[f"quality.{m}" for m in quality.MEASURES])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return scored.select("doc_id", "n_words", "log_likelihood", (F.col("log_likelihood") / F.greatest("n_words", F.lit(1))).alias("per_word"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(x.cast("double") * 64).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(F.coalesce(third != 1, F.lit(False)))
    machine = toxicity.train(docs, labels)
    scored = docs.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), toxicity.toxicity(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), openings=100)


def op12_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    quarter = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_mix.train(docs.filter(quarter != 2))
    docs = docs.select("doc_id", "text")
    found = docs.select("doc_id", F.coalesce(quarter == 2, F.lit(False)).alias("held_out"), language_mix.languages(docs, model).alias("s"))
    return found.select("doc_id", "held_out", F.col("s.lang").alias("lang_pred"), "s.score", F.col("s.mix").alias("mix"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scaled(x):
        y = x.cast("double") * 256
        # From 2**53 on a double is whole, and too large for floor's long; values that are not finite stay as they are.
        return F.when(F.isnan(y) | (F.abs(y) >= float(1 << 53)), y).otherwise(F.floor(y).cast("double"))

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.transform("embedding", scaled).alias("vector"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_substring_dedup, op2_token_files, op3_source_mix, op4_token_counts, op5_quality_rules, op6_packing, op7_masked_lm, op8_simhash, op9_topk, op10_toxicity, op11_prefix_trie, op12_language_mix, op13_hard_negatives, pipeline)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
        win AS (SELECT s.r, s.p, list_slice(d.w, s.p, s.p + 34) AS g FROM starts s JOIN d ON d.r = s.r),
        rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM win JOIN rep USING (g)),
        word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        kept AS (SELECT word.r, string_agg(word.x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON k.r = d.r""",
    "op9_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op11_prefix_trie": """
        WITH o AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS p
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
        bits AS (SELECT c, list_transform(range(0, 8 * strlen(CAST(c AS VARCHAR))), lambda i: CAST((ascii(CAST(c AS VARCHAR)[CAST(i // 8 AS BIGINT) + 1]) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT)) AS b
                 FROM (SELECT DISTINCT c FROM o)),
        k AS (SELECT c, xor(list_reduce(list_concat([4294967295], b), lambda r, x: xor(r >> 1, 3988292384 * (xor(r, x) & 1))), 4294967295) % 6 AS h FROM bits),
        part AS (SELECT k.c, 0 AS own, p, role, text FROM k JOIN o ON o.c = k.c - k.c % 100 AND p <= h
                 UNION ALL SELECT k.c, 1, p, role, text FROM k JOIN o ON o.c = k.c AND p > h),
        conv AS (SELECT k.c, coalesce(list({'r': role, 't': text} ORDER BY own, p) FILTER (WHERE part.c IS NOT NULL), []) AS turns FROM k LEFT JOIN part ON part.c = k.c GROUP BY k.c),
        pre AS (SELECT c, d, list_slice(turns, 1, d) AS key, len(turns) = d AS last FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM conv)),
        node AS (SELECT key, d, min(c) AS low, count(*) AS n, count(*) FILTER (WHERE last) AS n_end, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last) AS ends FROM pre GROUP BY key, d),
        up AS (SELECT list_slice(key, 1, a) AS key, a, d, n, n_end, CASE WHEN d > 0 THEN length(key[d].t) ELSE 0 END AS size FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM node)),
        tree AS (SELECT key, a, count(*) FILTER (WHERE d = a + 1) AS kids, count(*) FILTER (WHERE n = n_end) AS leaves, sum((n - 1) * size) AS saved FROM up GROUP BY key, a)
        SELECT node.low AS conv_id, CAST(node.d AS BIGINT) AS depth, parent.low AS parent_conv_id, node.n AS n_convs, kids AS n_children, leaves AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
        FROM node JOIN tree ON tree.key = node.key AND tree.a = node.d LEFT JOIN node parent ON node.d > 0 AND parent.d = node.d - 1 AND parent.key = list_slice(node.key, 1, node.d - 1)""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.label, c.vec_id, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
              FROM v a JOIN v c ON a.vec_id % 100 = 0 AND len(a.e) = len(c.e)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
}
