"""Identifiers, numeric coercion, transforms and labels."""

from pyspark.sql import functions as F

from opinara.functions import ids as I
from opinara.functions import scalars as S
from opinara.functions import text as X
from opinara.functions.responses import usage_tokens
from opinara.operators.standardize import complete_cases
from opinara.operators.joins import replace_from
from opinara.sources.readers import clean_names, cols_like, select_existing

from .base import ORDER, Catalog, rd, rounded, table

C = Catalog()
O = ", ".join(ORDER)
STRIP = lambda e: f"regexp_replace(regexp_replace({e}, '^[\\s　 ]+', ''), '[\\s　 ]+$', '')"


def _ids(norm):
    def run(spark, sf):
        return table(spark, sf, "raw_ids").select(*ORDER, "raw_id", norm(F.col("raw_id")).alias("pid"))

    return run


C.add(
    "pid_from_filename",
    "SELECT row_id, nullif(regexp_extract(file_name, '^([0-9]+-[0-9]+)', 1), '') AS product_id FROM {order_reviews}",
)(lambda spark, sf: table(spark, sf, "order_reviews").select("row_id", I.product_id_from_name(F.col("file_name")).alias("product_id")))

C.add(
    "pid_norm_dashes",
    f"SELECT {O}, raw_id, coalesce(replace(replace(translate({STRIP('raw_id')}, '—–－‐', '----'), '　', ''), ' ', ''), '') AS pid FROM {{raw_ids}}",
)(_ids(I.norm_id_dashes))

C.add(
    "pid_norm_digits",
    f"""SELECT {O}, raw_id, CASE WHEN len(r) >= 2 THEN CAST(CAST(r[1] AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(r[2] AS BIGINT) AS VARCHAR) ELSE t END AS pid
    FROM (SELECT *, translate({STRIP('raw_id')}, '—–', '--') AS t, regexp_extract_all(raw_id, '[0-9]+') AS r FROM {{raw_ids}})""",
)(_ids(I.norm_id_digits))

C.add(
    "pid_norm_paren",
    f"""SELECT {O}, raw_id, CASE WHEN regexp_full_match(t, '[0-9]+-[0-9]+') THEN t END AS pid FROM (SELECT *,
    regexp_replace(regexp_replace({STRIP('raw_id')}, '\\(([0-9]+)\\)', '\\1', 'g'), '-+', '-', 'g') AS t FROM {{raw_ids}})""",
)(_ids(I.norm_id_paren))

C.add("pid_norm_two_dash", f"SELECT {O}, raw_id, {STRIP('translate(raw_id, chr(8212) || chr(8211), chr(45) || chr(45))')} AS pid FROM {{raw_ids}}")(
    _ids(I.norm_id_two_dash)
)

C.add("to_numeric_coerce", f"SELECT row_id, {rd('TRY_CAST(price_text AS DOUBLE)', 'price_text')} FROM {{order_reviews}}")(
    lambda spark, sf: rounded(S.to_numeric(table(spark, sf, "order_reviews").select("row_id", "price_text"), ["price_text"]))
)

C.add("logit_eps", f"SELECT product_id, {rd('ln((favorable_rate + 0.001) / (1 - favorable_rate + 0.001))', 'rate_logit')} FROM {{products}}")(
    lambda spark, sf: rounded(table(spark, sf, "products").select("product_id", S.logit(F.col("favorable_rate")).alias("rate_logit")))
)
C.add("log_plus1", f"SELECT product_id, {rd('ln(price + 1)', 'lnprice')} FROM {{products}}")(
    lambda spark, sf: rounded(table(spark, sf, "products").select("product_id", S.log_plus(F.col("price")).alias("lnprice")))
)
C.add("log_clip1", f"SELECT product_id, {rd('CASE WHEN gap IS NOT NULL THEN ln(greatest(gap, 1)) END', 'ln_gap')} FROM {{design}}")(
    lambda spark, sf: rounded(table(spark, sf, "design").select("product_id", S.log_clip(F.col("gap")).alias("ln_gap")))
)
C.add("log1p_count", f"SELECT product_id, {rd('ln(1 + n_reviews)', 'ln_n')} FROM {{design}}")(
    lambda spark, sf: rounded(table(spark, sf, "design").select("product_id", S.log1p_count(F.col("n_reviews")).alias("ln_n")))
)

NUMBER = "TRY_CAST(nullif(regexp_extract(translate(raw, '０１２３４５６７８９．－', '0123456789.-'), '(-?[0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE)"
C.add(
    "parse_score",
    f"""SELECT {O}, raw, {rd('CASE WHEN x IS NOT NULL THEN greatest(-1, least(1, x)) END', 'score')}
    FROM (SELECT *, {NUMBER} AS x FROM {{scores_text}})""",
)(lambda spark, sf: rounded(table(spark, sf, "scores_text").select(*ORDER, "raw", S.parse_score(F.col("raw")).alias("score"))))

C.add(
    "tri_class",
    """SELECT product_id, CASE WHEN sentiment_score > 0.1 THEN 'pos' WHEN sentiment_score < -0.1 THEN 'neg'
    WHEN sentiment_score IS NOT NULL THEN 'neu' END AS cls, count(*) AS n FROM {reviews} GROUP BY ALL""",
)(
    lambda spark, sf: table(spark, sf, "reviews")
    .groupBy("product_id", S.tri_class(F.col("sentiment_score")).alias("cls"))
    .agg(F.count(F.lit(1)).alias("n"))
)

Y_WEIGHTS = {"y_a_only": 1, "y_b_only": 0, "y_50_50": 0.5, "y_30_70": 0.3, "y_70_30": 0.7}
C.add(
    "weighted_composite",
    f"""SELECT product_id, {rd('discount', 'y_a_only')}, {rd('tax', 'y_b_only')}, {rd('0.5::DOUBLE * discount + 0.5::DOUBLE * tax', 'y_50_50')},
    {rd('0.3::DOUBLE * discount + 0.7::DOUBLE * tax', 'y_30_70')}, {rd('0.7::DOUBLE * discount + 0.3::DOUBLE * tax', 'y_70_30')} FROM {{design}}""",
)(
    lambda spark, sf: rounded(
        S.composites(table(spark, sf, "design"), "discount", "tax", Y_WEIGHTS).select("product_id", *Y_WEIGHTS)
    )
)
C.add(
    "inclusion_flag",
    "SELECT product_id, n_reviews, n_reviews >= 20 AS ge_20, n_reviews >= 30 AS ge_30, n_reviews >= 40 AS ge_40 FROM {design}",
)(lambda spark, sf: S.at_least(table(spark, sf, "design"), "n_reviews", [20, 30, 40]).select("product_id", "n_reviews", "ge_20", "ge_30", "ge_40"))

STARS = lambda n: f"CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '{n}' END"
C.add("sig_stars", f"SELECT item, {STARS('')} AS stars, {STARS('ns')} AS stars_ns FROM {{pvalues}}")(
    lambda spark, sf: table(spark, sf, "pvalues").select(
        "item", S.stars(F.col("p")).alias("stars"), S.stars(F.col("p"), "ns").alias("stars_ns")
    )
)
C.add(
    "vif_flag",
    "SELECT product_id, CASE WHEN gap >= 4 THEN CASE WHEN gap * 2.5 >= 10 THEN 'SEVERE(>=10)' END WHEN gap * 2.5 >= 5 THEN 'elevated(5-10)' WHEN gap IS NOT NULL THEN '' END AS flag FROM {design}",
)(lambda spark, sf: table(spark, sf, "design").select("product_id", S.vif_flag(F.col("gap") * 2.5).alias("flag")))
C.add("verdict_label", "SELECT item, CASE WHEN p <= 0.05 THEN 'Survives' ELSE 'Does not survive' END AS result FROM {pvalues}")(
    lambda spark, sf: table(spark, sf, "pvalues").select("item", S.verdict(F.col("p") <= 0.05, "Survives", "Does not survive").alias("result"))
)
C.add(
    "strip_code_fence",
    f"""SELECT row_id, regexp_replace(regexp_replace({STRIP('raw')}, '^```(?:json)?\\s*', ''), '\\s*```$', '') AS body FROM {{responses}}""",
)(lambda spark, sf: table(spark, sf, "responses").select("row_id", X.strip_fence(F.col("raw")).alias("body")))
C.add(
    "usage_tokens",
    """SELECT event_id, CAST(CASE WHEN usage IS NULL THEN 0
      WHEN coalesce(json_type(usage, '$.prompt_tokens_details'), 'OBJECT') = 'OBJECT'
        THEN coalesce(CAST(json_extract_string(usage, '$.prompt_tokens_details.cached_tokens') AS BIGINT), 0)
      ELSE coalesce(CAST(json_extract_string(usage, '$.cached_tokens') AS BIGINT), CAST(json_extract_string(usage, '$.prompt_cache_hit_tokens') AS BIGINT), 0) END AS BIGINT) AS cached
    FROM {usage}""",
)(lambda spark, sf: table(spark, sf, "usage").select("event_id", usage_tokens(F.col("usage")).alias("cached")))
MARKER, BEFORE, AFTER = "the", "## Review\n\n\"", "\"\n\nOutput:"
C.add(
    "render_prompt",
    f"""SELECT doc_id, CASE WHEN contains(text, '{MARKER}') THEN {STRIP(f"split_part(text, '{MARKER}', 1)")} END AS system_part,
    '## Review' || chr(10) || chr(10) || '"' || text || '"' || chr(10) || chr(10) || 'Output:' AS user_message FROM {{documents}}""",
)(
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id",
        X.system_part(F.col("text"), MARKER).alias("system_part"),
        X.user_message(F.col("text"), BEFORE, AFTER).alias("user_message"),
    )
)
C.add(
    "inf_to_null",
    f"SELECT event_id, CASE WHEN value <> 0 AND value > 50 THEN NULL ELSE {rd('value', 'x')[:-5]} END AS value FROM {{events}}",
)(
    lambda spark, sf: rounded(
        S.inf_to_null(
            table(spark, sf, "events").select(
                "event_id", F.when(F.col("value") > 50, float("inf")).otherwise(F.col("value")).alias("value")
            ),
            ["value"],
        )
    )
)
C.add("complete_cases", f"SELECT product_id, {rd('gap', 'gap')}, {rd('tax', 'tax')} FROM {{design}} WHERE gap IS NOT NULL AND tax IS NOT NULL")(
    lambda spark, sf: rounded(complete_cases(table(spark, sf, "design"), ["gap", "tax"]).select("product_id", "gap", "tax"))
)
C.add("clean_columns", 'SELECT product_id, n_reviews AS n_reviews_all FROM {design}')(
    lambda spark, sf: clean_names(
        table(spark, sf, "design").select(F.col("product_id").alias("Product ID"), F.col("n_reviews").alias("N.reviews-all"))
    )
)
C.add("column_prefix_select", f"SELECT product_id, {rd('quantity', 'z_quantity')}, {rd('tax', 'z_tax')} FROM {{design}}")(
    lambda spark, sf: (
        lambda d: rounded(d.select("product_id", *cols_like(d, "z_")))
    )(table(spark, sf, "design").withColumnsRenamed({"quantity": "z_quantity", "tax": "z_tax"}))
)
C.add("replace_columns", f"SELECT d.product_id, d.n_reviews, p.brand, {rd('p.price', 'price')} FROM {{design}} d LEFT JOIN {{products}} p USING (product_id)")(
    lambda spark, sf: rounded(
        replace_from(
            table(spark, sf, "design").select("product_id", "n_reviews", "brand", "price"), table(spark, sf, "products"), "product_id", ["brand", "price"]
        )
    )
)
C.add("optional_columns", f"SELECT product_id, brand, {rd('price', 'price')} FROM {{products}}")(
    lambda spark, sf: rounded(select_existing(table(spark, sf, "products"), ["product_id", "brand", "sentiment_mean", "price"]))
)
C.add("joint_p", f"SELECT item, {rd('greatest(p, (p_size % 50) / 50.0)', 'p_joint')} FROM {{pvalues}} JOIN {{part}} ON p_partkey = item")(
    lambda spark, sf: rounded(
        table(spark, sf, "pvalues")
        .join(table(spark, sf, "part"), F.col("p_partkey") == F.col("item"))
        .select("item", S.joint_p(F.col("p"), F.col("p_size") % 50 / 50.0).alias("p_joint"))
    )
)
