"""Model responses and lexicon extraction over the whole documents."""

from pyspark.sql import functions as F

from opinara.functions import responses as R
from opinara.operators import lexicon as L
from opinara.operators import joins as J
from opinara.operators import lexicon_table as LT
from opinara.session import pin, scratch_path
from opinara.sources import readers as RD

from .base import Catalog, table

C = Catalog()
DIMS = ["en", "fr", "de"]
DIM_LIST = ", ".join(f"'{d}'" for d in DIMS)

# The SQL twin of parsing: body without fence, first valid of body and brace block.
PARSED = """body AS (SELECT *, regexp_replace(regexp_replace(trim(raw, ' ' || chr(10)), '^```(?:json)?\\s*', ''), '\\s*```$', '') AS b FROM {responses}),
  doc AS (SELECT *, nullif(regexp_extract(b, '(?s)(\\{{.*\\}})', 1), '') AS blk FROM body),
  js AS (SELECT *, CASE WHEN json_valid(b) THEN b WHEN json_valid(blk) THEN blk END AS j FROM doc),
  err AS (SELECT *, CASE WHEN raw IS NULL OR raw = '' THEN 'empty' WHEN NOT json_valid(b) AND blk IS NULL THEN 'no_json_block'
      WHEN j IS NULL THEN 'json_parse_fail' WHEN json_type(j) <> 'OBJECT' OR json_type(j, '$.matches') IS NULL THEN 'no_matches_key'
      WHEN json_type(j, '$.matches') <> 'ARRAY' THEN 'matches_not_list' END AS parse_error FROM js)"""
ITEMS = """items AS (SELECT row_id, product_id, text, unnest(json_extract(j, '$.matches[*]')) AS e, generate_subscripts(json_extract(j, '$.matches[*]'), 1) AS pos
    FROM err WHERE parse_error IS NULL),
  tested AS (SELECT *, coalesce(json_type(e) = 'OBJECT' AND json_type(e, '$.span') = 'VARCHAR' AND length(json_extract_string(e, '$.span')) > 0
      AND contains(text, json_extract_string(e, '$.span')) AND json_extract_string(e, '$.dimension') IN (@DIMS)
      AND json_type(e, '$.polarity') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')
      AND CASE json_extract_string(e, '$.polarity') WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(json_extract_string(e, '$.polarity') AS DOUBLE) END IN (-1, 0, 1), false) AS ok FROM items),
  good AS (SELECT *, (row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1)::INT AS match_id,
      json_extract_string(e, '$.dimension') AS dimension, json_extract_string(e, '$.span') AS span,
      CASE json_extract_string(e, '$.polarity') WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE CAST(json_extract_string(e, '$.polarity') AS DOUBLE) END::INT AS polarity,
      coalesce(json_extract_string(e, '$.degree_word'), '') AS degree_word,
      CASE json_type(e, '$.negated') WHEN 'BOOLEAN' THEN json_extract_string(e, '$.negated') = 'true' WHEN 'VARCHAR' THEN length(json_extract_string(e, '$.negated')) > 0 ELSE false END AS negated
    FROM tested WHERE ok)""".replace("@DIMS", DIM_LIST)


@C.add("parse_matches", f"WITH {PARSED} SELECT row_id, parse_error, CASE WHEN parse_error IS NULL THEN json_array_length(j, '$.matches')::INT END AS n_items FROM err")
def _(spark, sf):
    p = R.parse_matches(table(spark, sf, "responses"), "raw")
    return p.select("row_id", "parse_error", F.when(F.col("matches").isNotNull(), F.size("matches")).alias("n_items"))


def validated(spark, sf):
    return R.validate_matches(R.parse_matches(table(spark, sf, "responses"), "raw"), "text", DIMS)


@C.add("validate_matches", f"WITH {PARSED}, {ITEMS} SELECT e.row_id, count(*) FILTER (ok)::INT AS n_valid, count(*) FILTER (NOT ok)::INT AS n_invalid FROM err e LEFT JOIN tested USING (row_id) GROUP BY e.row_id")
def _(spark, sf):
    return validated(spark, sf).select("row_id", F.size("valid").alias("n_valid"), "n_invalid")


@C.add("explode_with_position", f"WITH {PARSED}, {ITEMS} SELECT row_id, product_id, match_id, dimension, span, polarity, degree_word, negated FROM good")
def exploded(spark, sf):
    return R.explode_matches(validated(spark, sf), ["row_id", "product_id"])


@C.add("match_defaults", f"WITH {PARSED}, {ITEMS} SELECT degree_word, negated, count(*) AS n FROM good GROUP BY ALL")
def _(spark, sf):
    return exploded(spark, sf).groupBy("degree_word", "negated").agg(F.count(F.lit(1)).alias("n"))


CHECKPOINT_SQL = f"""WITH {PARSED}, {ITEMS}, cnt AS (SELECT row_id, count(*) FILTER (ok)::INT AS n_ok, count(*) FILTER (NOT ok)::INT AS n_bad FROM tested GROUP BY row_id)
  SELECT row_id, product_id, coalesce(parse_error, '') AS error, coalesce(n_ok, 0) AS n_matches, coalesce(n_bad, 0) AS n_invalid_spans,
    coalesce(CAST(json_extract_string(usage, '$.prompt_tokens') AS BIGINT), 0) AS in_tokens,
    CASE WHEN json_type(usage, '$.prompt_tokens_details') = 'OBJECT' THEN CAST(json_extract_string(usage, '$.prompt_tokens_details.cached_tokens') AS BIGINT)
         WHEN json_type(usage, '$.prompt_tokens_details') IS NULL THEN 0
         ELSE coalesce(CAST(json_extract_string(usage, '$.prompt_cache_hit_tokens') AS BIGINT), 0) END AS cached_tokens,
    coalesce(CAST(json_extract_string(usage, '$.completion_tokens') AS BIGINT), 0) AS out_tokens
  FROM err LEFT JOIN cnt USING (row_id)"""
CHECKPOINT_COLS = ["row_id", "product_id", "error", "n_matches", "n_invalid_spans", "in_tokens", "cached_tokens", "out_tokens"]


@C.add("checkpoint_rows", CHECKPOINT_SQL)
def _(spark, sf):
    return R.checkpoint_rows(table(spark, sf, "responses"), DIMS).select(*CHECKPOINT_COLS)


# Frequent words of the documents stand in for seeds and modifiers.
RULES = L.Rules(
    seeds=[
        L.Seed("tion", "noun", 1),
        L.Seed("tiona", "noun", 1),
        L.Seed("eau", "noun", -1),
        L.Seed("eaux", "noun", 1),
        L.Seed("ing", "verb", -1),
        L.Seed("ment", "verb", 1),
        L.Seed("and", "verb", 1),
        L.Seed("anand", "verb", 0, excluded=True),
        L.Seed("ung", "other", 1),
    ],
    degrees={"en": 1.0, "er": 0.7, "re": 0.7, "la": 0.4, "n": 0.4},
    degrees_after={"le": 0.4, "on": 0.4, "the": 0.4},
    negations=["an", "o", "un"],
    negation_exceptions=["ou", "ant"],
)


def _lexicon_sql(rules: L.Rules) -> str:
    seeds = rules.by_text()
    reach = rules.reach_after()
    degrees = [(w, v, f"contains(before, '{w}')") for w, v in rules.degrees.items()]
    degrees += [(w, v, f"contains(left(after, {L.WINDOW - 1 + len(w)}), '{w}')") for w, v in rules.degrees_after.items()]
    options = ", ".join(f"CASE WHEN {hit} THEN {{{{'w': {v}::DOUBLE, 'n': {len(w)}, 'word': '{w}'}}}} END" for w, v, hit in degrees)
    masked = "before || span"
    for p in rules.negation_exceptions:
        masked = f"replace({masked}, '{p}', repeat(chr(3), {len(p)}))"
    negated = " OR ".join(f"contains(left(masked, length(before)), '{w}')" for w in rules.negations)
    case = lambda attr: "CASE span " + " ".join(f"WHEN '{t}' THEN {attr(s)}" for t, s in seeds.items()) + " END"
    wanted = ", ".join(f"'{t}'" for t, s in seeds.items() if not s.excluded)
    # Positions come from the lengths of the pieces; windows are then cut from the text itself.
    return f"""WITH marked AS (SELECT doc_id, translate(text, chr(1) || chr(2) || chr(3), '   ') AS t FROM {{documents}}),
      pieces AS (SELECT doc_id, t, string_split(regexp_replace(t, '({rules.pattern()})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM marked),
      ex AS (SELECT doc_id, t, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM pieces),
      pos AS (SELECT *, coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM ex),
      hits AS (SELECT doc_id, (i - 2)::INT AS match_id, split_part(piece, chr(2), 1) AS span,
        substr(t, greatest(off - {L.WINDOW - 1}, 1), least(off, {L.WINDOW})) AS before, substr(t, off + 1 + length(split_part(piece, chr(2), 1)), {reach}) AS after
        FROM pos WHERE i > 1),
      m AS (SELECT *, {masked} AS masked, list_max(list_filter([{options}], lambda x: x IS NOT NULL)) AS best FROM hits)
      SELECT doc_id, match_id, {case(lambda s: f"'{s.dimension}'")} AS dimension, span, ({case(lambda s: s.polarity)})::INT AS polarity,
        coalesce(best.word, '') AS degree_word, ({negated}) AS negated FROM m WHERE span IN ({wanted})"""


@C.add("lexicon_extract", _lexicon_sql(RULES))
def lexicon(spark, sf):
    return L.lexicon_extract(table(spark, sf, "documents"), "text", RULES, ["doc_id"])


# Words of the documents themselves as a lexicon of some size, written and read as JSON.
TABLE_SEEDS = """s0 AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{5,7}}')) AS seed FROM {documents}),
  seeds AS (SELECT seed, 'len' || length(seed) AS dimension, (length(seed) - 6)::INT AS polarity, length(seed) = 7 AND starts_with(seed, 'a') AS excluded FROM s0)"""


#: Words that the dictionaries of one part hold between them.
SEED_WORDS = 65_536


def _seed_file(spark, sf) -> str:
    """Dictionary of seeds by dimension and kind, in the layout that the reader of seed lexicons takes."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,7}"), F.lit(0))).alias("seed")).distinct()
    words = pin(words)
    kinds = words.select("seed", F.concat(F.lit("len"), F.length("seed").cast("string")).alias("dimension"), F.length("seed").alias("n"))
    path = scratch_path(spark, "seeds")
    lists = {
        "positive_seeds": (F.col("n") == 7) & ~F.startswith("seed", F.lit("a")),
        "negative_seeds": F.col("n") == 5,
        "trigger_words": F.col("n") == 6,
        "exclude_words": (F.col("n") == 7) & F.startswith("seed", F.lit("a")),
    }
    # A file is a dictionary of one entry, and as many words as there are, none grows. Lists hold distinct words of one length.
    parts = max(1, -(-words.count() // SEED_WORDS))
    kinds = kinds.withColumn("part", F.pmod(F.xxhash64("seed"), F.lit(parts)))
    entries = kinds.groupBy("dimension", "part").agg(*[F.collect_set(F.when(hit, F.col("seed"))).alias(name) for name, hit in lists.items()])
    entry = F.to_json(F.create_map(F.col("dimension"), F.struct(*lists)))
    entries.select(entry.alias("value"), "dimension", "part").repartition("dimension", "part").write.partitionBy("dimension", "part").text(path)
    return path


def _table_sql() -> str:
    full = _lexicon_sql(RULES)
    tail = full[full.index("      m AS (SELECT *,") : full.index(" AS dimension, span, (CASE")]
    tail = tail[: tail.index("SELECT doc_id, match_id, CASE span")]
    negated = full[full.index("coalesce(best.word, '') AS degree_word") : full.index(" FROM m WHERE span IN")]
    reach = RULES.reach_after()
    return f"""WITH {TABLE_SEEDS}, t AS (SELECT doc_id, text AS t, length(text) AS n FROM {{documents}}),
      place AS (SELECT doc_id, t, unnest(range(1, n + 1)) AS s FROM t),
      cand AS (SELECT doc_id, t, s, s + k AS e, substr(t, s, k) AS span FROM place CROSS JOIN (SELECT unnest([5, 6, 7]) AS k)),
      occ AS (SELECT doc_id, t, list([{{{{'s': s, 'e': e}}}}] ORDER BY s, -e) AS l FROM cand JOIN seeds ON seed = span GROUP BY doc_id, t),
      kept AS (SELECT doc_id, t, list_reduce(l, lambda a, h: CASE WHEN h[1].s >= a[-1].e THEN list_concat(a, h) ELSE a END) AS k FROM occ),
      one AS (SELECT doc_id, t, unnest(k) AS h, (generate_subscripts(k, 1) - 1)::INT AS match_id FROM kept),
      hits AS (SELECT doc_id, match_id, substr(t, h.s, h.e - h.s) AS span, substr(t, greatest(h.s - {L.WINDOW}, 1), least(h.s - 1, {L.WINDOW})) AS before, substr(t, h.e, {reach}) AS after FROM one),
{tail}SELECT doc_id, match_id, dimension, span, polarity, {negated} FROM m JOIN seeds ON seed = span WHERE NOT excluded"""


@C.add("lexicon_extract_table", _table_sql())
def _(spark, sf):
    seeds = RD.read_seed_lexicon(spark, _seed_file(spark, sf), "words")
    weights = lambda words: spark.createDataFrame(list(words.items()), "word string, weight double")
    listed = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    return LT.extract_from_tables(
        table(spark, sf, "documents"), "text", seeds, ["doc_id"], weights(RULES.degrees), weights(RULES.degrees_after),
        listed(RULES.negations), listed(sorted(RULES.negation_exceptions, key=lambda w: (-len(w), w))),
    )


PHRASES = [
    L.Seed("is the", "state", 1),
    L.Seed("of the", "state", -1),
    L.Seed("the", "article", 1),
    L.Seed("des", "article", -1),
    L.Seed("de la", "article", 0),
    L.Seed("der die", "article", 1, excluded=True),
]
PHRASE_RULES = L.Rules(PHRASES, RULES.degrees, RULES.degrees_after, RULES.negations, RULES.negation_exceptions)


@C.add("lexicon_polarity_functional", _lexicon_sql(PHRASE_RULES))
def _(spark, sf):
    return L.lexicon_polarity(table(spark, sf, "documents"), "text", PHRASES, RULES, ["doc_id"])


@C.add("join_results_rows", f"WITH {PARSED}, {ITEMS}, n AS (SELECT row_id, count(*) AS n_matches FROM good GROUP BY row_id) SELECT doc_id AS row_id, source, n_matches FROM {{documents}} LEFT JOIN n ON row_id = doc_id")
def _(spark, sf):
    results = exploded(spark, sf).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_matches"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")
    return J.results_to_rows(rows, results, "row_id")
