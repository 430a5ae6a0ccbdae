"""Input views shared by the queries and their SQL twins.

A fixture is one SELECT that Spark SQL and DuckDB both run; ``{name}`` refers to
a table or another fixture. Fixtures only rename and derive columns: every row
of the table stays in.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.sources.readers import read_spread, read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

WEIGHTS = {"very": 1.0, "fairly": 0.7, "slightly": 0.4}
F_DIMS = {f"function {i}": f"MF{i}" for i in range(1, 8)}
A_DIMS = {f"affect {i}": f"ME{i}" for i in range(1, 6)}
MF = list(F_DIMS.values())
ME = list(A_DIMS.values())
ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]

FIXTURES: dict[str, str] = {
    # One row per review; some comment ids are missing.
    "reviews": """
        SELECT l_partkey AS product_id, CASE WHEN l_tax < 0.075 THEN l_orderkey END AS comment_id,
               l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
               CASE WHEN l_linenumber > 2 THEN l_extendedprice END AS price,
               CASE WHEN l_discount > 0.02 THEN l_returnflag END AS brand,
               CASE WHEN l_linenumber = 7 THEN NULL
                    ELSE least(CAST(1 AS DOUBLE), greatest(CAST(-1 AS DOUBLE), (l_tax - l_discount) * 10)) END
                    AS sentiment_score,
               l_discount, l_tax, l_quantity, l_shipdate
        FROM {lineitem}""",
    # One row per match; the label 'other' is outside both dimension maps.
    "matches": """
        SELECT l_partkey AS product_id, l_orderkey AS comment_id,
               CASE WHEN l_quantity <= 40 THEN 'function ' || CAST(l_linenumber AS STRING) ELSE 'other' END AS fdim,
               CASE WHEN l_quantity <= 40 THEN 'affect ' || CAST((l_linenumber - 1) % 5 + 1 AS STRING) ELSE 'other' END
                    AS adim,
               CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS polarity,
               l_linestatus = 'F' AS negated,
               CASE CAST(round(l_discount * 100) AS BIGINT) % 5 WHEN 1 THEN ' very' WHEN 2 THEN 'fairly'
                    WHEN 3 THEN 'slightly' WHEN 4 THEN 'zzz' END AS degree_word
        FROM {lineitem}""",
    "totals": "SELECT l_partkey AS product_id, count(*) AS n_total FROM {lineitem} GROUP BY l_partkey",
    "products": """
        SELECT p_partkey AS product_id, p_brand AS brand, p_retailprice AS price, p_size,
               CAST(0.8 AS DOUBLE) + CAST(p_size AS DOUBLE) / 250 AS favorable_rate
        FROM {part}""",
    # Text columns as they come from a spreadsheet, one row per order.
    "order_reviews": """
        SELECT o_orderkey AS row_id,
               CASE WHEN o_orderstatus = 'P' THEN 'notes.xlsx'
                    ELSE CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 7 AS STRING) || '_reviews.xlsx' END
                    AS file_name,
               CAST(o_custkey AS STRING) AS comment_id, o_orderpriority AS comment_text,
               CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END
                    AS price_text
        FROM {orders}""",
    "checkpoint": """
        SELECT user_id AS row_id, event_id AS seq,
               CASE WHEN event_type = 'error' THEN 'parse_fail' WHEN event_type = 'view' THEN NULL ELSE '' END AS error,
               CASE WHEN event_type = 'click' THEN NULL ELSE value END AS score,
               CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS n_matches,
               CAST(length(props) AS BIGINT) AS in_tokens, CAST(length(event_type) AS BIGINT) AS cached_tokens,
               CAST(event_id % 5 AS BIGINT) AS out_tokens
        FROM {events}""",
    "todo_rows": "SELECT c_custkey AS row_id, c_name AS comment_text FROM {customer}",
    "scores_text": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
               CASE l_linenumber WHEN 1 THEN '0.' || CAST(l_suppkey AS STRING)
                    WHEN 2 THEN '-0.' || CAST(l_suppkey AS STRING) || '分'
                    WHEN 3 THEN '.' || CAST(l_suppkey AS STRING)
                    WHEN 4 THEN CAST(l_suppkey AS STRING) || '.'
                    WHEN 5 THEN '０.' || CAST(l_suppkey AS STRING)
                    WHEN 6 THEN 'good' ELSE '' END AS raw
        FROM {lineitem}""",
    "raw_ids": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
               CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS STRING) || '—' || CAST(l_suppkey AS STRING)
                    WHEN 2 THEN ' ' || CAST(l_partkey AS STRING) || '–' || CAST(l_suppkey AS STRING) || '　'
                    WHEN 3 THEN CAST(l_partkey AS STRING) || '－ ' || CAST(l_suppkey AS STRING)
                    WHEN 4 THEN '(' || CAST(l_partkey AS STRING) || ')--' || CAST(l_suppkey AS STRING)
                    WHEN 5 THEN '00' || CAST(l_partkey AS STRING) || '-0' || CAST(l_suppkey AS STRING) || '.xlsx'
                    WHEN 6 THEN l_returnflag END AS raw_id
        FROM {lineitem}""",
    "vectors": """
        SELECT vec_id, embedding, label, CAST(label % 5 AS STRING) AS concept_id,
               CASE WHEN label < 5 THEN 'positive' ELSE 'negative' END AS prompt_polarity
        FROM {embeddings}""",
    # Product table for the models: averages of review columns plus part attributes.
    "design": """
        SELECT p.p_partkey AS product_id, p.p_brand AS brand, CAST(p.p_size AS DOUBLE) AS size, p.p_retailprice / 1000 AS price,
               r.n_reviews, r.quantity, r.discount, r.tax, r.spend,
               CASE WHEN p.p_size < 45 THEN CAST(p.p_size AS DOUBLE) / 10 END AS gap
        FROM {part} p JOIN (
            SELECT l_partkey, count(*) AS n_reviews, avg(l_quantity) / 10 AS quantity, avg(l_discount) * 100 AS discount,
                   avg(l_tax) * 100 AS tax, avg(l_extendedprice) / 10000 AS spend
            FROM {lineitem} GROUP BY l_partkey) r ON r.l_partkey = p.p_partkey""",
    "pvalues": """
        SELECT p_partkey AS item, p_brand AS family, ((p_partkey * 7919) % 1007) / CAST(1007 AS DOUBLE) AS p FROM {part}""",
    # Model responses built from the documents, with every kind of fault in turn.
    "responses": """
        SELECT doc_id AS row_id, text, lang AS product_id, n_chars,
               CASE n_chars % 9
                 WHEN 0 THEN '```json' || chr(10) || good || chr(10) || '```'
                 WHEN 1 THEN 'Here it is: ' || good || ' done'
                 WHEN 2 THEN 'cut {{"matches":[' || m1
                 WHEN 3 THEN '{{"items":[' || m1 || ']}}'
                 WHEN 4 THEN '{{"matches":' || m1 || '}}'
                 WHEN 5 THEN '{{"matches":[{{"dimension":"' || lang || '","span":"@@none@@","polarity":1}},' || m1 || ',7]}}'
                 WHEN 6 THEN '{{"matches":[{{"dimension":"' || lang || '","span":"' || w1 || '","polarity":"1"}},'
                             || '{{"dimension":"' || lang || '","span":"' || w1 || '","polarity":true,"negated":"false"}},'
                             || '{{"dimension":"' || lang || '","span":"' || w1 || '","polarity":2}}]}}'
                 WHEN 7 THEN 'no json at all'
                 ELSE good END AS raw,
               CASE n_chars % 4
                 WHEN 0 THEN '{{"prompt_tokens":' || CAST(n_chars AS STRING) || ',"completion_tokens":3,"prompt_tokens_details":{{"cached_tokens":' || CAST(n_chars % 10 AS STRING) || '}}}}'
                 WHEN 1 THEN '{{"prompt_tokens":' || CAST(n_chars AS STRING) || ',"completion_tokens":2}}'
                 WHEN 2 THEN '{{"prompt_tokens":5,"prompt_tokens_details":1,"prompt_cache_hit_tokens":' || CAST(n_chars % 7 AS STRING) || '}}'
                 END AS usage
        FROM (
          SELECT doc_id, text, lang, n_chars, w1, m1,
                 '{{"matches":[' || m1 || ',{{"dimension":"' || lang || '","span":"' || w2
                 || '","polarity":-1.0,"degree_word":null,"negated":true}}]}}' AS good
          FROM (
            SELECT doc_id, text, lang, n_chars, w1, w2,
                   '{{"dimension":"' || lang || '","span":"' || w1 || '","polarity":1,"degree_word":"very","negated":false}}' AS m1
            FROM (
              SELECT doc_id, text, lang, n_chars, regexp_extract(text, '([A-Za-z]+)', 1) AS w1,
                     regexp_extract(text, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1) AS w2
              FROM {documents}) a) b) c""",
    "usage": """
        SELECT event_id,
               CASE event_type
                 WHEN 'view' THEN '{{"prompt_tokens_details":{{"cached_tokens":' || CAST(user_id AS STRING) || '}}}}'
                 WHEN 'click' THEN '{{"prompt_tokens_details":null,"prompt_cache_hit_tokens":' || CAST(user_id AS STRING) || '}}'
                 WHEN 'error' THEN '{{"cached_tokens":4}}'
                 WHEN 'signup' THEN '{{"prompt_tokens_details":{{"cached_tokens":null}}}}'
                 END AS usage
        FROM {events}""",
}

#: Tables that a fixture joins to an aggregate as large: both sides stay partitioned by key. Spark would judge the table by
#: its packed files and collect all its rows on the driver for a broadcast.
PARTITIONED = {"design": ("part",)}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def refs(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql)))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A benchmark table or fixture as a DataFrame."""
    if name == "documents":
        return read_spread(spark, f"{sf}/documents.parquet", "doc_id")
    if name in TABLES:
        return read_table(spark, f"{sf}/{name}.parquet")
    sql = FIXTURES[name]
    side = lambda r: table(spark, sf, r).hint("merge") if r in PARTITIONED.get(name, ()) else table(spark, sf, r)
    return spark.sql(sql, **{r: side(r) for r in refs(sql)})


def oracle(sql: str) -> str:
    """DuckDB text: fixtures used by ``sql`` become common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for r in refs(FIXTURES[name]):
            visit(r)
        order.append(name)

    for r in refs(sql):
        visit(r)
    names = {n: n for n in [*TABLES, *order]}
    ctes = ", ".join(f"{n} AS ({FIXTURES[n].format(**names)})" for n in order)
    body = sql.format(**names)
    if not ctes:
        return body
    text = body.lstrip()
    return f"WITH {ctes}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), places) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def rd(expr: str, name: str, places: int = 6) -> str:
    """SQL twin of :func:`rounded` for one column."""
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0 AS {name}"


Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries and their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = oracle(sql)
            return fn

        return register
