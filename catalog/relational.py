"""Joins, dedupe, ordering, set operations, contracts and resumable work."""

from pyspark.sql import functions as F

from opinara.operators import joins as J
from opinara.operators import resume as RS
from opinara.operators import rows as RW
from opinara.operators import scoring as SC
from opinara.operators import summary as SM
from opinara.sources import contracts as CT

from .base import ORDER, Catalog, rd, rounded, table

C = Catalog()
ROW = "(l_orderkey, l_linenumber, l_suppkey, l_extendedprice)"


@C.add("join_left_dim", f"SELECT product_id, n_total, brand, {rd('price', 'price')} FROM {{totals}} LEFT JOIN {{products}} USING (product_id)")
def _(spark, sf):
    n = SC.n_total(table(spark, sf, "reviews"))
    return rounded(J.left_dim(n, table(spark, sf, "products").select("product_id", "brand", "price"), "product_id"))


@C.add(
    "join_outer",
    """WITH a AS (SELECT product_id, count(*) AS n_neg FROM {matches} WHERE fdim = 'function 2' AND polarity < 0 GROUP BY ALL),
    b AS (SELECT product_id, count(*) AS n_pos FROM {matches} WHERE fdim = 'function 2' AND polarity > 0 GROUP BY ALL)
    SELECT product_id, n_neg, n_pos FROM a FULL JOIN b USING (product_id)""",
)
def _(spark, sf):
    m = SC.with_labels(table(spark, sf, "matches"), "fdim", ["function 2"])
    neg = m.filter("polarity < 0").groupBy("product_id").agg(F.count(F.lit(1)).alias("n_neg"))
    pos = m.filter("polarity > 0").groupBy("product_id").agg(F.count(F.lit(1)).alias("n_pos"))
    return J.full_outer(neg, pos, "product_id")


FIRST = "SELECT product_id, min(o) AS first_pos FROM (SELECT product_id, l_orderkey AS o FROM {reviews}) GROUP BY product_id"


@C.add("win_first_seen_order", FIRST)
def _(spark, sf):
    return RW.first_seen(table(spark, sf, "reviews"), "product_id", ["l_orderkey"])


@C.add("join_inner_order", f"WITH f AS ({FIRST}) SELECT product_id, n_total, first_pos FROM {{totals}} JOIN f USING (product_id)")
def _(spark, sf):
    r = table(spark, sf, "reviews")
    return J.attach_order(SC.n_total(r), RW.first_seen(r, "product_id", ["l_orderkey"]), "product_id")


LAST = "last AS (SELECT row_id, arg_max(error, seq) FILTER (true) AS e, max(seq) AS seq FROM {checkpoint} GROUP BY row_id), lastrow AS (SELECT c.* FROM {checkpoint} c JOIN last USING (row_id, seq))"


@C.add("dedupe_keep_last", f"WITH {LAST} SELECT row_id, seq, error, {rd('score', 'score')}, n_matches FROM lastrow")
def _(spark, sf):
    last = RW.keep_last(table(spark, sf, "checkpoint"), "row_id", "seq")
    return rounded(last.select("row_id", "seq", "error", "score", "n_matches"))


@C.add(
    "dedupe_keep_first",
    f"SELECT product_id, l_orderkey, l_linenumber, l_suppkey, {rd('l_extendedprice', 'l_extendedprice')}, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {', '.join(ORDER)}) AS rn FROM {{reviews}}) WHERE rn = 1",
)
def _(spark, sf):
    first = RW.keep_first(table(spark, sf, "reviews"), "product_id", ORDER)
    return rounded(first.select("product_id", *ORDER, "comment_id"))


@C.add(
    "join_anti_resume",
    f"WITH {LAST}, done AS (SELECT row_id FROM lastrow WHERE coalesce(error, '') = '') SELECT row_id, comment_text FROM {{todo_rows}} WHERE row_id NOT IN (SELECT row_id FROM done)",
)
def _(spark, sf):
    done = RS.valid_checkpoint(table(spark, sf, "checkpoint"), "row_id", "seq", RS.done_no_error())
    return J.todo(table(spark, sf, "todo_rows"), done, "row_id")


@C.add(
    "resume_plan",
    f"""WITH {LAST} SELECT t.row_id, CASE WHEN l.row_id IS NULL THEN 'new' WHEN coalesce(error, '') = '' THEN 'done' ELSE 'failed' END AS status
    FROM {{todo_rows}} t LEFT JOIN lastrow l ON t.row_id = l.row_id""",
)
def _(spark, sf):
    return RS.resume_plan(table(spark, sf, "todo_rows"), table(spark, sf, "checkpoint"), "row_id", "seq", RS.done_no_error())


@C.add(
    "resume_plan_sentiment",
    f"""WITH {LAST} SELECT t.row_id, CASE WHEN l.row_id IS NULL THEN 'new' WHEN score IS NOT NULL THEN 'done' ELSE 'failed' END AS status
    FROM {{todo_rows}} t LEFT JOIN lastrow l ON t.row_id = l.row_id""",
)
def _(spark, sf):
    return RS.resume_plan(table(spark, sf, "todo_rows"), table(spark, sf, "checkpoint"), "row_id", "seq", RS.done_has_score("score"))


@C.add("join_validated_1to1", f"SELECT product_id, n_reviews, brand, {rd('price', 'list_price')} FROM (SELECT product_id, n_reviews FROM {{design}}) JOIN {{products}} USING (product_id)")
def _(spark, sf):
    d = table(spark, sf, "design").select("product_id", "n_reviews")
    p = table(spark, sf, "products").select("product_id", "brand", F.col("price").alias("list_price"))
    return rounded(J.join_one_to_one(d, p, "product_id"))


@C.add("join_ordered_lookup", f"WITH f AS ({FIRST}) SELECT product_id, first_pos, brand FROM f JOIN {{products}} USING (product_id)")
def _(spark, sf):
    order = RW.first_seen(table(spark, sf, "reviews"), "product_id", ["l_orderkey"])
    return J.ordered_lookup(table(spark, sf, "products").select("product_id", "brand"), order, "product_id")


@C.add("join_rename_map", "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END::INT AS path_order FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def _(spark, sf):
    labels = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)], "o_orderpriority string, path_order int")
    return J.relabel(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), labels, "o_orderpriority")


@C.add("group_id", "SELECT product_id, brand, dense_rank() OVER (ORDER BY brand) AS id FROM {products}")
def _(spark, sf):
    return RW.group_id(table(spark, sf, "products").select("product_id", "brand"), "brand")


@C.add("dense_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS idx FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return RW.dense_index(o, ["o_custkey", "o_orderkey"]).select("o_orderkey", "idx")


@C.add("sort_stable", "SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderstatus, o_orderkey")
def _(spark, sf):
    return RW.sort_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"])


@C.add("head_n", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_returnflag, l_linenumber LIMIT 5")
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return RW.top_k(n, [F.col("n").desc(), F.col("l_returnflag"), F.col("l_linenumber")], 5)


@C.add("set_union_rows", "SELECT 'brand' AS kind, brand AS label, count(*) AS n FROM {products} GROUP BY brand UNION ALL SELECT 'flag', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    b = SM.value_counts(table(spark, sf, "products"), "brand").select(F.lit("brand").alias("kind"), F.col("brand").alias("label"), "n")
    f = SM.value_counts(table(spark, sf, "lineitem"), "l_returnflag").select(F.lit("flag").alias("kind"), "n", F.col("l_returnflag").alias("label"))
    return RW.stack_rows([b, f])


@C.add("set_difference", "SELECT c_custkey AS row_id FROM customer EXCEPT SELECT user_id FROM events")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    return RW.difference(c, table(spark, sf, "events").select(F.col("user_id").alias("row_id")), "row_id")


@C.add("chk_unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return CT.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@C.add("chk_positive_nonnull", "SELECT count(*) AS n_rows, count(*) FILTER (gap IS NULL) AS n_missing, count(*) FILTER (gap - 1 <= 0) AS n_not_positive FROM {design}")
def _(spark, sf):
    return CT.positive_report(table(spark, sf, "design").select((F.col("gap") - 1).alias("gap")), "gap")


@C.add(
    "chk_expected_keys",
    "SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)",
)
def _(spark, sf):
    have = table(spark, sf, "events").select(F.col("user_id").alias("key"))
    return CT.key_gaps(have, table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key")


NULLS = ["gap", "quantity", "price"]


@C.add(
    "chk_null_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", true AS present, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows, count(DISTINCT brand) AS n_keys FROM {{design}}"
        for c in NULLS
    )
    + " UNION ALL SELECT 'z_pc9', false, NULL, count(*), count(DISTINCT brand) FROM {design}",
)
def _(spark, sf):
    return CT.null_report(table(spark, sf, "design"), [*NULLS, "z_pc9"], key="brand")


@C.add("chk_required_columns", "SELECT product_id, brand FROM {products}")
def _(spark, sf):
    return CT.require_columns(table(spark, sf, "products"), ["product_id", "brand"]).select("product_id", "brand")


@C.add("order_guard", "SELECT o_orderkey AS pos, o_custkey AS key, 'output' AS side FROM orders WHERE o_custkey <> o_custkey % 1000 UNION ALL SELECT o_orderkey, o_custkey % 1000, 'input' FROM orders WHERE o_custkey <> o_custkey % 1000")
def _(spark, sf):
    # The expected order wraps its keys, so the guard reports exactly the wrapped positions.
    out = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("key"))
    want = out.withColumn("key", F.col("key") % 1000)
    return CT.order_mismatch(out, want, "key", "pos")
