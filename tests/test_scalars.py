from pyspark.sql import functions as F

from opinara.functions import ids, responses
from opinara.functions import scalars as S
from opinara.functions.text import strip_fence
from opinara.operators.standardize import zscore

import pytest


def column(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("o"), "i").orderBy("i").collect()]


IDS = ["1—1", "1–1", "1－1", "(1)-2", "1--1", None, "abc", "01-02.xlsx", "　3-4 "]


@pytest.mark.parametrize(
    "fn, want",
    [
        (ids.norm_id_dashes, ["1-1", "1-1", "1-1", "(1)-2", "1--1", "", "abc", "01-02.xlsx", "3-4"]),
        (ids.norm_id_digits, ["1-1", "1-1", "1-1", "1-2", "1-1", None, "abc", "1-2", "3-4"]),
        (ids.norm_id_paren, [None, None, None, "1-2", "1-1", None, None, None, "3-4"]),
        (ids.norm_id_two_dash, ["1-1", "1-1", "1－1", "(1)-2", "1--1", None, "abc", "01-02.xlsx", "3-4"]),
        (ids.product_id_from_name, [None, None, None, None, None, None, None, "01-02", None]),
    ],
)
def test_id_variants(spark, fn, want):
    assert column(spark, IDS, fn) == want


def test_parse_score(spark):
    texts = ["0.5", "-0.7分", ".5", "2", "０.5", "", None, "good", "-3", "3."]
    assert column(spark, texts, S.parse_score) == [0.5, -0.7, 1.0, 1.0, 0.5, None, None, None, -1.0, 1.0]


def test_logit_examples(spark):
    got = column(spark, [0.85, 1.0], S.logit, "v double")
    assert [round(x, 2) for x in got] == [1.73, 6.91]


def test_numeric_cleaning(spark):
    assert column(spark, ["1.5", "x", "NaN", "Infinity", None, ""], S.to_double) == [1.5, None, None, None, None, None]
    assert column(spark, [0.5, 4.0, None], S.log_clip, "v double")[0] == 0.0
    assert column(spark, [0.5, 4.0, None], S.log_clip, "v double")[2] is None


def test_sign_rules(spark):
    df = spark.createDataFrame([(1, False), (1, True), (-1, False), (-1, True), (1, None)], "p int, n boolean")
    rows = df.select(S.signed_value(F.col("p"), F.lit(0.7), F.col("n"))).collect()
    assert [r[0] for r in rows] == [0.7, -0.7, -0.7, 0.7, 0.7]


def test_degree_default(spark):
    w = {"很": 1.0, "挺": 0.7}
    assert column(spark, ["很", " 挺　", "", None, "zzz"], lambda c: S.degree_weight(c, w)) == [1.0, 0.7, 0.8, 0.8, 0.8]


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    got = [tuple(r) for r in df.select(S.row_mean([F.col("a"), F.col("b")]), S.row_nonnull([F.col("a"), F.col("b")])).collect()]
    assert got == [(1.0, 1), (None, 0), (1.5, 2)]


def test_constant_columns(spark):
    df = spark.createDataFrame([(0.1, None, None), (0.1, 2.0, None), (0.1, 2.0, None)], "a double, b double, c double")
    zero = zscore(df, ["a", "b", "c"], on_constant="zero").select("a_z", "b_z", "c_z").collect()
    assert [tuple(r) for r in zero] == [(0.0, 0.0, 0.0)] * 3
    seen = zscore(df, ["a", "b", "c"], on_constant="zero_observed").select("b_z", "c_z").collect()
    assert [tuple(r) for r in seen] == [(None, None), (0.0, None), (0.0, None)]
    with pytest.raises(Exception, match="cannot standardise"):
        zscore(df, ["a"], ddof=1, on_constant="raise").collect()


def test_fence(spark):
    fenced = ["```json\n{}\n```", "```{}```", " {} ", None]
    assert column(spark, fenced, strip_fence) == ["{}", "{}", "{}", None]


ELEMENTS = [
    ('{"dimension":"d","span":"ab","polarity":1}', (1, "", False)),
    ('{"dimension":"d","span":"ab","polarity":1.0,"negated":"false"}', (1, "", True)),
    ('{"dimension":"d","span":"ab","polarity":true,"degree_word":null,"negated":0}', (1, "", False)),
    ('{"dimension":"d","span":"ab","polarity":0,"degree_word":"x","negated":null}', (0, "x", False)),
    ('{"dimension":"d","span":"ab","polarity":"1"}', None),
    ('{"dimension":"d","span":"ab","polarity":2}', None),
    ('{"dimension":"d","span":"ab"}', None),
    ('{"dimension":"d","span":"zz","polarity":1}', None),
    ('{"dimension":"e","span":"ab","polarity":1}', None),
    ('{"dimension":"d","span":"","polarity":1}', None),
    ('{"dimension":"d","span":5,"polarity":1}', None),
    ("7", None),
]


def test_element_typing(spark):
    raw = [(i, "xaby", f'{{"matches":[{e}]}}') for i, (e, _) in enumerate(ELEMENTS)]
    df = spark.createDataFrame(raw, "i int, text string, raw string")
    out = responses.validate_matches(responses.parse_matches(df, "raw"), "text", ["d"]).orderBy("i").collect()
    for (_, want), row in zip(ELEMENTS, out):
        if want is None:
            assert (row["valid"], row["n_invalid"]) == ([], 1)
        else:
            m = row["valid"][0]
            assert (m["polarity"], m["degree_word"], m["negated"]) == want


def test_parse_errors(spark):
    cases = [
        (None, "empty"), ("", "empty"), ("hello", "no_json_block"), ('x {"matches":[} y', "json_parse_fail"),
        ("[1]", "no_matches_key"), ('{"a":1}', "no_matches_key"), ('{"matches":{}}', "matches_not_list"),
        ('{"matches":null}', "matches_not_list"), ('{"matches":[]}', None), ('ok: {"matches":[]} end', None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, raw string")
    got = [r["parse_error"] for r in responses.parse_matches(df, "raw").orderBy("i").collect()]
    assert got == [e for _, e in cases]
