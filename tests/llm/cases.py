"""Small tables with the awkward rows every operator must stand."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()), T.StructField("block", T.StringType()), T.StructField("size", T.StringType())])


def words(text):
    return WORD.findall(text or "")


def texts(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["don't", "Zoë", "straße", "naïve,", "x²", "日本", "🙂", "#tag", "100%", "A|B"]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (34, 35, 36, 60, 90)]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(rng.randint(1, 4))]
        for p in rng.choices(passages, k=rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), p)
        out.append(rng.choice([" ", "\n", "\t\r\n", "\n\n  "]).join(parts))
    out += [None, "", " \n\t", "one", "one two", " ", "a b " * 70, "same line\n" * 30, " ".join(f"u{i % 9000}" for i in range(30_000)), "x" * 5000, "Ab cD <|endoftext|> it's", "'s 'll  're\x1c\x85"]
    out += out[3:9]
    return out


def rows(seed=1, n=120):
    out = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "z", "ä", ""][i % 6] if i % 5 else "b", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts(seed, n))]
    out += [out[5], out[5], (None, out[7][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (10**12, out[9][1], "en", "b", 1, None, None, None)]
    return out


def table(spark, seed=1, n=120):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
