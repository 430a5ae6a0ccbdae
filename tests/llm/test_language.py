import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import language_mix
from opinara.llm.queries import op12_language_mix
from tests.llm import cases

SCHEMA = "doc_id long, text string, lang string, share double, gram string, score string"
SOUND = {"aa": ["tion", "the", "ing", "wh", "ea"], "bb": ["schö", "keit", "ung", "zu", "ei"], "cc": ["жил", "был", "тот", "ка", "ой"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(SOUND[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=4):
    rng = random.Random(seed)
    rows = [(i, speak(rng, lang, rng.randint(1, 60)) + rng.choice(["", ".", " 12 #!", "\n"]), lang) for i, lang in enumerate(rng.choices(list(SOUND), [6, 2, 1], k=90))]
    rows += [(100 + i, t, "aa") for i, t in enumerate([None, "", " 12 34 !?", "x"])]
    rows += [(200, speak(rng, "aa", 200), None), (None, speak(rng, "bb", 5), "bb"), rows[3], rows[3]]
    return [(*r, 0.5, "gram", "clash") for r in rows]


def grams(text):
    low = "".join(c if c.isalpha() else "\0" for c in (text or "").lower())
    padded = "\0" + low + "\0"
    return Counter(padded[i : i + 3] for i in range(len(low)) if low[i] != "\0")


def plain_model(rows):
    counts = {}
    for _, text, lang, *_ in rows:
        if lang is not None:
            own = grams(text)
            counts.setdefault(lang, Counter()).update(own)
            for g, n in own.items():
                counts[lang][g[1]] += n
    names = sorted(x for x in counts if counts[x])
    total = {x: sum(n for g, n in counts[x].items() if len(g) == 1) for x in names}
    every = {g for x in names for g in counts[x]}
    pooled = {g: sum(counts[x][g] / total[x] for x in names) / len(names) for g in every}
    return names, {g: [math.log((counts[x][g] + language_mix.PRIOR * pooled[g]) / (total[x] + language_mix.PRIOR)) for x in names] for g in every}


def plain_em(found, share, rounds):
    n = sum(k for k, _ in found)
    for _ in range(rounds):
        new = [0.0] * len(share)
        for k, p in found:
            joint = [s * x for s, x in zip(share, p)]
            for j, x in enumerate(joint):
                new[j] += k * x / sum(joint) / n
        share = new
    return share, sum(k * math.log(sum(s * x for s, x in zip(share, p))) for k, p in found)


def plain(names, model, text):
    """Language, score and shares of one text, one trigram at a time."""
    own = Counter()
    for g, n in grams(text).items():
        if g in model or g[1] in model:
            own[g if g in model else g[1]] += n
    if not grams(text):
        return "und", 0.0, {}
    if not own:
        return names[0], 1 / len(names), {names[0]: 1.0}
    found = [(n, [math.exp(x) for x in model[g]]) for g, n in own.items()]
    each = [sum(n * model[g][j] for g, n in own.items()) for j in range(len(names))]
    share, _ = plain_em(found, [1 / len(names)] * len(names), language_mix.ROUNDS)
    top = max(range(len(names)), key=lambda j: each[j])
    ranked = [top] + sorted((j for j in range(len(names)) if j != top), key=lambda j: -share[j])
    best, value = {top: 1.0}, each[top]
    for s in range(2, len(names) + 1):
        if share[ranked[s - 1]] <= language_mix.SURE:
            break
        start = [max(x, language_mix.SURE) * (j in ranked[:s]) for j, x in enumerate(share)]
        got, likely = plain_em(found, [x / sum(start) for x in start], language_mix.ROUNDS)
        likely -= language_mix.PENALTY * (s - 1) * math.log(max(sum(own.values()), 2))
        if likely <= value:
            break
        best, value = {j: got[j] for j in ranked[:s]}, likely
    lead = max(best, key=lambda j: best[j])
    sure = best[lead] if len(best) > 1 else 1 / sum(math.exp(min(max(x - each[lead], -700), 50)) for x in each)
    return names[lead], sure, {names[j]: x for j, x in best.items()}


@pytest.mark.parametrize("slice_size", [7, 1 << 18])
def test_predictions_against_plain_python(spark, monkeypatch, slice_size):
    monkeypatch.setattr(language_mix, "SLICE", slice_size)
    monkeypatch.setattr(language_mix, "HELD", 50)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    rng = random.Random(9)
    texts = [r[1] for r in rows] + [speak(rng, "aa", 40) + " " + speak(rng, "bb", 40), speak(rng, "cc", 30) + "\n" + speak(rng, "aa", 90), "Ωμέγα ψ", "日本語", "123", "ꙮ", "İIı"]
    asked = spark.createDataFrame([(i, t, "wrong", 0.0, "g", "s") for i, t in enumerate(texts)], SCHEMA)
    model = language_mix.train(docs)
    names, logs = plain_model(rows)
    assert model.languages == names and len(model.keys) == len(logs)
    got = {r.doc_id: r.s for r in asked.select("doc_id", language_mix.languages(asked, model).alias("s")).collect()}
    for i, t in enumerate(texts):
        lang, score, mix = plain(names, logs, t)
        assert got[i].lang == lang and got[i].score == pytest.approx(score, abs=1e-9), t
        assert {m.lang: m.share for m in got[i].mix} == pytest.approx(mix, abs=1e-9)
    both = got[len(rows)].mix
    assert {m.lang for m in both} == {"aa", "bb"} and all(m.share > 0.3 for m in both)


def test_small_tables_fall_back_to_letters(spark, monkeypatch):
    monkeypatch.setattr(language_mix, "TABLE_CELLS", 120)
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = language_mix.train(docs)
    assert 0 < (model.keys > 0).sum() <= 40 and 0 < (model.keys < 0).sum() <= 40
    rng = random.Random(2)
    asked = spark.createDataFrame([(i, speak(rng, lang, 40), lang, 0.0, "", "") for i, lang in enumerate(list(SOUND) * 5)], SCHEMA)
    assert asked.filter(language_mix.languages(asked, model)["lang"] != F.col("lang")).count() == 0


def test_without_languages_and_too_many(spark, monkeypatch):
    none = language_mix.train(cases.empty(spark))
    table = cases.table(spark)
    got = table.select(language_mix.languages(table, none).alias("s")).select("s.*").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0, [])]
    assert cases.empty(spark).select(language_mix.languages(cases.empty(spark), none)).count() == 0
    monkeypatch.setattr(language_mix, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_mix.train(spark.createDataFrame(corpus(), SCHEMA))


def test_one_language_and_awkward_texts(spark):
    table = cases.table(spark)
    model = language_mix.train(table.filter("lang = 'en'"))
    rows = table.select("text", language_mix.languages(table, model).alias("s")).collect()
    for r in rows:
        has = any(c.isalpha() for c in (r.text or "").lower())
        assert (r.s.lang, r.s.score) == (("en", 1.0) if has else ("und", 0.0))


def test_one_very_long_text(spark):
    rng = random.Random(1)
    long = speak(rng, "bb", 400_000)
    docs = spark.createDataFrame([*corpus(), (9000, long, "bb", 0.0, "", "")], SCHEMA)
    model = language_mix.train(docs)
    got = docs.filter("doc_id = 9000").select(language_mix.languages(docs, model).alias("s")).first().s
    assert got.lang == "bb" and len(long) > 2_000_000


def test_held_out_accuracy(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        truth = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang", "text")
        got = op12_language_mix(spark, path).join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").toPandas()
        assert (got.lang_pred == got.lang).mean() > 0.98
        assert got.score.between(0, 1).all() and np.isfinite(got.score).all()
