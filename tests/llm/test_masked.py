import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinara.llm import masked_lm
from opinara.llm.buffers import spans, text_buffer, word_hashes
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def hash_of(word):
    data, offsets = text_buffer(pa.array([word], pa.string()))
    return int(word_hashes(data, *spans(data, offsets)[:2])[0])


def plain_scores(words, model, texts):
    """Scores word by word, from counts of all texts."""
    counts = Counter(w for t in texts for w in cases.words(t))
    place = {int(h): i for i, h in enumerate(words.hashes.tolist())}
    row = {w: int(words.row[place[hash_of(w)]]) if hash_of(w) in place else words.rows - 1 for w in counts}
    kind = {w: int(words.classes[r]) for w, r in row.items()}
    total = Counter()
    for w, n in counts.items():
        total[kind[w]] += n
    total[masked_lm.CLASSES - 1] += masked_lm.UNSEEN
    embed, weights = model["embed"].astype(float), model["class_w"].astype(float)
    for text in texts:
        own, out = cases.words(text), 0.0
        for i, w in enumerate(own):
            hidden = np.zeros(masked_lm.WIDTH)
            for j, d in enumerate([-2, -1, 1, 2]):
                hidden += embed[row[own[i + d]] if 0 <= i + d < len(own) else words.rows] * model["offset"][j]
            z = weights @ np.tanh(hidden) + model["class_b"]
            out += z[kind[w]] - math.log(np.exp(z).sum()) + math.log(counts[w] / total[kind[w]])
        yield out


@pytest.mark.parametrize(("head", "rows", "common"), [(1 << 18, 1 << 14, 64), (30, 5, 2)])
def test_scores_against_plain_python(spark, monkeypatch, head, rows, common):
    for name, value in (("HEAD", head), ("ROWS", rows), ("COMMON", common), ("HELD", 200)):
        monkeypatch.setattr(masked_lm, name, value)
    docs = cases.table(spark, 5, 40).filter("text IS NULL OR length(text) < 20000")
    rows = docs.collect()
    words = masked_lm.vocabulary(docs)
    encoded = masked_lm.encode(docs, words)
    model = masked_lm.train(encoded, words, rounds=1)
    names = [c for c in docs.columns if c != "text"]
    got = masked_lm.score(encoded, words, model, names)
    assert got.columns == [*names, "n_words", "log_likelihood"]
    want = plain_scores(words, model, [r.text for r in rows])
    key = lambda i, n, s: (i is None, i or 0, n, round(s, 1))
    found, wanted = sorted(key(r[0], r[-2], r[-1]) for r in got.collect()), sorted(key(r.doc_id, len(cases.words(r.text)), s) for r, s in zip(rows, want))
    assert [x[:3] for x in found] == [x[:3] for x in wanted]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in wanted], rel=1e-4, abs=0.2)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "a a a b b c d e f"), (1, "a b g")], "doc_id long, text string")
    words = masked_lm.vocabulary(docs)
    model = masked_lm.initial(words.rows)
    around = np.full((masked_lm.CLASSES, 2 * masked_lm.SIDE), 3)
    assert np.exp(masked_lm.log_probabilities(model, np.arange(masked_lm.CLASSES), around)).sum() == pytest.approx(1.0, abs=1e-4)
    # Shares within the classes, the half for words that the corpus lacks included.
    head = {int(h) for h in words.hashes.tolist()}
    rare = [r.n for r in words.counts.collect() if r.h % (1 << 64) not in head]
    inside = np.bincount(words.classes[words.row], np.exp(words.share), masked_lm.CLASSES)
    inside[-1] += (sum(rare) + masked_lm.UNSEEN) / math.exp(words.rest)
    assert inside[inside > 0] == pytest.approx(1.0)


def test_words_beyond_the_head_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "HEAD", 2)
    rows = [(0, "the of the of once"), (1, "the of the of twice"), (2, "the of the of twice"), (3, "the of the of thrice thrice thrice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in masked_lm.pseudo_likelihood(docs).collect()}
    assert got[1] - got[0] == pytest.approx(math.log(2), abs=1e-3) and got[1] == pytest.approx(got[2])
    # A word that the corpus lacks counts half.
    words = masked_lm.vocabulary(docs)
    model = masked_lm.train(masked_lm.encode(docs, words), words)
    both = spark.createDataFrame([(0, "the of the of never"), (1, "the of the of once")], "doc_id long, text string")
    new = {r.doc_id: r.log_likelihood for r in masked_lm.score(masked_lm.encode(both, words), words, model, ["doc_id"]).collect()}
    assert new[0] - new[1] == pytest.approx(-math.log(2), abs=1e-4)


def test_vocabulary_grows_with_the_corpus(spark):
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        words = masked_lm.vocabulary(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        sizes.append((words.counts.count(), len(words.hashes), words.rows))
    assert all(b > 2 * a for a, b in zip(*sizes))


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 50, 4000)
    around = np.stack([base] * 4, 1)
    model = masked_lm.initial(60)
    memory = {k: np.zeros(s, np.float32) for k, s in masked_lm.shapes(60).items()}
    before = masked_lm.log_probabilities(model, base, around).mean()
    for _ in range(60):
        masked_lm.learn(model, base, around, memory)
    assert masked_lm.log_probabilities(model, base, around).mean() > before + 2


def test_training_helps_and_uses_every_position(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = masked_lm.vocabulary(docs)
    encoded = masked_lm.encode(docs, words, keep=["doc_id"])
    start, model = masked_lm.initial(words.rows), masked_lm.train(encoded, words)
    mean = lambda m: masked_lm.score(encoded, words, m).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(model) > mean(start) + 0.3
    # Vectors of all words that occur have moved.
    seen = np.unique(np.concatenate([np.frombuffer(r.words, np.uint16) for r in encoded.select("words").collect()]))
    assert (model["embed"][seen] != start["embed"][seen]).any(axis=1).mean() > 0.99


def test_model_of_nothing(spark):
    words = masked_lm.vocabulary(cases.empty(spark))
    encoded = masked_lm.encode(cases.empty(spark), words)
    assert masked_lm.flat(masked_lm.train(encoded, words)).tolist() == masked_lm.flat(masked_lm.initial(words.rows)).tolist()
    assert masked_lm.pseudo_likelihood(cases.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert {r.log_likelihood for r in masked_lm.pseudo_likelihood(blank).collect()} == {0.0}
