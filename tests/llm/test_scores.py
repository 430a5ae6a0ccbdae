import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from opinara.llm import mixing, quality, queries, topk, toxicity
from opinara.llm.bpe import Encoder, vocabulary_path
from opinara.llm.buffers import text_buffer
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def counted(text):
    w = cases.words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if cases.words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts_and_measures(spark):
    coder = Encoder(vocabulary_path("byte_bpe_50k.json"))
    pieces = SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    rows = quality.measures(cases.table(spark)).select("text", "quality.*").collect()
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == counted(r.text)
        ids = coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.chars_per_token == pytest.approx(len(r.text or "") / max(1, len(ids)))
        share = [c / len(ids) for c in Counter(ids).values()]
        assert r.token_entropy == pytest.approx(-sum(s * math.log2(s) for s in share), abs=1e-9)
        own = pieces.encode(r.text or "")
        assert r.byte_fallback == pytest.approx(sum(map(pieces.is_byte, own)) / max(1, len(own)))


def test_lines_and_terms_that_cancel_out_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(0, f"{one}\n{two}"), (1, f"{one}\n{one}")], "doc_id long, text string")
    got = {r.doc_id: r.n_dup_lines for r in quality.measures(docs).select("doc_id", "quality.n_dup_lines").collect()}
    assert got == {0: 0, 1: 1}
    terms = {r.doc_id: r.n for r in docs.select("doc_id", F.size(toxicity.term_set(F.col("text"))).alias("n")).collect()}
    assert terms == {0: 2, 1: 1}


def test_byte_fallback_is_the_piece_models_own_share(spark):
    pieces = SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    texts = ["ᚠᛇᚻ ᛒᛦᚦ ᚠᚱᚩᚠᚢᚱ ᚠᛁᚱᚪ", "plain english words", "敏捷的狐狸", "Быстрая лиса", "ⴰⵣⵓⵍ", "🙂🙃", "Η αλεπού", "तेज़ भूरी", "ᏣᎳᎩ", "አማርኛ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measures(docs).select("text", "quality.byte_fallback").collect():
        own = pieces.encode(r.text)
        assert r.byte_fallback == sum(map(pieces.is_byte, own)) / len(own)
        if r.text.startswith("ᚠ"):
            assert r.byte_fallback > 0.9

def test_bands_reject_outliers_and_keep_the_rest(spark, tmp_path):
    rng = random.Random(2)
    plain = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(200)) for _ in range(60)]
    odd = [" ".join("🙂🙃🙂🙃" for _ in range(60)) + " " + " ".join(f"z{i}" for i in range(60)), " ".join(f"{'🜁' * (i % 7 + 1)}" + chr(0x10400 + i) for i in range(90)), "short text", None, ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(plain + odd)] + [(500, plain[0], None)], "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    kept = quality.quality_filter(docs, f"file://{tmp_path}/bands")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 500]
    assert quality.quality_filter(cases.empty(spark), f"file://{tmp_path}/none").count() == 0


def test_base_rules(spark):
    for r in quality.judged(quality.measures(cases.table(spark)), quality.bands(quality.measures(cases.table(spark)))).select("text", "base_failed", "kept").collect():
        n, _, _, _, repeated = counted(r.text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.kept and r.base_failed)


def highest_quotients(weights, seats, most):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(m for m, w in zip(most, weights) if w > 0))):
        i = max((i for i in range(len(weights)) if got[i] < most[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_apportionment_is_by_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        weights = rng.integers(0, 50, n).astype(float)
        most = rng.integers(0, 40, n)
        seats = int(rng.integers(0, 120))
        assert mixing.apportion(weights, seats, most).tolist() == highest_quotients(weights, seats, most)


def test_targets_stop_at_the_cap_and_share_the_rest():
    sizes = np.array([10, 1000, 400, 0])
    got = mixing.targets(sizes, np.array([3.0, 1.0, 2.0, 3.0]), 1.5 * 1410, 2.0)
    assert got.sum() == pytest.approx(1.5 * 1410) and got[0] == 20 and got[3] == 0 and (got <= 2 * sizes).all()
    assert got[2] == pytest.approx(min(800, (1.5 * 1410 - 20) * 2 / 3)) or got[2] == 800


def test_mix_plan(spark):
    docs = cases.table(spark)
    got = mixing.plan(docs).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.plan(docs.repartition(7)).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(cases.rows())
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.size == len(cases.words(r.text)) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = (r.source_size, r.target)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets(np.array([sizes[s] for s in order]), np.array([(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))]), 1.5 * sum(sizes.values()), 2.0)
    for s, t in zip(order, want):
        assert goal[s][0] == sizes[s] and goal[s][1] == pytest.approx(t)
        assert abs(taken[s] - t) <= 3 * mixing.BLOCK
    assert mixing.plan(cases.empty(spark)).count() == 0


def test_mix_rows_hold_the_words_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2_000)
    docs = cases.table(spark)
    taken, got = Counter(), Counter()
    for r in mixing.plan(docs).collect():
        taken[r.doc_id, r.text] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    texts = {}
    for r in cases.rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in mixed.collect():
        assert any(t.startswith(r.text) for t in texts[r.doc_id])
        got[r.doc_id] += len(cases.words(r.text))
    for i in texts:
        assert got[i] == sum(n for (k, _), n in taken.items() if k == i)
    assert mixing.mix(cases.empty(spark)).count() == 0


def brute_top(vectors, queries, k):
    good = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in queries:
        for own in [v for i, v in good if i == q]:
            found = sorted(((sum(int(a) * int(b) for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own)), key=lambda x: (-x[0], x[1]))
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [3, 20])
def test_top_k_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-20, 20, 24) + (i % 3) * 5]) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(300, None), (None, rows[0][1]), (301, [1.0, None] * 12), (302, [float("nan")] * 24), (303, [float("inf")] * 24), (304, [1.0, 2.0]), (320, [3.0, 4.0]), (305, []), (340, [])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("rank", F.lit(1))
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), k).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, [i for i, _ in rows if i is not None and i % 20 == 0], k)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_top_k_of_large_values(spark):
    rows = [(i, [float((i + 1) * 10**14), -float(i), 1.0]) for i in range(45)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    limit = (1 << 63) - 1
    want = [(q, r, v, max(-limit - 1, min(limit, s))) for q, r, v, s in brute_top(rows, [0, 20, 40], 45)]
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), 45).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {(q, v, s) for q, _, v, s in want}


def test_machine_score_is_the_written_formula():
    rng = np.random.default_rng(9)
    terms = np.sort(rng.integers(1, 1 << 60, 6).astype(np.uint64))
    machine = toxicity.Machine(terms, rng.normal(size=6), rng.normal(size=(6, 3)), 0.3)
    rows = [terms[[0, 2, 2, 5]], np.zeros(0, np.uint64), terms[[1]], np.array([7], np.uint64)]
    got = machine.raw(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for g, r in zip(got, rows):
        own = [i for i in range(6) if terms[i] in r]
        want = 0.3 + sum(machine.weights[i] for i in own) + sum(machine.factors[i] @ machine.factors[j] for i in own for j in own if i < j)
        assert g == pytest.approx(want)


def test_machine_learns_a_pair_that_weights_miss():
    rng = np.random.default_rng(2)
    sets, labels = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        sets.append(np.array([t for t, on in ((11, a), (22, b)) if on] + list(100 + rng.choice(300, 20, replace=False)), np.uint64))
        labels.append(int(a and b))
    machine = toxicity.fit(sets, np.array(labels))
    z = machine.raw(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert ((z > 0) == np.array(labels)).mean() > 0.98
    pair = {int(t): i for i, t in enumerate(machine.terms)}
    assert machine.factors[pair[11]] @ machine.factors[pair[22]] > 0.3


def test_machine_learns_a_pair_of_terms_equally_common_in_both_classes():
    rng = np.random.default_rng(2)
    sets, labels = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        sets.append(np.array([t for t, on in ((11, a), (22, b)) if on] + list(100 + rng.choice(300, 20, replace=False)), np.uint64))
        labels.append(int(a == b))
    machine = toxicity.fit(sets[:900], np.array(labels[:900]))
    held = sets[900:]
    z = machine.raw(np.concatenate(held), np.concatenate([[0], np.cumsum([len(s) for s in held])]))
    assert ((z > 0) == np.array(labels[900:])).mean() > 0.95


def test_machine_knows_all_terms_of_its_sample():
    sets = [np.array([i % 2, 10 + i, 10_000 + i], np.uint64) for i in range(2000)]
    machine = toxicity.fit(sets, np.arange(2000) % 2)
    assert len(machine.terms) == 4002


def test_toxicity_holds_out_a_third_and_finds_it(spark):
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect()
    truth = dict(duckdb.connect().execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    toxic = [r.predicted for r in held if truth[r.doc_id] == 1]
    clean = [r.predicted for r in held if truth[r.doc_id] == 0]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.05


def test_toxicity_of_awkward_rows(spark):
    docs = cases.table(spark).withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") % 7 > 0, 0))
    machine = toxicity.train(docs, docs)
    rows = docs.select(toxicity.toxicity(docs, machine).alias("s")).collect()
    assert len(rows) == len(cases.rows()) and all(0 <= r.s <= 1 for r in rows)
    none = toxicity.train(cases.empty(spark), cases.empty(spark).withColumn("toxic", F.lit(1)))
    assert cases.empty(spark).select(toxicity.toxicity(docs, none)).count() == 0


def test_helper_columns_give_way_to_names_of_the_input(spark, tmp_path, monkeypatch):
    names = ["n_shards__", "n_shards", "source_key", "source_key__key", "shard", "shard__key", "quota", "shard_words", "start", "mix_size", "mix_words", "size", "taken"]
    names += [f"{m}_{e}" for m in quality.MEASURES for e in ("low", "high")] + ["quality", "quality_of_text", "lang_of_text", "lang_of_text__key", "kept", "base_failed"]
    plain = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 97}" for j in range(60 + i)), "en", ["a", "b", None][i % 3]) for i in range(40)], "doc_id long, text string, lang string, source string")
    docs = plain.withColumns({c: F.lit(f"own {c}") for c in names})
    kept = quality.quality_filter(docs, f"file://{tmp_path}/bands")
    want = quality.quality_filter(plain, f"file://{tmp_path}/plain")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())
    monkeypatch.setattr(mixing, "SHARD_ROWS", 5)
    mixed, alone = mixing.mix(docs), mixing.mix(plain)
    assert mixed.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in mixed.collect()) == sorted((r.doc_id, r.text) for r in alone.collect())
    assert {r["shard__key"] for r in mixed.collect()} == {"own shard__key"}


def test_sources_of_empty_texts_are_cut_into_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.lit("a b c " * 30)).otherwise("").alias("text"), F.when(F.col("id") < 1100, "hot").otherwise("b").alias("source"))
    seen = []
    real = mixing.rows_join
    monkeypatch.setattr(mixing, "rows_join", lambda left, small, on, how: seen.append((on, small)) or real(left, small, on, how))
    got = mixing.plan(docs)
    assert got.agg(F.sum("taken")).first()[0] > 0
    on, dealt = seen[1]
    assert dealt.filter("source_key = 'hot'").count() >= 20


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "   ", "the", " word", "\n", "\t ", "ᚠᛇᚻ", "▁", "日本語", "don't", "…", "<s>", "</s>", "<0x0A>", "​", "\xa0", "ﬁ", "é", "é", "x" * 70])), max_size=8).map("".join))
def test_pieces_of_segments_are_those_of_the_text(text):
    pieces = quality.Pieces(vocabulary_path("piece_bpe_32k.model")) if not hasattr(quality, "_p") else quality._p
    quality._p = pieces
    ids = pieces.model.encode(text)
    own = [float(len(ids)), float(sum(map(pieces.model.is_byte, ids)))]
    texts = [text, "", " ", text, "a"]
    ends = [[float(len(x)), 0.0] for x in (pieces.model.encode(" "), pieces.model.encode("a"))]
    for _ in range(2):
        assert pieces.counts(*text_buffer(pa.array(texts, pa.string()))).tolist() == [own, [0.0, 0.0], ends[0], own, ends[1]]
