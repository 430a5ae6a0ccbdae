"""Worked reviews for the default vocabularies. Differences from a reader's judgement are noted."""

import json
import random
import re
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from opinara.lexicons import affective_rules, functional_rules
from opinara.operators import lexicon_table as LT
from opinara.operators.lexicon import Rules, Seed, lexicon_extract
from opinara.sources import readers as RD


def run(spark, text, rules):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = lexicon_extract(df, "text", rules, ["id"]).orderBy("match_id").collect()
    return [(r["dimension"], r["span"], r["polarity"], r["degree_word"], r["negated"]) for r in rows]


def test_affective_example(spark):
    got = run(spark, "桌子非常高级,做工有点粗糙,不轻薄,挺大气的,颜值很高", affective_rules())
    assert got == [
        ("高级-廉价", "高级", 1, "非常", False),
        ("精致美观-粗糙难看", "粗糙", -1, "有点", False),
        ("厚重-轻薄", "轻薄", -1, "", True),
        ("简约大气-复杂凌乱", "大气", 1, "挺", False),
        # The degree word follows the seed here; only five weak words may follow, so it does not count.
        ("精致美观-粗糙难看", "颜值", 1, "", False),
    ]


def test_exclusions_and_longest_seed(spark):
    got = run(spark, "板子很厚实,看起来沉稳大方,百搭好看,挺稳当的", affective_rules())
    assert [g[:3] for g in got] == [
        ("厚重-轻薄", "厚实", 1),
        ("厚重-轻薄", "沉稳", 1),
        ("简约大气-复杂凌乱", "大方", 1),
        ("精致美观-粗糙难看", "百搭", 1),
        ("精致美观-粗糙难看", "好看", 1),
    ]


def test_functional_example(spark):
    got = run(spark, "升降很丝滑没有声音,桌子也很稳,有点异味", functional_rules())
    assert [g[:4] for g in got] == [
        ("升降功能", "丝滑", 1, "很"),
        # The three-character window reaches over the neighbouring hit; a reader would leave this one unmarked.
        ("噪音控制", "没有声音", 1, "很"),
        ("稳定性承重", "很稳", 1, ""),
        ("异味环保", "异味", -1, "有点"),
    ]


def test_window_crosses_neighbouring_hits(spark):
    rules = Rules([Seed("ab", "d", 1)], {"x": 1.0, "bx": 0.4}, {"yy": 0.4}, ["no"], ["nob"])
    assert run(spark, "abxab", rules) == [("d", "ab", 1, "", False), ("d", "ab", 1, "x", False)]
    assert run(spark, "no ab", rules)[0][4] is True
    assert run(spark, "no  ab", rules)[0][4] is False
    assert run(spark, "ab yy", rules)[0][3] == "yy"
    assert run(spark, "ab   yy", rules)[0][3] == ""


@pytest.mark.parametrize("text", ["", None, "nothing here"])
def test_no_hits(spark, text):
    assert run(spark, text, affective_rules()) == []


def brute(text, rules):
    """Scan with plain Python over the whole text."""
    seeds, out, i, k = rules.by_text(), [], 0, 0
    ordered = sorted(seeds, key=lambda t: (-len(t), t))
    while i < len(text):
        hit = next((t for t in ordered if text.startswith(t, i)), None)
        if hit is None:
            i += 1
            continue
        before, after = text[max(0, i - 3) : i], text[i + len(hit) :]
        masked = before + hit
        for p in rules.negation_exceptions:
            masked = masked.replace(p, "\u0003" * len(p))
        neg = any(w in masked[: len(before)] for w in rules.negations)
        words = [(v, len(w), w) for w, v in rules.degrees.items() if w in before]
        words += [(v, len(w), w) for w, v in rules.degrees_after.items() if w in after[: 2 + len(w)]]
        if not seeds[hit].excluded:
            out.append((seeds[hit].dimension, hit, seeds[hit].polarity, max(words)[2] if words else "", neg))
        i += len(hit)
        k += 1
    return out


def test_against_brute_force(spark):
    from catalog.texts import RULES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in lexicon_extract(docs, "text", RULES, ["doc_id"]).orderBy("doc_id", "match_id").collect():
        got.setdefault(r["doc_id"], []).append((r["dimension"], r["span"], r["polarity"], r["degree_word"], r["negated"]))
    for doc in docs.collect():
        assert got.get(doc["doc_id"], []) == brute(doc["text"], RULES)


def plain_matches(text, rules):
    """Leftmost-longest over the whole text by a dictionary of lengths, windows as in ``brute``."""
    seeds = rules.by_text()
    sizes, out, i, k = sorted({len(s) for s in seeds}, reverse=True), [], 0, 0
    while text and i < len(text):
        hit = next((text[i : i + n] for n in sizes if text[i : i + n] in seeds), None)
        if hit is None:
            i += 1
            continue
        before, after = text[max(0, i - 3) : i], text[i + len(hit) :]
        masked = before + hit
        for p in rules.negation_exceptions:
            masked = masked.replace(p, "\u0003" * len(p))
        words = [(v, len(w), w) for w, v in rules.degrees.items() if w in before]
        words += [(v, len(w), w) for w, v in rules.degrees_after.items() if w in after[: 2 + len(w)]]
        if not seeds[hit].excluded:
            out.append((k, seeds[hit].dimension, hit, seeds[hit].polarity, max(words)[2] if words else "", any(w in masked[: len(before)] for w in rules.negations)))
        i += len(hit)
        k += 1
    return out


def seed_dictionary(seeds):
    """The nested dictionary that the seed reader takes."""
    kinds = {(1, False): "positive_seeds", (-1, False): "negative_seeds", (0, False): "trigger_words", (0, True): "exclude_words"}
    out = {"_meta": {"note": "left out"}}
    for s in seeds:
        out.setdefault(s.dimension, {}).setdefault(kinds[s.polarity, s.excluded], []).append(s.text)
    return json.dumps(out, ensure_ascii=False)


def from_files(spark, tmp_path, rules, docs):
    place = lambda name, body: (tmp_path / name).write_text(body, encoding="utf-8") and f"file://{tmp_path}/{name}"
    seeds = RD.read_seed_lexicon(spark, place("seeds.json", seed_dictionary(rules.seeds)), "f")
    before = RD.read_weight_lexicon(spark, place("degrees.json", json.dumps({"weight_lookup": {"_note": 1, **rules.degrees}})))
    after = RD.read_weight_lexicon(spark, place("after.json", json.dumps({"weight_lookup": dict(rules.degrees_after)})))
    words = place("negations.json", json.dumps({"negation_words": list(rules.negations), "exception_phrases": {"phrases": list(rules.negation_exceptions)}}))
    found = LT.extract_from_tables(docs, "text", seeds, ["id", "match_id_"], before, after, RD.read_word_list(spark, words, "negation_words"), RD.read_word_list(spark, words, "exception_phrases.phrases"))
    assert found.columns == ["id", "match_id_", "match_id", "dimension", "span", "polarity", "degree_word", "negated"]
    out = {}
    for r in found.collect():
        out.setdefault(r[0], []).append(tuple(r[2:]))
    return {k: sorted(v) for k, v in out.items()}


def test_tables_give_the_worked_rules(spark, tmp_path):
    texts = ["桌子非常高级,做工有点粗糙,不轻薄,挺大气的,颜值很高", "板子很厚实,看起来沉稳大方,百搭好看,挺稳当的", "", None, "nothing", "不不错高级", "无论高级还行", "高级高级感很次"]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "id int, match_id_ string, text string")
    for rules in (affective_rules(), functional_rules()):
        got = from_files(spark, tmp_path, rules, docs)
        assert got == {i: plain_matches(t, rules) for i, t in enumerate(texts) if t and plain_matches(t, rules)}


@pytest.mark.parametrize("shard", [4_000_000, 150_000])
def test_a_hundred_thousand_seeds_from_json(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(LT, "SHARD_CHARACTERS", shard)
    rng = random.Random(6)
    word = lambda k: "".join(rng.choices("abcdeé好差", k=k))
    texts = {word(rng.randint(4, 9)) for _ in range(100_000)}
    while len(texts) < 100_000:
        texts.add(word(rng.randint(6, 9)))
    seeds = [Seed(t, f"d{i % 7}", *rng.choice([(1, False), (-1, False), (0, False), (0, True)])) for i, t in enumerate(sorted(texts))]
    rules = Rules(seeds, {"a": 1.0, "ab": 1.0, "好差a": 0.7}, {"e": 0.4, "bc": 0.4}, ["é", "差"], ["éa", "差好"])
    rules = Rules(rules.seeds, rules.degrees, rules.degrees_after, rules.negations, sorted(rules.negation_exceptions, key=lambda w: (-len(w), w)))
    docs = [word(rng.randint(0, 300)) for _ in range(60)] + [None, "", sorted(texts)[5], "z" * 50, word(20_000)]
    frame = spark.createDataFrame([(i, "x", t) for i, t in enumerate(docs)], "id int, match_id_ string, text string").repartition(3)
    want = {i: plain_matches(t, rules) for i, t in enumerate(docs) if t}
    assert from_files(spark, tmp_path, rules, frame) == {i: v for i, v in want.items() if v}
    assert sum(map(len, want.values())) > 1000


def test_repeated_seeds_have_one_meaning(spark):
    rows = [("ab", "y", 1, False), ("ab", "x", -1, False), ("ab", "x", 1, False), ("cd", "x", 1, False), ("cd", "z", 0, True), (None, "x", 1, False), ("", "x", 1, False)]
    seeds = spark.createDataFrame(rows, LT.SEEDS)
    assert {tuple(r) for r in LT.one_meaning(seeds).collect()} == {("ab", "x", 1, False), ("cd", "z", 0, True)}
    docs = spark.createDataFrame([(1, "cdab"), (1, "cdab"), (2, None)], "id int, text string")
    got = LT.extract_from_tables(docs, "text", seeds, ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 1, "x", "ab", 1, "", False)] * 2
    assert LT.extract_from_tables(docs, "text", seeds.limit(0), ["id"]).count() == 0
    assert LT.extract_from_tables(docs.limit(0), "text", seeds, ["id"]).count() == 0


def test_guidance_phrases(spark):
    got = run(spark, "质量很好,带USB,看着不廉价,做工质量不差,地方不够", functional_rules())
    assert [g[:3] for g in got] == [("材质做工", "质量很好", 1), ("操控智能", "带USB", 1), ("材质做工", "做工质量不差", 1), ("空间尺寸", "不够", -1)]


def test_a_batch_of_many_hits_is_cut(spark):
    """Few hits at a time are Python objects, whatever the rows of a batch; a text of more hits goes alone."""
    cuts = list(LT._slices(np.full(60, 3 * LT.HELD // 7)))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(60)) and max(b - a for a, b in cuts) == 2
    assert list(LT._slices(np.array([5 * LT.HELD, 1, 0]))) == [(0, 1), (1, 3)] and not list(LT._slices(np.zeros(0, int)))
    seeds = spark.createDataFrame([("ab", "x", 1, False), ("cd", "y", 0, True)], LT.SEEDS)
    docs = [(i, ("ab" * (i % 7) + "cd") * (i % 5) or None) for i in range(300)] + [(300, "abcd" * (LT.HELD // 3))]
    want = [(i, k) for i, t in docs for k, m in enumerate(re.findall("ab|cd", t or "")) if m == "ab"]
    found = LT.extract_from_tables(spark.createDataFrame(docs, "id int, text string"), "text", seeds, ["id"])
    assert found.filter("span = 'ab' AND dimension = 'x' AND polarity = 1").select("id", "match_id").toPandas().sort_values(["id", "match_id"]).to_numpy().tolist() == [list(w) for w in want]
    assert found.count() == len(want)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= LT.BATCH


def in_process(texts, rules):
    """Matches of texts by the function that runs in the workers."""
    seeds = rules.by_text()
    columns = [[*seeds], [x.dimension for x in seeds.values()], pa.array([x.polarity for x in seeds.values()], pa.int32()), [x.excluded for x in seeds.values()]]
    modifiers = LT.Modifiers(dict(rules.degrees), dict(rules.degrees_after), set(rules.negations), list(rules.negation_exceptions))
    run = LT._single(SimpleNamespace(value=pa.table(columns, LT.SEED_FIELDS)), f"{random.random()}", SimpleNamespace(value=modifiers), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["k0", "text"])
    out = {i: [] for i in range(len(texts))}
    for part in run([batch]):
        for r in zip(*[c.to_pylist() for c in part.columns]):
            out[r[0]].append(r[1:])
    return out


def test_random_rules_against_plain_python():
    """Few letters, so that seeds, degree words, negations and phrases overlap in every way."""
    rng = random.Random(4)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "aé好𝒳d", "abcdefgh"])
        word = lambda low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
        some = lambda most, low, high: sorted({word(low, high) for _ in range(rng.randint(0, most))})
        seeds = [Seed(t, f"d{rng.randint(0, 3)}", rng.randint(-1, 1), rng.random() < 0.2) for t in some(12, rng.choice([1, 3]), rng.choice([4, 30])) or ["a"]]
        weights = lambda t: {w: rng.choice([0.4, 0.7, 1.0]) for w in t}
        phrases = sorted(some(5, 1, 5), key=lambda w: (-len(w), w))
        rules = Rules(seeds, weights(some(4, 1, 4)), weights(some(4, 1, 9)), some(4, 1, 4), phrases)
        texts = [word(0, 60) for _ in range(12)] + [None, "", seeds[0].text, word(0, 3) + seeds[-1].text]
        assert in_process(texts, rules) == {i: plain_matches(t, rules) for i, t in enumerate(texts)}


def test_a_hash_that_deceives():
    """With factor 1 the hash is the sum of the characters: words made of the same ones look alike until they are compared."""
    for seeds, text, want in [(["abc", "cd"], "bcacdxabcd", [(3, 1), (6, 0)]), (["ab", "x"], "baxab", [(2, 1), (3, 0)]), (["ba", "d"], "abadba", [(1, 0), (3, 1), (4, 0)])]:
        words, texts = LT.Words(pa.array(seeds)), LT.Texts(pa.array([text]), 9)
        assert words._built(np.uint64(1))
        starts, number = texts.hits(words)
        assert list(zip((starts - texts.begins[0]).tolist(), number.tolist())) == want


def test_overlaps_settle_side_by_side_as_one_after_another(monkeypatch):
    rng = np.random.default_rng(2)
    for few in (0, 4):
        monkeypatch.setattr(LT, "FEW", few)
        for _ in range(200):
            starts = np.flatnonzero(rng.random(rng.integers(1, 80)) < rng.random())
            ends, free, want = starts + rng.integers(1, rng.integers(2, 12), len(starts)), 0, []
            for i, (a, b) in enumerate(zip(starts, ends)):
                if a >= free:
                    want.append(i)
                    free = b
            assert LT.settled(starts, ends).tolist() == want


def test_words_that_hold_the_mask():
    """A negation or a phrase may hold the character that masks phrases; then the whole span counts."""
    rng, letters = random.Random(8), "ab" + LT.MASK
    for _ in range(200):
        word = lambda low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
        phrases = sorted({word(1, 3) for _ in range(3)}, key=lambda w: (-len(w), w))
        modifiers = LT.Modifiers({}, {}, {word(1, 3), word(1, 3)}, phrases)
        texts, spans = LT.Texts(pa.array(body := [word(4, 9) for _ in range(9)]), 9), []
        starts = texts.begins + [rng.randint(0, len(t) - 1) for t in body]
        for t, at in zip(body, starts - texts.begins):
            spans.append(t[at:])
        want = [modifiers.negated(t[max(0, at - 3) : at], t[at:]) for t, at in zip(body, starts - texts.begins)]
        assert modifiers.around(texts.points, starts, texts.begins + texts.sizes, pa.array(spans))[1].to_pylist() == want


def test_a_hit_costs_less_than_in_plain_python(spark):
    """Hits are worked on together: a million take less time than one by one, by a scan without an automaton or Spark."""
    rng = random.Random(5)
    seeds = sorted({"".join(rng.choices("abcdefghijkl", k=rng.randint(5, 7))) for _ in range(30_000)})
    rules = Rules([Seed(s, "x", 1) for s in seeds], {"a": 1.0, "bc": 0.7}, {"de": 0.4, "fgh": 0.4}, ["ab", "c"], ["bca", "cd"])
    docs = [" ".join(rng.choices(seeds, k=2000)) for _ in range(500)]
    began = time.thread_time()
    want = [plain_matches(t, rules) for t in docs[:25]]
    plain = (time.thread_time() - began) / sum(map(len, want))
    table = spark.createDataFrame([(s, "x", 1, False) for s in seeds], LT.SEEDS)
    weights = lambda words: spark.createDataFrame([*words.items()], "word string, weight double")
    listed = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    frame = spark.createDataFrame([*enumerate(docs)], "id int, text string").coalesce(1)
    found = LT.extract_from_tables(frame, "text", table, ["id"], weights(rules.degrees), weights(rules.degrees_after), listed(rules.negations), listed(rules.negation_exceptions))
    first = sorted(tuple(r)[1:] for r in found.filter("id = 7").collect())
    assert first == want[7]
    began = time.time()
    rows = found.selectExpr("count(*)", "count(degree_word)").first()[0]
    assert rows > 900_000 and time.time() - began < rows * plain
