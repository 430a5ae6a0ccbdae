import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opinara.llm import buffers, simhash, substring_dedup
from tests.llm import cases


def without_repeats(texts, size=35):
    split = [cases.words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


def by_row(rows):
    return sorted(rows, key=repr)


def test_cover_is_a_difference_cover():
    apart = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert apart == set(range(substring_dedup.PERIOD))
    assert substring_dedup.ANCHOR + substring_dedup.PERIOD - 1 == substring_dedup.WINDOW


@pytest.mark.parametrize("block_bytes", [3_000, 1 << 20])
def test_substrings_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block_bytes)
    rows = cases.rows(4)
    docs = cases.table(spark, 4)
    got = substring_dedup.drop_repeats(docs)
    assert got.columns == [*docs.columns, "_n_words", "n_removed"]
    want = without_repeats([r[1] for r in rows])
    assert any(x[2] for x in want)
    assert by_row((r.doc_id, r.n_words, r.text, r._n_words, r.n_removed) for r in got.collect()) == by_row((r[0], r[5], *x) for r, x in zip(rows, want))
    assert substring_dedup.drop_repeats(cases.empty(spark)).count() == 0


def test_shifted_copies_at_every_offset(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2_000)
    passage = [f"p{i}" for i in range(35)]
    texts = [" ".join([f"a{k}x{i}" for i in range(k)] + passage + [f"b{k}"]) for k in range(45)]
    texts += [" ".join(f"c{i}" for i in range(34))] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(docs).collect()}
    assert [got[i] for i in range(45)] == [35] * 45 and got[45] == got[46] == 0


def bits_of(text, shingle=3):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in cases.words(text)]
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    rows = cases.rows(6, 60)
    base = rows[0][1]
    rows += [(1000 + i, base + f" tail{i}", "en", "b", 0, None, None, None) for i in range(12)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    prints = [bits_of(r[1]) for r in rows]
    roots = groups(prints, 3)
    least = {}
    for r, g in zip(rows, roots):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    assert by_row(map(tuple, got)) == by_row((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, roots))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(cases.empty(spark)).count() == 0


def test_links_span_components_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(40):
        value = int(rng.integers(0, 1 << 63)) * 2
        prints.append(value)
        for _ in range(int(rng.integers(0, 12))):
            flips = rng.choice(64, int(rng.integers(1, 5)), replace=False)
            value = prints[-1 if rng.random() < 0.6 else int(rng.integers(0, len(prints)))]
            prints.append(value ^ sum(1 << int(b) for b in flips))
    # A dense ball, where a key holds many fingerprints.
    prints += [0x0F0F0F0F0F0F0F0F ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (3, 2, 0):
        got = {r.node: r.root for r in simhash.components(simhash.links(frame, distance)).collect()}
        roots = groups(prints, distance)
        least = {}
        for p, g in zip(signed, roots):
            least[g] = min(p, least.get(g, p))
        assert [got.get(p, p) for p in signed] == [least[g] for g in roots]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(201)}


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_cancel_out_are_told_apart(spark, n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    texts = [f"{'same ' * 34}{one}", f"{'same ' * 34}{two}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.drop_repeats(docs).collect()} == {0}


def test_hashes_tell_spans_and_windows_apart():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.sort(rng.choice(3900, 600, replace=False))
    ends = np.minimum(np.append(starts[1:], 4000), starts + rng.integers(0, 12, 600))
    got = buffers.span_hashes(data, starts, ends)
    other = buffers.span_hashes(data, starts, ends, seed=7)
    by = {}
    for h, g, a, b in zip(got.tolist(), other.tolist(), starts, ends):
        assert by.setdefault(bytes(data[a:b]), (h, g)) == (h, g)
    assert len({v[0] for v in by.values()}) == len({v[1] for v in by.values()}) == len(by)
    words = rng.integers(0, 3, 900).astype(np.uint64)
    for size in (1, 2, 3, 15, 35):
        hashes = buffers.window_hashes(words, size)
        seen = {}
        assert len(hashes) == 900 - size + 1
        for i, h in enumerate(hashes.tolist()):
            assert seen.setdefault(tuple(words[i : i + size].tolist()), h) == h
        assert len(set(seen.values())) == len(seen)
    assert len(buffers.window_hashes(words[:4], 5)) == 0
