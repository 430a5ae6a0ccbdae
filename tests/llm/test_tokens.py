import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinara.llm import packing, token_counts, token_files
from opinara.llm.bpe import Encoder, vocabulary_path
from opinara.llm.buffers import chunks, text_buffer
from tests.llm import cases


@pytest.fixture(scope="module")
def coder():
    return Encoder(vocabulary_path("byte_bpe_50k.json"))


def library(coder, texts):
    return [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PARTS = ["a", "B", "s", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "!", "1", "²", "é", "ß", " ", "\x85", "\x1c", "日本", "🙂", "<|endoftext|>", "_", "don't", "\r\n", "<|end"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_ids_equal_the_library(texts):
    own = Encoder(vocabulary_path("byte_bpe_50k.json")) if not hasattr(test_ids_equal_the_library, "c") else test_ids_equal_the_library.c
    test_ids_equal_the_library.c = own
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    got = [flat[a:b].tolist() for _, flat, cuts in own.ids(data, offsets) for a, b in zip(cuts[:-1], cuts[1:])]
    assert got == library(own, texts)
    assert own.counts(data, offsets).tolist() == [len(x) for x in got]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_ids_equal_the_library_on_any_text(texts):
    test_ids_equal_the_library.hypothesis.inner_test(texts)


SCRIPTS = ["Η γρήγορη αλεπού", "Быстрая лиса, ещё", "敏捷的狐狸跳过懒狗。", "素早い茶色の狐", "빠른 갈색 여우", "الثعلب البني السريع", "השועל החום המהיר", "तेज़ भूरी लोमड़ी १२", "สุนัขจิ้งจอก", "“Curly – quotes…” it’s", "ᚠᛇᚻ ᛒᛦᚦ", "🙂👩‍👩‍👧 ½ Ⅷ ٣"]


def test_every_script_is_cut_as_the_library_cuts_it(coder):
    data, offsets = text_buffer(pa.array(SCRIPTS, pa.string()))
    own = Encoder(vocabulary_path("byte_bpe_50k.json"))
    _, _, odd, *_ = own.pretokens(data, offsets)
    assert not odd.any()
    got = [flat[a:b].tolist() for _, flat, cuts in own.ids(data, offsets) for a, b in zip(cuts[:-1], cuts[1:])]
    assert got == library(coder, SCRIPTS)
    # Seen once, everything comes from the cache.
    before = own.misses
    assert own.counts(data, offsets).tolist() == [len(x) for x in got] and own.misses == before


def test_classes_of_all_code_points(coder):
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = "".join(map(chr, points.tolist()))
    own = Encoder(vocabulary_path("byte_bpe_50k.json"))
    kind = own.classes.of(points)
    assert all((kind == k).any() for k in (1, 2, 3, 4))
    data, offsets = text_buffer(pa.array([text], pa.string()))
    _, _, odd, starts, ends, _, _ = own.pretokens(data, offsets)
    want = [span for _, span in coder.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    assert not odd.any() and list(zip(starts.tolist(), ends.tolist())) == want


def test_known_lengths_and_cache_serve_other_scripts(spark, coder):
    texts = [f"{a} {b}" for a in SCRIPTS for b in SCRIPTS]
    own = Encoder(vocabulary_path("byte_bpe_50k.json"), lengths_only=True)
    words = token_counts.frequent_pretokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary_path("byte_bpe_50k.json"))
    data, offsets = text_buffer(pa.array(words, pa.string()))
    table = {}
    for row, _, part, bounds in chunks(data, offsets):
        _, _, _, _, _, got, rows = own.pretokens(part, bounds)
        table.update({int(h): len(x) for h, x, k in zip(got[rows[:-1]], library(coder, words[row : row + len(rows) - 1]), np.diff(rows)) if k == 1})
    keys = np.array(sorted(table), np.uint64)
    own.known = keys, np.array([table[int(k)] for k in keys])
    own.misses = 0
    own.reset()
    assert own.counts(*text_buffer(pa.array(texts, pa.string()))).tolist() == [len(x) for x in library(coder, texts)]
    assert own.misses < 0.02 * len(words)


def turns(n):
    """A word of n characters and its complement, which cancel out in sums of powers of any odd number modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_cancel_out_are_told_apart(coder, n):
    texts = list(turns(n))
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    own = Encoder(vocabulary_path("byte_bpe_50k.json"))
    got = [flat[a:b].tolist() for _, flat, cuts in own.ids(data, offsets) for a, b in zip(cuts[:-1], cuts[1:])]
    assert got == library(coder, texts) and own.counts(data, offsets).tolist() == [len(x) for x in got]


def test_cache_reset_and_known_lengths(coder):
    texts = cases.texts()
    own = Encoder(vocabulary_path("byte_bpe_50k.json"), lengths_only=True, max_entries=50)
    want = [len(x) for x in library(coder, texts)]
    assert own.counts(*text_buffer(pa.array(texts, pa.string()))).tolist() == want


def test_counts_against_the_library(spark, coder):
    got = token_counts.with_token_counts(cases.table(spark), top=50).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit", "block").collect()
    assert len(got) == len(cases.rows())
    for r, ids in zip(got, library(coder, [r.text for r in got])):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), len(ids), len(ids) > 1024)
    assert token_counts.with_token_counts(cases.empty(spark)).count() == 0


def test_counts_of_pretokens_longer_than_65535_tokens(spark, coder):
    rng = np.random.default_rng(6)
    texts = ["\n" * 200_000, "".join(map(chr, rng.integers(97, 123, 200_000)))]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(6)], "doc_id long, text string").coalesce(1)
    want = [len(x) for x in library(coder, texts)]
    assert max(want) > 65_535
    for r in token_counts.with_token_counts(docs, limit=60_000).collect():
        assert (r.n_tokens, r.over_limit) == (want[r.doc_id % 2], want[r.doc_id % 2] > 60_000)


def test_files_round_trip(spark, coder, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(cases.table(spark), folder, shard_bytes=20_000)
    back = token_files.read_token_files(spark, folder).orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in back]
    assert [r.start for r in back] == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()
    order = [r.doc_id for r in back]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    rows = cases.rows()
    want = [(r[0], x + [2]) for r, x in zip(rows, library(coder, [r[1] for r in rows]))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(zip(order, ids), key=key) == sorted(want, key=key)
    some = token_files.read_token_files(spark, folder, [3, 20, 77]).collect()
    assert {r.doc_id: r.start for r in some} == {r.doc_id: r.start for r in back if r.doc_id in (3, 20, 77)}
    first = token_files.manifest(spark, folder).orderBy("shard").first()
    place = tmp_path / "tokens" / first.path
    body = bytearray(place.read_bytes())
    body[20] ^= 255
    place.write_bytes(bytes(body))
    with pytest.raises(Exception):
        token_files.read_token_files(spark, folder).collect()


def test_files_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    assert token_files.write_token_files(cases.empty(spark), folder).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


def test_reader_takes_only_the_frames_it_needs(tmp_path):
    place = tmp_path / "one.tok"
    with place.open("wb") as out:
        writer = token_files.ShardWriter(out, frame_ids=100)
        for i in range(50):
            writer.add(i if i else None, np.arange(i * 7, i * 7 + 30, dtype=np.uint32))
        writer.close()
    with place.open("rb") as source:
        shard = token_files.ShardReader(source, place.stat().st_size)
        opened = []
        read = shard.frame
        shard.frame = lambda k: opened.append(k) or read(k)
        assert [(i, x[0]) for i, x in shard.documents([40, 41, 3])] == [(3, 21), (40, 280), (41, 287)]
        assert len(opened) == len(set(opened)) <= 3 < len(shard.sizes)
        assert shard.nulls.sum() == 1


def check_packing(got, want, window):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 > 0
    for pieces in by_sequence.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= window
    for doc, ids in want.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        joined = b"".join(r.ids for r in pieces)
        assert np.frombuffer(joined, "<u4").tolist() == ids
        assert [r.start for r in pieces] == np.concatenate([[0], np.cumsum([r.length for r in pieces])[:-1]]).tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    return len(by_sequence)


@pytest.mark.parametrize("window,max_open", [(2048, 2048), (64, 8)])
def test_packing_holds_each_id_once(spark, coder, window, max_open):
    texts = cases.texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = packing.pack(docs, window=window, max_open=max_open).collect()
    want = {i: x + [1] for i, x in enumerate(library(coder, texts))}
    n = check_packing(got, want, window)
    assert n <= -(-sum(map(len, want.values())) // window) + 3
    assert packing.pack(cases.empty(spark)).count() == 0
    everything = packing.pack(cases.table(spark)).agg(F.sum("length")).first()[0]
    assert everything == sum(len(x) + 1 for x in library(coder, [r[1] for r in cases.rows()]))


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(window=40, max_open=10**9)
    for i in range(400):
        size = int(rng.integers(1, 40))
        counts = packer.levels.copy()

        def squares(level):
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 40
            return int((after[1:40] ** 2).sum())

        allowed = [h for h in range(0, 41 - size) if h == 0 or counts[h]]
        level = packer.level_for(size)
        assert squares(level) == min(map(squares, allowed)) and level in allowed
        list(packer.add(i, np.zeros(size, np.uint32)))


def test_crc_matches_the_contract(spark):
    ids = np.array([1, 70_000, 2], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(ids),)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(ids)


def test_distinct_hashes():
    from opinara.llm.bpe import distinct

    hashes = np.array([9, 2**64 - 1, 9, 0, 2**64 - 1, 7], np.uint64)
    unique, at, back = distinct(hashes)
    assert unique.tolist() == [9, 2**64 - 1, 0, 7] and at.tolist() == [0, 1, 3, 5]
    assert (unique[back] == hashes).all() and all(len(x) == 0 for x in distinct(hashes[:0]))
