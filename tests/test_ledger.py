"""The ledger of seen ids: blocks, filters, what a batch opens, replays."""

import random
from pathlib import Path

import numpy as np

from opinara.session import scratch_path
from opinara.streaming import ledger as L


def test_blocks_cover_what_came_before():
    for fan in (2, 3, 8):
        written = set()
        for batch in range(150):
            covered = [b for first, size in L.blocks_before(batch, fan) for b in range(first, first + size)]
            assert covered == list(range(batch))
            assert set(L.blocks_before(batch, fan)) <= written
            assert len(L.blocks_before(batch, fan)) <= 9 * (fan - 1)
            ended = L.blocks_ended(batch, fan)
            # A larger block is made of blocks that are there.
            for first, size in ended[1:]:
                assert all((first + i * size // fan, size // fan) in written | set(ended) for i in range(fan))
            written |= set(ended)


def test_filters_never_miss_and_rarely_err():
    rng = np.random.default_rng(1)
    held, other = rng.integers(-(1 << 63), 1 << 63, 3000), rng.integers(-(1 << 63), 1 << 63, 3000)
    bits = L.bloom(held)
    assert all(L.may_hold(bits, held[i : i + 1]) for i in range(len(held)))
    assert np.mean([L.may_hold(bits, other[i : i + 1]) for i in range(len(other))]) < 0.02
    assert not L.may_hold(L.bloom(np.zeros(0, np.int64)), other) and not L.may_hold(bits, np.zeros(0, np.int64))


def test_bytes_opened_stay_flat_and_late_repeats_count_once(spark):
    path, rng = scratch_path(spark, "ledger"), random.Random(4)
    book = L.Ledger(spark, path, "row_id", "bigint", buckets=64)
    seen, opened, late = set(), [], 0
    for b in range(18):
        ids = [b * 1000 + i for i in range(12)] + ([None] if b in (3, 9) else [])
        # Every fifth batch brings back an id from long ago.
        if b % 5 == 4:
            back = rng.choice([i for i in seen if i is not None])
            ids += [back, back]
            late += 1
        batch = spark.createDataFrame([(i, "x") for i in ids], "row_id long, text string").coalesce(1)
        new = {r.row_id for r in book.unseen(batch, b).collect()}
        assert new == set(ids) - seen, b
        files = [f for first, size, bucket in book.opened for f in Path(book._block(first, size), f"ledger_bucket={bucket}").glob("*.parquet")]
        opened.append(sum(f.stat().st_size for f in files))
        book.add(batch, b)
        if b == 7:
            # The same batch again: the same answer, the same ledger.
            assert {r.row_id for r in book.unseen(batch, b).collect()} == new
            book.add(batch, b)
        seen |= set(ids)
    whole = sum(f.stat().st_size for f in Path(path, "ids").rglob("*.parquet"))
    assert late == 3 and max(opened) < whole / 10
    assert np.mean(opened[9:]) < 3 * max(1, np.mean(opened[1:9])) + 2000


def test_text_ids_and_empty_batches(spark):
    book = L.Ledger(spark, scratch_path(spark, "ledger"), "row_id", "string", buckets=4)
    empty = spark.createDataFrame([], "row_id string")
    one = spark.createDataFrame([("a",), ("a",), ("é",), (None,)], "row_id string")
    for b, (batch, want) in enumerate([(empty, 0), (one, 4), (empty, 0), (one, 0), (spark.createDataFrame([("b",), ("é",)], "row_id string"), 1)]):
        assert book.unseen(batch, b).count() == want
        book.add(batch, b)
