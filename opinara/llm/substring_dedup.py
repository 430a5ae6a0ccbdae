"""Substring dedup with difference-cover anchors.

A window of ``WINDOW`` words that occurs at two places p and q shares an anchor with itself: D is a perfect
difference set modulo ``PERIOD``, so some shift d < PERIOD puts both p + d and q + d on cover positions, and the
anchor of ``ANCHOR`` words that begins there lies inside the window. Only anchors (five of every 21 positions) are
hashed over the corpus; windows are hashed only where an anchor of theirs repeats, and then compared whole.

Three passes over texts that are dealt once into blocks (the exchange is reused):

1. block -> distinct anchor hashes, cut by hash range; range -> which of them repeat, as bits
2. block + bits -> distinct hashes (96 bits) of windows around repeated anchors; range -> bits
3. block + bits -> repeated windows, whose words go

A block sends each hash once, however often it holds it, so a passage in a third of all rows is one entry per
block and never a pair. Nothing is capped. Windows with equal 96-bit hashes count as equal.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.buffers import U, expand, first_in_row, fresh, quoted, small_batches, spans, text_buffer, window_hashes, word_hashes

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
#: Text bytes of a block; blocks per exchange partition; blocks whose hashes meet in one range.
BLOCK_BYTES, PER_PARTITION, PER_RANGE = 1 << 20, 12, 4

_REQUEST = "part long, block long, first binary, second binary, echo binary"
_REPLY = "block long, part long, bits binary, echo binary"
_GAPS = re.compile(r"[\x20\x09-\x0D]+")


def _request_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("echo", pa.binary())])


def _words(table: pa.Table, text: str):
    data, offsets = text_buffer(table.column(text))
    starts, ends, rows = spans(data, offsets)
    return data, offsets, starts, ends, rows, word_hashes(data, starts, ends)


def _second(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words that are independent of the first ones."""
    return word_hashes(data, starts, ends, seed=7)


def _parts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Range of each hash: its upper half scaled to n, so that sorted hashes give sorted ranges."""
    return ((hashes >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _request(block: int, n: int, first: np.ndarray, second: np.ndarray | None, echo: bytes = b"") -> pa.Table:
    """Sorted distinct hashes of a block as one row for each range that has some."""
    part = _parts(first, n)
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cut, len(first))[1:]
    rows = {"part": part[cut].tolist(), "block": [block] * len(cut)}
    rows["first"] = [first[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    rows["second"] = [b"" if second is None else second[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    rows["echo"] = [b""] * len(cut)
    if echo:
        for key, value in {"part": block % n, "block": block, "first": b"", "second": b"", "echo": echo}.items():
            rows[key].append(value)
    return pa.table(rows, _request_schema())


def _reply(table: pa.Table) -> pa.Table:
    """For each request of a range: bits that say which of its hashes other requests hold too."""
    table = table.combine_chunks()
    firsts, seconds = table.column("first").to_pylist(), table.column("second").to_pylist()
    size = np.array([len(x) // 8 for x in firsts], np.int64)
    first = np.frombuffer(b"".join(firsts), U)
    second = np.frombuffer(b"".join(seconds), np.uint32)
    order = np.argsort(first, kind="stable") if not len(second) else np.lexsort((second, first))
    same = first[order][1:] == first[order][:-1]
    if len(second):
        same &= second[order][1:] == second[order][:-1]
    repeated = np.zeros(len(first), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    cuts = np.concatenate([[0], np.cumsum(size)])
    bits = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array(bits, pa.binary()), "echo": table.column("echo")})


def _flags(replies: pa.Table, first: np.ndarray, n: int) -> np.ndarray:
    """Bits of a block's replies, in the order of its sorted distinct hashes."""
    out = np.zeros(len(first), bool)
    part = _parts(first, n)
    for p, bits in zip(replies.column("part").to_pylist(), replies.column("bits").to_pylist(), strict=True):
        if bits:
            a, b = np.searchsorted(part, [p, p + 1])
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def _anchors(words: np.ndarray, rows: np.ndarray):
    """Positions of anchors, sorted distinct hashes, index of each anchor's hash, and whether the block repeats it."""
    hashes = window_hashes(words, ANCHOR)
    place = np.arange(len(hashes))
    end = np.repeat(rows[1:], np.diff(rows))[: len(hashes)]
    begin = first_in_row(rows)[: len(hashes)]
    at = place[(place + ANCHOR <= end) & np.isin((place - begin) % PERIOD, COVER)]
    distinct, back, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
    return at, distinct, back, count > 1


def _candidates(at: np.ndarray, rows: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of windows that hold one of the anchors ``at`` at a shift below PERIOD."""
    if not len(at):
        return at
    low = np.maximum(at - PERIOD + 1, first_in_row(rows)[at])
    high = np.minimum(at, np.repeat(rows[1:], np.diff(rows))[at] - WINDOW) + 1
    ok = high > low
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, low[ok], 1)
    np.add.at(change, high[ok], -1)
    return np.flatnonzero(np.cumsum(change)[:-1] > 0)


def _windows(words: np.ndarray, other: np.ndarray, at: np.ndarray):
    """Sorted distinct 96-bit hashes of windows, index of each window's hash, whether the block repeats it.

    ``words`` and ``other`` are independent hashes of the words.
    """
    first = window_hashes(words, WINDOW)[at]
    second = (window_hashes(other, WINDOW)[at] >> U(32)).astype(np.uint32)
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return first[order][new], second[order][new], back, np.bincount(back, minlength=int(new.sum())) > 1


def drop_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Take out every word that a window of 35 words covers whose word sequence also starts elsewhere.

    Words are maximal runs of characters other than blank and ``\\t``..``\\r``; "elsewhere" is any other start,
    of the same text too, and is judged on the input. All occurrences go. Returns the input's columns with
    ``text`` replaced by the words kept, joined by one blank, and the new columns ``n_words`` and ``n_removed``
    (prefixed with underscores if the input has such names). Null text has no words and becomes the empty text;
    null keys and repeated rows are rows like any other, so each of two equal long rows is emptied. One small
    job sums the text's bytes to set the number of blocks.
    """
    spark = small_batches(docs).sparkSession
    total = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    n_parts, n_tasks = max(1, -(-n_blocks // PER_RANGE)), max(1, -(-n_blocks // PER_PARTITION))
    block, n_words, n_removed = fresh(docs, "block"), fresh(docs, "n_words"), fresh(docs, "n_removed")
    plain = [f for f in docs.schema.fields if not f.dataType.simpleString().startswith(("map", "variant", "interval"))]
    dealt = docs.withColumn(block, F.pmod(F.xxhash64(*[quoted(f.name) for f in plain]), F.lit(n_blocks))).repartition(n_tasks, quoted(block))

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *_, rows, words = _words(table, text)
        return _request(key[0].as_py(), n_parts, _anchors(words, rows)[1], None)

    def windows(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _request_schema().empty_table()
        data, _, starts, ends, rows, words = _words(table, text)
        at, distinct, back, own = _anchors(words, rows)
        flags = own | _flags(replies, distinct, n_parts)
        first, second, _, _ = _windows(words, _second(data, starts, ends), _candidates(at[flags[back]], rows, len(words)))
        return _request(key[0].as_py(), n_parts, first, second, np.packbits(flags).tobytes())

    keep = [f for f in docs.schema.fields if f.name != text]

    def without(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets, starts, ends, rows, words = _words(table, text)
        at, distinct, back, _ = _anchors(words, rows)
        echo = b"".join(replies.column("echo").to_pylist())
        flags = np.unpackbits(np.frombuffer(echo, np.uint8), count=len(distinct)).astype(bool) if echo else np.zeros(len(distinct), bool)
        at = _candidates(at[flags[back]], rows, len(words))
        first, _, back, own = _windows(words, _second(data, starts, ends), at)
        hit = at[(own | _flags(replies, first, n_parts))[back]]
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + WINDOW, -1)
        kept = np.cumsum(gone)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(kept)])[rows]
        size = (ends - starts)[kept]
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        joined[expand(np.cumsum(size + 1) - size - 1, size)] = data[expand(starts[kept], size)]
        cut = np.concatenate([[0], np.cumsum(size + 1)])
        body = joined.tobytes()
        texts = [body[cut[a] : max(cut[a], cut[b] - 1)] for a, b in zip(left[:-1], left[1:], strict=True)]
        n = np.diff(rows)
        out = {f.name: table.column(f.name) for f in keep}
        out |= {text: pa.array(texts, pa.binary()).cast(pa.string()), n_words: pa.array(n, pa.int64()), n_removed: pa.array(n - np.diff(left), pa.int64())}
        return pa.table(out)

    asked = dealt.groupBy(quoted(block)).applyInArrow(anchors, _REQUEST)
    told = asked.groupBy("part").applyInArrow(_reply, _REPLY).repartition(n_tasks, "block")
    asked = dealt.groupBy(quoted(block)).cogroup(told.groupBy("block")).applyInArrow(windows, _REQUEST)
    told = asked.groupBy("part").applyInArrow(_reply, _REPLY).repartition(n_tasks, "block")
    schema = spark.createDataFrame([], docs.schema).select(*[quoted(f.name) for f in keep])
    schema = schema.select("*", F.lit("").alias(text), F.lit(0).cast("long").alias(n_words), F.lit(0).cast("long").alias(n_removed)).schema
    out = dealt.groupBy(quoted(block)).cogroup(told.groupBy("block")).applyInArrow(without, schema)
    return out.select(*[quoted(c) for c in [*docs.columns, n_words, n_removed]])
