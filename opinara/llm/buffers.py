"""Numpy views of Arrow text: word spans, span hashes, small shared helpers.

Words are maximal runs of bytes other than space and ``\\t``..``\\r``; those bytes never occur inside a
multi-byte UTF-8 character, so spans can be found on the raw buffer. All helpers work on one bounded
chunk of texts at a time.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles; a longer single text is its own chunk.
CHUNK_BYTES = 1 << 19

#: Rows of an Arrow batch; texts are long, and each task holds a batch on both sides.
BATCH_ROWS = 1_000

U = np.uint64
RADIX = U(0x9E3779B97F4A7C15)
WORD_GAP = np.zeros(256, bool)
WORD_GAP[[9, 10, 11, 12, 13, 32]] = True


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the process.

    Functions of this package travel to workers by value, so their module globals are new in every task; what
    later tasks should find (tables, encoders) is kept here instead.
    """
    home = sys.modules.setdefault("opinara_process_cache", types.ModuleType("opinara_process_cache"))
    return vars(home).setdefault(name, {})


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes or code points that lie one after another, whatever their place in ``values``.

    Each value is mixed with its place in its span before the span is summed up, and the sum with the span's length,
    so no pattern of values cancels out. Hashes of different seeds are independent.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, U)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    place = (at - np.repeat(first, size)).astype(U)
    mixed = mix((values[at + np.repeat(starts - first, size)].astype(U) | (place + U(1)) << U(21)) ^ U(mixed_seed(seed)))
    total = np.zeros(len(size) + 1, U)
    np.cumsum(np.add.reduceat(np.append(mixed, U(0)), first), dtype=U, out=total[1:])
    # An empty span gets what lies at its place from reduceat; it is none of its own.
    return mix(np.where(size > 0, np.diff(total), U(0)) + size.astype(U) * RADIX + U(mixed_seed(seed + 1)))


def mixed_seed(seed: int) -> int:
    return (seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows in chunks of about ``size`` bytes: first row, end row, bytes, offsets."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, row + 65536, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WORD_GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and n + 1 offsets into them by row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[-1] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    return span_hashes(data, starts, ends, seed)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in this order."""
    return mix(mix(left ^ RADIX) + right * U(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for every i that leaves room; rows are not looked at.

    Windows of 1, 2, 4, ... words are hashed from their halves, and ``size`` is put together from them.
    """
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, U)
    out, taken, width, level = None, 0, 1, words
    while width <= size:
        if size & width:
            part = level[taken : taken + n]
            out = part if out is None else pair_hashes(out, part)
            taken += width
        if 2 * width <= size:
            level = pair_hashes(level[:-width], level[width:])
        width *= 2
    return mix(out ^ U(size))


def first_in_row(bounds: np.ndarray) -> np.ndarray:
    """For each element, the index where its row begins; ``bounds`` are n + 1 offsets."""
    return np.repeat(bounds[:-1], np.diff(bounds))


def row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... for counts[i] of them, all rows after each other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def count_words(column: str | Column) -> Column:
    """Number of words of a text column as a long; null text has none. Runs on Arrow buffers."""

    @F.arrow_udf("long")
    def words(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffer(texts)
        out = [np.diff(spans(part, bounds)[2]) for _, _, part, bounds in chunks(data, offsets)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return words(column)


def head_words(column: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (the whole text if it has fewer; null text is empty)."""

    @F.arrow_udf("string")
    def head(texts: pa.Array, counts: pa.Array) -> pa.Array:
        data, offsets = text_buffer(texts)
        wanted, out = counts.to_numpy(zero_copy_only=False), []
        for row, end, part, bounds in chunks(data, offsets):
            _, ends, rows = spans(part, bounds)
            body = part.tobytes()
            for i in range(end - row):
                k = int(wanted[row + i])
                stop = int(bounds[i + 1]) if rows[i + 1] - rows[i] <= k else int(ends[rows[i] + k - 1]) if k else int(bounds[i])
                out.append(body[bounds[i] : stop])
        return pa.array(out, pa.binary()).cast(pa.string())

    return head(column, n)


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session send Arrow batches of at most ``BATCH_ROWS`` rows, unless it is set lower; returns ``df``."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case rules."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rows_join(left: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = 100_000) -> DataFrame:
    """Join to a stored table of statistics: broadcast when it has at most ``max_rows`` rows, else a shuffle join.

    Keys match null to null. The result is the same either way. Other columns of ``small`` must be new to ``left``.
    """
    keys = {c: fresh(left, f"{c}__key") for c in on}
    renamed = small.select(*[quoted(c).alias(keys[c]) if c in on else quoted(c) for c in small.columns])
    side = F.broadcast(renamed) if small.limit(max_rows + 1).count() <= max_rows else renamed
    match = None
    for c in on:
        same = quoted(c).eqNullSafe(quoted(keys[c]))
        match = same if match is None else match & same
    return left.join(side, match, how).drop(*keys.values())
