"""Sum-of-squares online packing of token ids into windows of fixed length.

Each task packs its own documents in one pass. ``levels[h]`` counts the open windows that hold h ids; a piece of
s ids goes to the level h (or a new window) for which the sum of squared counts of partly filled levels is least
afterwards, ties to the fullest window. A document of a window or more is cut into whole windows first; the rest
is the piece to place. When ``max_open`` windows are open, and at the end, the emptiest windows are cut up to
fill the fullest, so a task leaves at most one window that needs padding and holds few ids in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from opinara.llm.bpe import encoder, vocabulary_path
from opinara.llm.buffers import quoted, small_batches, text_buffer

WINDOW, MAX_OPEN = 2048, 2048
#: Pre-tokens that a worker remembers (about 200 bytes each); at fewer, the frequent ones are forgotten too often.
REMEMBERED = 500_000
#: A piece: document's id, its ids before the piece, the ids, all ids of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Places pieces one after another; full windows come out as lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """Level (0: a new window) with the least sum of squares after ``size`` more ids."""
        n, room = self.levels, self.window - size
        change = 2 * (n[size : size + room + 1] - n[: room + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[room] = 1 - 2 * n[room] if room else 0
        allowed = n[: room + 1] > 0
        allowed[0] = True
        at = np.flatnonzero(allowed)
        cost = change[at]
        return int(at[len(cost) - 1 - np.argmin(cost[::-1])])

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        whole = len(ids) // self.window * self.window
        for a in range(0, whole, self.window):
            yield [(doc_id, a, ids[a : a + self.window], len(ids))]
        size = len(ids) - whole
        if not size:
            return
        piece = (doc_id, whole, ids[whole:], len(ids))
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
        else:
            self._keep(pieces, level + size)
            if self.n_open >= self.max_open:
                yield from self.drain(self.max_open // 2)

    def _keep(self, pieces: list[Piece], level: int) -> None:
        self.open[level].append(pieces)
        self.levels[level] += 1
        self.n_open += 1

    def drain(self, leave: int = 0) -> Iterator[list[Piece]]:
        """Fill the fullest windows from the emptiest until ``leave`` or, at 0, none are open."""
        held = [(h, p) for h in range(1, self.window) for p in self.open[h]]
        low, high = 0, len(held) - 1
        while low < high and high - low + 1 > max(leave, 1):
            h, pieces = held[high]
            room = self.window - h
            level, source = held[low]
            while room and source:
                doc_id, start, ids, total = source.pop()
                take = min(room, len(ids))
                # The piece's end moves; its head stays where it was.
                pieces.append((doc_id, start + len(ids) - take, ids[len(ids) - take :], total))
                if take < len(ids):
                    source.append((doc_id, start, ids[: len(ids) - take], total))
                room, level = room - take, level - take
            held[low] = (level, source)
            if not source:
                low += 1
            if not room:
                yield pieces
                high -= 1
            else:
                held[high] = (self.window - room, pieces)
        self.levels[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        for h, pieces in held[low : high + 1]:
            if leave:
                self._keep(pieces, h)
            else:
                yield pieces


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", max_open: int = MAX_OPEN) -> DataFrame:
    """Encode whole texts, close each with ``end_id`` and pack them; one row per piece.

    Columns: ``doc_id, start`` (the document's ids before the piece), ``length, ids`` (binary, uint32
    little-endian), ``doc_tokens, sequence_id, offset`` (place in the sequence, without gaps from 0). A sequence
    holds at most ``window`` ids and would be padded to that length. Null and empty texts are a lone end id; null
    and repeated ids are documents like any other; an empty table gives no rows. No shuffle: partitions pack for
    themselves, and the upper bits of ``sequence_id`` name the partition.
    """
    path = vocabulary_path(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path, max_entries=REMEMBERED), Packer(window, max_open)
        base, count = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []

        def emit(pieces: list[Piece]) -> None:
            nonlocal count
            place = 0
            for who, start, ids, total in pieces:
                rows.append((who, start, len(ids), ids.tobytes(), total, base + count, place))
                place += len(ids)
            count += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            who = batch.column(0).to_pylist()
            for row, flat, cuts in coder.ids(*text_buffer(batch.column(1)), end_id=end_id):
                for i in range(len(cuts) - 1):
                    for pieces in packer.add(who[row + i], flat[cuts[i] : cuts[i + 1]].copy()):
                        emit(pieces)
                if rows:
                    yield flush()
        for pieces in packer.drain():
            emit(pieces)
        if rows:
            yield flush()

    chosen = small_batches(docs).select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    return chosen.mapInArrow(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
