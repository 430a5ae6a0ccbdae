"""Token ids in binary shards: independent zstandard frames, document index, trailing seek table.

A shard holds consecutive documents in ascending id order::

    frame 0 .. frame F-1   zstandard frames with content checksum; ids of whole documents, uint32 little-endian
    index                  skippable frame 0x184D2A5D: zstandard of int64 doc_id[N], uint8 is_null[N],
                           uint32 frame[N], uint64 first id in frame[N], uint64 ids[N]
    seek table             skippable frame 0x184D2A5E: per frame uint32 compressed size, uint64 ids,
                           uint32 crc32 of the ids; then uint32 F, uint64 N, uint64 index size, uint32 magic

A reader takes the fixed-size tail first, then the table and the index, then only the frames it needs. Plain
zstandard tools can read the frames, since they pass over skippable frames.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.bpe import encoder, vocabulary_path
from opinara.llm.buffers import quoted, small_batches, text_buffer

#: Ids after which a frame closes; text bytes of a shard.
FRAME_IDS, SHARD_BYTES = 1 << 17, 32 << 20
INDEX_MAGIC, SEEK_MAGIC, TAIL_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x544F4B31
_TAIL, _ENTRY = "<IQQI", "<IQI"


class ShardWriter:
    """Writes one shard to an open binary stream; documents come in file order."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.n_held, self.entries = 0, []
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(self.entries), self.n_held, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.frame_ids:
            self._close_frame()

    def _close_frame(self) -> None:
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), self.n_held, zlib.crc32(raw)))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        columns = list(zip(*self.docs, strict=True)) or [()] * 5
        kinds = ("<i8", "u1", "<u4", "<u8", "<u8")
        index = self.packer.compress(b"".join(np.array(c, k).tobytes() for c, k in zip(columns, kinds, strict=True)))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack(_ENTRY, *e) for e in self.entries) + struct.pack(_TAIL, len(self.entries), len(self.docs), len(index), TAIL_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to a shard's documents; ``source`` is a seekable binary file of known size."""

    def __init__(self, source, size: int):
        self.source = source
        tail, entry = struct.calcsize(_TAIL), struct.calcsize(_ENTRY)
        n_frames, n_docs, index_size, magic = struct.unpack(_TAIL, self._at(size - tail, tail))
        if magic != TAIL_MAGIC:
            raise ValueError("not a token shard")
        table = size - tail - n_frames * entry
        entries = list(struct.iter_unpack(_ENTRY, self._at(table, n_frames * entry)))
        self.sizes, self.n_ids, self.sums = (np.array(c, np.int64) for c in (zip(*entries, strict=True) if entries else ((), (), ())))
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])
        raw = zstandard.ZstdDecompressor().decompress(self._at(table - 8 - index_size, index_size))
        cuts = np.cumsum([0, 8 * n_docs, n_docs, 4 * n_docs, 8 * n_docs, 8 * n_docs])
        kinds = ("<i8", "u1", "<u4", "<u8", "<u8")
        self.doc_ids, self.nulls, self.frames, self.firsts, self.lengths = (np.frombuffer(raw[a:b], k) for a, b, k in zip(cuts[:-1], cuts[1:], kinds, strict=True))
        self.firsts, self.lengths = self.firsts.astype(np.int64), self.lengths.astype(np.int64)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        """Ids of one frame; a wrong checksum raises."""
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[k]), int(self.sizes[k])), max_output_size=int(4 * self.n_ids[k]) or 1)
        if zlib.crc32(raw) != self.sums[k]:
            raise ValueError(f"frame {k}: checksum differs")
        return np.frombuffer(raw, "<u4")

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the wanted rows of the index, ascending; only their frames are read."""
        wanted = np.arange(len(self.doc_ids)) if rows is None else np.unique(np.fromiter(rows, np.int64))
        open_frame, ids = -1, None
        for i in wanted.tolist():
            if self.frames[i] != open_frame:
                open_frame, ids = int(self.frames[i]), self.frame(int(self.frames[i]))
            yield i, ids[self.firsts[i] : self.firsts[i] + self.lengths[i]]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text, close it with ``end_id`` and write shards below ``folder``; return the manifest.

    Shards are ranges of (doc_id, text hash): null ids come first, a repeated id may spread over shards, and an
    empty table writes none. ``folder`` must be one that all executors share. A task writes under a name of its
    own and renames the file when it is whole, so a task that runs twice leaves one shard. The manifest
    (``shard, path, n_docs, n_tokens, first_token``) is written to ``folder/manifest`` and read back.
    """
    spark = small_batches(docs).sparkSession
    path = vocabulary_path(vocabulary)
    total = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    chosen = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = chosen.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path), TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder)
        writer, out, own = None, None, f"{base}/{uuid.uuid4().hex}.part"
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for row, flat, cuts in coder.ids(*text_buffer(batch.column(1)), end_id=end_id):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(own)
                    writer = ShardWriter(out)
                for i in range(len(cuts) - 1):
                    writer.add(ids_of[row + i], flat[cuts[i] : cuts[i + 1]])
        if writer is None:
            return
        writer.close()
        out.close()
        name = f"shard-{shard:08d}.tok"
        store.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    rows = dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")
    rows.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard; ``first_token`` counts the ids of all shards before it."""
    rows = spark.read.schema("shard long, path string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a folder: ``doc_id, start`` (ids of all documents before), ``ids`` (binary, uint32 little-endian).

    With ``doc_ids`` only the frames that hold those documents are decompressed.
    """
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                place = f"{base}/{name}"
                with store.open_input_file(place) as source:
                    shard = ShardReader(source, store.get_file_info(place).size)
                    starts = first + np.cumsum(shard.lengths) - shard.lengths
                    rows = None if wanted is None else np.flatnonzero(np.isin(shard.doc_ids, wanted) & (shard.nulls == 0))
                    held: list[tuple[int, bytes]] = []
                    size = 0
                    for i, ids in shard.documents(rows):
                        held.append((i, ids.tobytes()))
                        size += len(held[-1][1])
                        if size > 4 << 20:
                            yield _documents(shard, starts, held)
                            held, size = [], 0
                    if held:
                        yield _documents(shard, starts, held)

    table = manifest(spark, folder)
    return table.repartition(max(1, table.count())).mapInArrow(read, "doc_id long, start long, ids binary")


def _documents(shard: ShardReader, starts: np.ndarray, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = np.array([i for i, _ in held])
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids[rows], pa.int64(), mask=shard.nulls[rows].astype(bool)), "start": pa.array(starts[rows], pa.int64()), "ids": pa.array([x for _, x in held], pa.binary())})
