"""Ids seen by earlier batches, on disk, without reading them whole.

Ids fall into ``buckets`` by hash. Batch b writes its ids as a block [b, b + 1), one file per bucket, and beside it one
row per bucket with a Bloom filter. When b ends a run of ``FAN`` blocks of one size, these are also written as one
larger block. So the ids before batch b lie in a few blocks that b itself tells (its digits to the base ``FAN``), and
no pointer has to be kept: a replayed batch writes the same blocks again.

A batch asks the filters of the buckets that its ids fall into, and opens only files whose filter says that they may
hold one of them. With batches of new ids next to nothing is opened, however long the stream has run; what is read of
the filters is ``BITS`` bits for each id in those buckets. Choose more buckets for longer streams (about one for each
million ids): a bucket is the unit of reading, and a file of each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks that are merged at a time, filter bits for an id, bits that an id sets.
FAN, BITS, HASHES = 8, 12, 6

_FILTERS = "bucket int, n long, bits binary"


def blocks_before(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Blocks (first batch, number of batches) that cover the batches before ``batch``, largest first."""
    out, at, size = [], 0, 1
    while size * fan <= batch:
        size *= fan
    while at < batch:
        while at + size > batch:
            size //= fan
        out.append((at, size))
        at += size
    return out


def blocks_ended(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Blocks that ``batch`` completes, smallest first; the first is its own."""
    out, size = [], 1
    while (batch + 1) % size == 0:
        out.append((batch + 1 - size, size))
        size *= fan
    return out


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bits that each hash sets in a filter of ``size`` bits (one row per hash)."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)


def bloom(hashes: np.ndarray) -> bytes:
    bits = np.zeros(-(-max(1, len(hashes)) * BITS // 64) * 64, bool)
    bits[places(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> bool:
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
    return bool(held[places(hashes, len(held))].all(axis=1).any())


@dataclass
class Ledger:
    """Ledger of one id column below ``path``."""

    spark: SparkSession
    path: str
    key: str
    kind: str
    buckets: int = 16
    #: Files that the last call of :meth:`unseen` opened, as (first batch, number of batches, bucket).
    opened: list[tuple[int, int, int]] = field(default_factory=list)

    def _block(self, first: int, size: int) -> str:
        return f"{self.path}/ids/size={size}/first={first}"

    def _filters(self, first: int, size: int) -> str:
        return f"{self.path}/filters/size={size}/first={first}"

    def _keyed(self, ids: DataFrame) -> DataFrame:
        h = F.xxhash64(self.key)
        return ids.select(self.key, h.alias("ledger_hash"), F.pmod(h, F.lit(self.buckets)).cast("int").alias("ledger_bucket"))

    def _ids(self, folders: list[str]) -> DataFrame:
        """Ids of some folders; which block or bucket they belong to is not looked at."""
        return self.spark.read.schema(f"{self.key} {self.kind}").option("basePath", f"{self.path}/ids").parquet(*folders).select(self.key)

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows of ``batch`` whose id no earlier batch had (null ids count as an id); the order of batches is their number."""
        self.opened = []
        blocks = blocks_before(batch_id)
        if not blocks:
            return batch
        asked = self._keyed(batch.select(self.key).distinct())
        filters = None
        for first, size in blocks:
            part = self.spark.read.schema(_FILTERS).parquet(self._filters(first, size))
            part = part.select(F.lit(first).cast("long").alias("first"), F.lit(size).cast("long").alias("size"), "bucket", "bits")
            filters = part if filters is None else filters.unionByName(part)

        def hits(ids: pa.Table, held: pa.Table) -> pa.Table:
            hashes = ids.column("ledger_hash").to_numpy()
            rows = [r for r in held.to_pylist() if len(hashes) and may_hold(r["bits"], hashes)]
            return pa.table({"first": pa.array([r["first"] for r in rows], pa.int64()), "size": pa.array([r["size"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32())})

        found = asked.select("ledger_bucket", "ledger_hash").groupBy("ledger_bucket").cogroup(filters.groupBy("bucket")).applyInArrow(hits, "first long, size long, bucket int")
        # At most one row per block and bucket.
        self.opened = sorted((r.first, r.size, r.bucket) for r in found.collect())
        if not self.opened:
            return batch
        files = [f"{self._block(first, size)}/ledger_bucket={bucket}" for first, size, bucket in self.opened]
        past = self._ids(files).distinct()
        past = past.withColumnRenamed(self.key, "_seen")
        return batch.join(past, batch[self.key].eqNullSafe(past["_seen"]), "left_anti")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Write the ids of a batch, and every larger block that it completes; again with the same result."""
        for first, size in blocks_ended(batch_id):
            if size == 1:
                ids = self._keyed(batch.select(self.key).distinct())
            else:
                parts = [self._block(first + i * (size // FAN), size // FAN) for i in range(FAN)]
                ids = self._keyed(self._ids(parts).distinct())
            sorted_ids = ids.repartition("ledger_bucket").sortWithinPartitions("ledger_bucket")
            sorted_ids.select(self.key, "ledger_bucket").write.mode("overwrite").partitionBy("ledger_bucket").parquet(self._block(first, size))
            written = self.spark.read.schema(f"{self.key} {self.kind}, ledger_bucket int").parquet(self._block(first, size))
            hashed = written.select(F.col("ledger_bucket").alias("bucket"), F.xxhash64(self.key).alias("h"))
            rows = hashed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_filter_rows, _FILTERS)
            rows.write.mode("overwrite").parquet(self._filters(first, size))


def _filter_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One filter per bucket; the hashes of a bucket come one after another."""
    bucket, held = None, []

    def row() -> pd.DataFrame:
        hashes = np.concatenate(held)
        return pd.DataFrame({"bucket": [bucket], "n": [len(hashes)], "bits": [bloom(hashes)]})

    for pdf in batches:
        for key, part in pdf.groupby("bucket", sort=True):
            if bucket is not None and key != bucket:
                yield row()
                held = []
            bucket = key
            held.append(part["h"].to_numpy())
    if held:
        yield row()
