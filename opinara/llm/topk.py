"""Exact top-k by inner product with multi-resolution segment statistics.

A vector cut into segments of L components has mean m and deviation s in each. For two vectors the squared distance
is at least the sum of L((m - m')² + (s - s')²), and so their inner product at most the sum of L(m m' + s s'). Coarse
segments are tried first: a candidate whose bound is below the k-th best score known for the query is dropped, the
rest meet finer segments, and only survivors get exact products.

Queries and candidates travel in blocks of bounded size. Query blocks are copied to ``slots`` of candidates and
candidate blocks to the query blocks, joined on (query block, slot), so every pair of blocks meets once in one of
many tasks, and each task keeps the k best of each query it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.buffers import quoted

QUERY_BLOCK, CANDIDATE_BLOCK, BLOCKS_PER_SLOT = 512, 4096, 4
RESOLUTIONS = (1, 4, 16)
_PACKED = "dim int, n int, ids binary, vectors binary"
_EXACT = float(1 << 53)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled by the root of its length: bounds are products of these."""
    cuts = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    if not parts:
        return np.zeros((len(x), 2))
    return np.concatenate([np.stack([p.mean(1), p.std(1)], 1) * np.sqrt(p.shape[1]) for p in parts], 1)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row, or minus infinity where a row has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the candidates with another id that can be among a query's k best.

    ``floor`` holds a score per query that k candidates are known to reach; it is raised in place, and candidates
    below it are left out. Per block at most k come out for each query, ties to smaller ids.
    """
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    largest = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(1, queries.shape[1])
    if largest >= _EXACT:
        return _best_of_large(query_ids, queries, ids, vectors, k)
    left, kept, dead = np.arange(len(ids)), vectors, None
    for segments in RESOLUTIONS:
        # A hair of slack covers rounding of the bounds; products themselves are exact.
        bound = statistics(queries, segments) @ statistics(kept, segments).T
        bound += 1e-9 * largest + 1e-9
        bound[query_ids[:, None] == ids[left][None, :]] = -np.inf
        n = min(2 * k, len(left))
        if n and (segments == RESOLUTIONS[-1] or np.isneginf(floor).any()):
            # The most promising candidates are tried at once and raise the floor.
            first = np.argpartition(bound, len(left) - n, axis=1)[:, len(left) - n :]
            sure = np.einsum("qd,qnd->qn", queries, kept[first])
            sure[np.isneginf(np.take_along_axis(bound, first, 1))] = -np.inf
            np.maximum(floor, _kth(sure, k), out=floor)
        # Segments nest, so a finer bound is never above a coarser one and the last tells all.
        dead = (bound < floor[:, None]) | np.isneginf(bound)
        some = ~dead.all(0)
        if not some.all():
            left, kept, dead = left[some], kept[some], dead[:, some]
    scores = queries @ kept.T
    scores[dead] = -np.inf
    rows, at = np.nonzero((scores >= floor[:, None]) & ~dead)
    scores = scores[rows, at]
    order = np.lexsort((ids[left[at]], -scores, rows))
    rows, at, scores = rows[order], left[at[order]], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    last = place == k - 1
    floor[rows[last]] = np.maximum(floor[rows[last]], scores[last])
    return rows[place < k], at[place < k], scores[place < k].astype(np.int64)


def _best_of_large(query_ids, queries, ids, vectors, k):
    """The same for values whose products leave the exact range of doubles: whole numbers, held to the range of a long."""
    whole = [[int(v) for v in row] for row in vectors.tolist()]
    rows, at, scores = [], [], []
    for q, own in enumerate(queries.tolist()):
        own = [int(v) for v in own]
        got = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(own, row, strict=True)))), i) for i, row in enumerate(whole) if ids[i] != query_ids[q]]
        for score, i in sorted(got, key=lambda x: (-x[0], ids[x[1]]))[:k]:
            rows.append(q)
            at.append(i)
            scores.append(score)
    return np.array(rows, np.int64), np.array(at, np.int64), np.array(scores, np.int64)


def _matrix(block: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["vectors"], np.float64).reshape(block["n"], block["dim"])


def _pack(dim: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
    return {"dim": dim, "n": len(ids), "ids": np.ascontiguousarray(ids).tobytes(), "vectors": np.ascontiguousarray(vectors).tobytes()}


def _packed(size: int):
    """Rows (id, vector) to blocks of one length of vector each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            rows = []
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                matrix = flat[(starts[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim).astype(np.float64)
                rows += [_pack(dim, ids[own[a : a + size]], matrix[a : a + size]) for a in range(0, len(own), size)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank`` (from 1)``, vec_id, score`` for the k largest inner products of each query.

    Both tables hold ``vec_id`` (long) and ``vector`` (array<double> of whole numbers). A query does not meet rows
    with its own id. Rows with a null id, a null vector or a null or non-finite component take no part; vectors of
    different lengths do not meet. Ties go to the smaller id; repeated rows count as often as they occur. Scores
    are exact; beyond the range of a long they stop at its ends. Two small jobs count the rows of both tables.
    """
    sound = lambda df: df.filter("vec_id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1.7976931348623157E308D)")
    cand, ask = sound(vectors.select("vec_id", "vector")), sound(queries.select("vec_id", "vector"))
    n_cand, n_ask = cand.count(), ask.count()
    n_blocks = max(1, -(-n_ask // QUERY_BLOCK))
    n_slots = max(1, -(-n_cand // (CANDIDATE_BLOCK * BLOCKS_PER_SLOT)))
    asked = ask.repartition(n_blocks, F.xxhash64("vec_id")).mapInArrow(_packed(QUERY_BLOCK), _PACKED)
    given = cand.repartition(max(1, -(-n_cand // CANDIDATE_BLOCK)), F.xxhash64("vec_id")).mapInArrow(_packed(CANDIDATE_BLOCK), _PACKED)
    block = F.pmod(F.xxhash64("ids"), F.lit(n_blocks))
    slot = F.pmod(F.xxhash64("ids"), F.lit(n_slots))
    left = given.withColumn("slot", slot).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = asked.withColumn("block", block).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))))
    right = right.select("block", "slot", "dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    left = left.select(F.col("block").cast("long"), F.col("slot").cast("long"), "dim", "n", "ids", "vectors")
    right = right.select(F.col("block").cast("long"), F.col("slot").cast("long"), "dim", "q_n", "q_ids", "q_vectors")
    met = left.join(right.hint("shuffle_merge"), ["block", "slot", "dim"]).select("dim", "n", "ids", "vectors", "q_n", "q_ids", "q_vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of one slot come one after another, so a query block's floor serves its next candidates too.
        own, floor = b"", None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, matrix = _matrix(row)
                query_ids, asked = _matrix({"dim": row["dim"], "n": row["q_n"], "ids": row["q_ids"], "vectors": row["q_vectors"]})
                if row["q_ids"] != own:
                    own, floor = row["q_ids"], np.full(len(asked), -np.inf)
                q, at, score = best_of_block(query_ids, asked, ids, matrix, k, floor)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[q], pa.int64()), "vec_id": pa.array(ids[at], pa.int64()), "score": pa.array(score, pa.int64())})

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
