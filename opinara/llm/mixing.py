"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is a whole number of blocks of ``BLOCK`` words. Highest quotients target / (2k + 1) deal the blocks to
sources, and a source's blocks to its shards by their sizes, never more than ``cap`` times what there is. Within a
shard the documents stand in a seeded order; blocks are cut from that stream, all of them are taken
quota // blocks times, and the seeded order's first quota % blocks once more. Documents stay whole but for the
two ends of such a run. Shards hold about ``SHARD_WORDS`` words, and ``SHARD_ROWS`` rows, whatever the source's size, so a source with a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.buffers import count_words, fresh, head_words, quoted, rows_join, small_batches

BLOCK, SHARD_WORDS, SHARD_ROWS, SEED = 32, 1 << 20, 1 << 16, 17
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Shares of ``total`` by weight; a share stops at ``cap`` times its size and the excess is shared anew."""
    out, limit = np.zeros(len(sizes)), cap * np.asarray(sizes, float)
    free = limit > 0
    left = float(total)
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share >= limit)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = limit[over]
        left -= float(limit[over].sum())
        free &= ~over
    return out


def apportion(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats one by one to the highest weight / (2k + 1) with k < most; ties to the first.

    A divisor search deals nearly all seats at once; the last few go one by one.
    """
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    most = np.where(weights > 0, most, 0)
    seats = int(min(seats, most.sum()))
    got = np.zeros(len(weights), np.int64)
    if not seats:
        return got
    low, high = 0.0, 1.0
    deal = lambda m: np.minimum(most, np.floor(weights * m + 0.5).clip(max=2**62).astype(np.int64))
    while deal(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if deal(middle).sum() < seats else (low, middle)
    got = deal(low)
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < most)]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """Add what the mix takes of each document: ``size, source_size, target, taken``.

    Size is the number of words (null text: 0). Sources in code-point order, null last as a source of its own,
    weigh ``weights`` in turn and share ``share`` times all words. ``taken`` counts words, repeats included, and
    is at most ``cap`` (rounded up) times the size. Reruns agree: the order within a shard depends on doc_id, size
    and ``seed`` only, and rows equal in both are interchangeable. Empty tables and sources without words take
    nothing. Result columns replace columns of the same names; ``names`` renames them.

    Two jobs run while the plan is built: words by source come to the driver, one row per source, and shards are
    counted. One task deals a source's blocks to its shards: one row per ``SHARD_WORDS`` words.
    """
    spark = small_batches(docs).sparkSession
    out = {c: (names or {}).get(c, c) for c in ("size", "source_size", "target", "taken")}
    sized = docs.withColumn(out["size"], count_words(quoted(text)))
    kind = docs.schema[source].dataType
    sums = sized.groupBy(quoted(source).alias("s")).agg(F.sum(out["size"]).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    sums.sort(key=lambda r: (r.s is None, r.s or ""))
    sizes = np.array([r.n for r in sums], np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(sums))], float)
    goal = targets(sizes, weight, share * float(sizes.sum()), cap)
    blocks = -(-sizes // BLOCK)
    seats = apportion(goal, round(float(goal.sum()) / BLOCK), np.ceil(cap * blocks).astype(np.int64))
    # Sources of many short or empty texts are cut by rows.
    shards = np.maximum(np.maximum(1, -(-sizes // SHARD_WORDS)), [-(-r["rows"] // SHARD_ROWS) for r in sums] or 1)
    source_key, shard, quota, held, start, n_shards = (fresh(sized, c) for c in ("source_key", "shard", "quota", "shard_words", "start", "n_shards"))
    fields = f"`{source_key}` {kind.simpleString()}, `{out['source_size']}` long, `{out['target']}` double, `{quota}` long, `{n_shards}` long"
    rows = [(r.s, int(n), float(t), int(q), int(k)) for r, n, t, q, k in zip(sums, sizes, goal, seats, shards, strict=True)]
    by_source = spark.createDataFrame(rows, fields)
    order = F.xxhash64(quoted(doc_id), quoted(out["size"]), F.lit(seed))
    base = sized.drop(*[out[c] for c in ("source_size", "target", "taken") if out[c] in sized.columns]).withColumn(source_key, quoted(source))
    base = rows_join(base, by_source, [source_key], "left").withColumn(shard, F.pmod(order, quoted(n_shards)))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(shard)
        n = pdf[held].to_numpy()
        most = np.ceil(cap * -(-n // BLOCK)).astype(np.int64)
        return pdf.assign(**{quota: apportion(n, int(pdf[quota].iloc[0]), most)})[[source_key, shard, held, quota]]

    filled = base.groupBy(quoted(source_key), quoted(shard), quoted(quota)).agg(F.sum(out["size"]).alias(held))
    dealt = filled.groupBy(quoted(source_key)).applyInPandas(deal, f"`{source_key}` {kind.simpleString()}, `{shard}` long, `{held}` long, `{quota}` long")
    whole = rows_join(base.drop(quota), dealt, [source_key, shard], "left")
    before = Window.partitionBy(quoted(source_key), quoted(shard)).orderBy(F.xxhash64(quoted(doc_id), F.lit(seed + 1)), quoted(doc_id), quoted(out["size"])).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn(start, F.coalesce(F.sum(out["size"]).over(before), F.lit(0)))
    size, n = quoted(out["size"]), F.greatest(F.ceil(quoted(held) / BLOCK), F.lit(1))
    rest = quoted(quota) % n * BLOCK
    once_more = F.greatest(F.least(quoted(start) + size, rest) - F.least(quoted(start), rest), F.lit(0))
    whole = whole.withColumn(out["taken"], (F.floor(quoted(quota) / n) * size + once_more).cast("long"))
    return whole.drop(source_key, shard, quota, held, start, n_shards)


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: a row for each whole copy that is taken of a document, and one for its part, if any.

    A part is the document's first words, up to the end of the last of them. Columns are those of ``docs``;
    documents without words add nothing to the mix and are left out with those it does not take.
    """
    names = {c: fresh(docs, f"mix_{c}") for c in ("size", "source_size", "target", "taken")}
    chosen = plan(docs, text=text, names=names, **options)
    size, taken = quoted(names["size"]), quoted(names["taken"])
    words = fresh(docs, "mix_words")
    copies = F.floor(taken / size).cast("int")
    lengths = F.concat(F.array_repeat(size, copies), F.when(taken % size > 0, F.array(taken % size)).otherwise(F.array().cast("array<bigint>")))
    rows = chosen.filter(taken > 0).withColumn(words, F.explode(lengths))
    part = head_words(quoted(text), quoted(words))
    return rows.withColumn(text, F.when(quoted(words) < size, part).otherwise(quoted(text))).select(*[quoted(c) for c in docs.columns])
