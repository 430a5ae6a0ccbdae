"""Hard negatives from Hilbert-ordered blocks of candidates with zone maps.

Rows are range-partitioned by label, length of vector and place on a Hilbert curve through their first components,
and written as Parquet blocks of at most ``BLOCK`` rows of one label and length, each with the smallest and largest
value per dimension (its zone map). Interval arithmetic on a zone map gives the least and the greatest inner product
that an anchor can have in a block, so the maps alone, a small column of the table, tell which blocks it must read:

- for positives, blocks of its label that can reach the score that enough rows of its own block reach;
- for negatives, blocks of other labels whose range of scores meets one of its windows.

Anchors travel to the blocks they need, not blocks to anchors: what is shuffled grows with the (anchor, block) pairs
that the bounds leave. A block is joined by its id, scores are exact, and each task hands on only the best rows of
each anchor or window among the blocks it has read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.session import pin

#: Rows of a block, anchors that travel together, zone maps that meet them at once, rows of a sorted partition.
BLOCK, ANCHORS, MAPS, PART = 256, 256, 512, 1 << 15
#: Dimensions and bits a dimension of the curve; rows that a task holds before it sorts out the best.
CURVE, DEPTH, HELD = 15, 4, 1 << 18
#: Whole numbers whose sums of products stay below this are added exactly as doubles.
EXACT = float(1 << 46)
LONG = (-(1 << 63), (1 << 63) - 1)

_BLOCKS = "label long, dim int, n int, kind string, ids binary, vectors binary, low binary, high binary, asks binary"
_ANCHORS = "dim int, n int, ids binary, labels binary, vectors binary, floors binary"
_MAPS = "dim int, n int, blocks binary, labels binary, low binary, high binary"
_NEEDS = "block long, dim int, n int, keys binary, ids binary, vectors binary, wins binary"
_FOUND = "akey long, anchor_id long, prank int, vec_id long, score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2**bits (rows x dimensions, at most 63 bits in all)."""
    x = [c.astype(np.int64) for c in cells.T]
    if not x:
        return np.zeros(len(cells), np.int64)
    # From the outer cubes inwards, undo the turns and reflections that the curve makes in them.
    for level in range(bits - 1, 0, -1):
        inner = np.int64((1 << level) - 1)
        for i in range(len(x)):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & inner)
            x[0] = np.where(upper, x[0] ^ inner, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, np.int64((1 << level) - 1), 0)
    place = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ flip) >> level & 1)
    return place


def on_curve(vector: Column, low: float, high: float) -> Column:
    """Place of a vector on the curve through its first ``CURVE`` components, cut into 2**``DEPTH`` cells from low to high."""
    width = max(high - low, 1e-300)

    @F.arrow_udf("long")
    def place(vectors: pa.Array) -> pa.Array:
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            d = min(CURVE, size)
            part = flat[starts[own][:, None] + np.arange(d)]
            cells = np.clip((part / width - low / width) * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)
            out[own] = hilbert(cells, DEPTH)
        return pa.array(out, pa.int64())

    return place(vector)


def bounds(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each asked vector with any vector between ``low`` and ``high`` (by row).

    Widened by a hair where sums are not exact; what cannot be told is unbounded.
    """
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    with np.errstate(all="ignore"):
        slack = 1e-12 * asked.shape[1] * (np.abs(asked) @ np.maximum(np.abs(low), np.abs(high)).T)
        least = up @ low.T + down @ high.T - slack
        greatest = up @ high.T + down @ low.T + slack
    least[~np.isfinite(least)], greatest[~np.isfinite(greatest)] = -np.inf, np.inf
    # Scores stop at the ends of a long, and so do their bounds.
    return np.minimum(least, float(LONG[1])), np.maximum(greatest, float(LONG[0]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as longs (held to the ends of a long)."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) @ np.array([[int(v) for v in row] for row in b], object).reshape(b.shape).T
    return np.clip(whole + 0, *LONG).astype(np.int64) if whole.size else np.zeros(whole.shape, np.int64)


def window(score: int, percent: tuple[int, int]) -> tuple[int, int]:
    """Whole scores s with percent[0] * score <= 100 * s <= percent[1] * score."""
    return -(-percent[0] * score // 100), percent[1] * score // 100


def _packed(ids: list, vectors: list) -> tuple[str, bytes, bytes, np.ndarray]:
    matrix = np.array(vectors, np.float64).reshape(len(ids), -1)
    small = matrix.size == 0 or np.abs(matrix).max() < 32768
    return "h" if small else "d", np.array(ids, np.int64).tobytes(), matrix.astype(np.int16 if small else np.float64).tobytes(), matrix


def _matrix(kind: str, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if kind == "h" else np.float64).astype(np.float64).reshape(n, -1)


def _doubles(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 32) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that only one large value is held in Python."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of ``(vec_id, label, vector, asks)`` along the curve, written as Parquet, with zone maps and an id each."""
    # A vector may hold no component.
    ends = rows.filter(F.size("vector") > 0).agg(F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high")).first()
    placed = rows.select("label", F.size("vector").alias("dim"), on_curve(F.col("vector"), ends.low or 0.0, ends.high or 0.0).alias("place"), "vec_id", F.monotonically_increasing_id().alias("at"), "vector", "asks")
    order = ["label", "dim", "place", "vec_id", "at"]
    parts = max(1, -(-rows.count() // PART))
    sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("label", "dim", "vec_id", "vector", "asks")
    schema = _schema(_BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, asks = None, [], [], []

        def block() -> dict:
            kind, i, v, matrix = _packed(ids, vectors)
            return {"label": key[0], "dim": key[1], "n": len(ids), "kind": kind, "ids": i, "vectors": v, "low": matrix.min(0).tobytes(), "high": matrix.max(0).tobytes(), "asks": np.array(asks, bool).tobytes()}

        def blocks() -> Iterator[dict]:
            nonlocal key, ids, vectors, asks
            for batch in batches:
                for label, dim, i, v, a in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if ids and (key != (label, dim) or len(ids) == BLOCK):
                        yield block()
                        ids, vectors, asks = [], [], []
                    key = label, dim
                    ids.append(i)
                    vectors.append(v)
                    asks.append(a)
            if ids:
                yield block()

        yield from _batches(blocks(), schema)

    return pin(sorted_rows.mapInArrow(pack, _BLOCKS).withColumn("block", F.monotonically_increasing_id()))


def _anchors(blocks: DataFrame, k: int) -> DataFrame:
    """Anchors in packs, with the k-th best score that others of their own block reach as a first floor."""
    schema = _schema(_ANCHORS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def full(dim: int) -> dict:
            own = held.pop(dim)
            ids, labels, floors, vectors = zip(*own, strict=True)
            return {"dim": dim, "n": len(own), "ids": np.array(ids, np.int64).tobytes(), "labels": np.array(labels, np.int64).tobytes(), "vectors": np.array(vectors, np.float64).tobytes(), "floors": np.array(floors, np.float64).tobytes()}

        def packs() -> Iterator[dict]:
            for row in _each(batches):
                asks = np.frombuffer(row["asks"], bool)
                at = np.flatnonzero(asks)
                if not len(at):
                    continue
                ids, matrix = np.frombuffer(row["ids"], np.int64), _matrix(row["kind"], row["vectors"], row["n"])
                score = products(matrix[at], matrix).astype(np.float64)
                score[ids[at][:, None] == ids[None, :]] = -np.inf
                floor = np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(at), -np.inf)
                for j, f in zip(at.tolist(), floor.tolist(), strict=True):
                    held.setdefault(row["dim"], []).append((ids[j], row["label"], f, matrix[j]))
                    if len(held[row["dim"]]) == ANCHORS:
                        yield full(row["dim"])
                if len(held) > 64:
                    yield full(next(iter(held)))
            for dim in list(held):
                yield full(dim)

        yield from _batches(packs(), schema, 4)

    return pin(blocks.select("label", "dim", "n", "kind", "ids", "vectors", "asks").mapInArrow(gather, _ANCHORS).withColumn("pack", F.monotonically_increasing_id()))


def _zone_maps(blocks: DataFrame) -> DataFrame:
    """Zone maps of up to ``MAPS`` blocks of one length of vector in a row."""
    schema = _schema(_MAPS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def full(dim: int) -> dict:
            block, label, low, high = zip(*held.pop(dim), strict=True)
            return {"dim": dim, "n": len(block), "blocks": np.array(block, np.int64).tobytes(), "labels": np.array(label, np.int64).tobytes(), "low": b"".join(low), "high": b"".join(high)}

        def rows() -> Iterator[dict]:
            for row in _each(batches):
                held.setdefault(row["dim"], []).append((row["block"], row["label"], row["low"], row["high"]))
                if len(held[row["dim"]]) == MAPS:
                    yield full(row["dim"])
                if len(held) > 64:
                    yield full(next(iter(held)))
            for dim in list(held):
                yield full(dim)

        yield from _batches(rows(), schema, 4)

    return pin(blocks.select("block", "label", "dim", "low", "high").mapInArrow(gather, _MAPS))


def _needs(anchors: DataFrame, maps: DataFrame, same_label: bool) -> DataFrame:
    """Anchors to read each block, by bounds: ``wins`` holds rank, lower and upper end of windows, by anchor of the row.

    Every pack of anchors meets every row of zone maps once, dealt over (slot of packs, slot of maps).
    """
    of_packs, of_maps = max(1, -(-anchors.count() // 16)), max(1, -(-maps.count() // 16))
    left = anchors.withColumn("a", F.pmod(F.xxhash64("pack"), F.lit(of_packs))).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_maps - 1).cast("long"))))
    right = maps.withColumn("m", F.pmod(F.xxhash64("blocks"), F.lit(of_maps))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_packs - 1).cast("long"))))
    right = right.select("a", "m", "dim", F.col("n").alias("m_n"), "blocks", F.col("labels").alias("m_labels"), "low", "high")
    met = left.join(right.hint("shuffle_merge"), ["a", "m", "dim"]).select("pack", "dim", "n", "ids", "labels", "vectors", "floors", "wins", "m_n", "blocks", "m_labels", "low", "high")
    schema = _schema(_NEEDS)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for row in _each(batches):
                n, m = row["n"], row["m_n"]
                asked, ids, labels = _doubles(row["vectors"], n), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                blocks, block_labels = np.frombuffer(row["blocks"], np.int64), np.frombuffer(row["m_labels"], np.int64)
                least, greatest = bounds(asked, _doubles(row["low"], m), _doubles(row["high"], m))
                wins = np.frombuffer(row["wins"], np.int64).reshape(-1, 4)
                equal = labels[:, None] == block_labels[None, :]
                if same_label:
                    need = equal & (greatest >= np.frombuffer(row["floors"], np.float64)[:, None])
                else:
                    need = np.zeros(equal.shape, bool)
                    for at, _, low, high in wins.tolist():
                        need[at] |= (greatest[at] >= low) & (least[at] <= high)
                    need &= ~equal
                for b in np.flatnonzero(need.any(0)).tolist():
                    own = np.flatnonzero(need[:, b])
                    mine = wins[np.isin(wins[:, 0], own)].copy()
                    mine[:, 0] = np.searchsorted(own, mine[:, 0])
                    yield {"block": int(blocks[b]), "dim": row["dim"], "n": len(own), "keys": (row["pack"] * ANCHORS + own).astype(np.int64).tobytes(), "ids": ids[own].tobytes(), "vectors": asked[own].tobytes(), "wins": mine.tobytes()}

        yield from _batches(rows(), schema, 16)

    return met.mapInArrow(choose, _NEEDS)


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """Of rows (akey, anchor, rank, vec_id, score), the k best of each (akey, rank): high scores, then small ids."""
    rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    # ~score falls as score rises, without leaving the range of a long.
    rows = rows[np.lexsort((rows[:, 3], ~rows[:, 4], rows[:, 2], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
    first = np.flatnonzero(new)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[place < k]


def _read(needs: DataFrame, blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """Exact scores in the needed blocks: the k best rows of each anchor (or window) that a task has seen."""
    body = blocks.select("block", F.col("n").alias("b_n"), "kind", F.col("ids").alias("b_ids"), F.col("vectors").alias("b_vectors"))
    met = needs.join(body, "block").select("n", "keys", "ids", "vectors", "wins", "b_n", "kind", "b_ids", "b_vectors")
    schema = _schema(_FOUND)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, i], pa.int64()).cast(f.type) for i, f in enumerate(schema)], schema=schema)

        for row in _each(batches):
            n = row["n"]
            keys, ids = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ids"], np.int64)
            own = np.frombuffer(row["b_ids"], np.int64)
            score = products(_doubles(row["vectors"], n), _matrix(row["kind"], row["b_vectors"], row["b_n"]))
            if same_label:
                cases = [(i, 0, ids[i] != own) for i in range(n)]
            else:
                cases = [(at, rank, (score[at] >= low) & (score[at] <= high)) for at, rank, low, high in np.frombuffer(row["wins"], np.int64).reshape(-1, 4).tolist()]
            for at, rank, fits in cases:
                hit = np.flatnonzero(fits)
                if len(hit) > 4 * k:
                    floor = np.partition(score[at, hit], len(hit) - k)[len(hit) - k]
                    hit = hit[score[at, hit] >= floor]
                if len(hit):
                    hit = hit[np.lexsort((own[hit], ~score[at, hit]))][:k]
                    found.append(np.stack([np.full(len(hit), keys[at]), np.full(len(hit), ids[at]), np.full(len(hit), rank), own[hit], score[at, hit]], 1))
                    size += len(hit)
            if size > HELD:
                rows = _best(found, k)
                found, size = [rows], len(rows)
                if size > HELD // 2:
                    yield out(rows)
                    found, size = [], 0
        rows = _best(found, k)
        if len(rows):
            yield out(rows)

    order = Window.partitionBy("akey", "prank").orderBy(F.desc("score"), "vec_id")
    return met.mapInArrow(search, _FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, asks: Column, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``asks`` holds.

    ``vectors`` has ``vec_id`` (long), ``label`` and ``vector`` (array<double> of whole numbers); other columns are not
    looked at. Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of
    different lengths do not meet. An anchor's positives are its ``positives`` best rows of the same label with another
    id; the negatives of a positive are the ``negatives`` best rows of other labels whose score lies between
    ``percent`` of the positive's. Ties go to smaller ids; repeated rows count as often as they occur, as anchors too.
    Scores stop at the ends of a long. An empty table gives no rows.
    """
    sound = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1.7976931348623157E308D)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(asks, F.lit(False)).alias("asks")).filter(sound)
    blocks = candidate_blocks(rows)
    anchors, maps = _anchors(blocks, positives), _zone_maps(blocks)
    none = F.lit(b"").alias("wins")
    near = pin(_read(_needs(anchors.select("*", none), maps, True), blocks, positives, True))
    # Windows of a pack: place of the anchor, rank of the positive, least and largest score.
    pack = F.expr(f"akey div {ANCHORS}")

    @F.arrow_udf("binary")
    def ends(own: pa.Array) -> pa.Array:
        out = []
        for items in own.to_pylist():
            wins = [(i["akey"] % ANCHORS, i["rank"], *window(i["score"], percent)) for i in items]
            wins = [(a, r, max(low, LONG[0]), min(high, LONG[1])) for a, r, low, high in wins if low <= high]
            out.append(np.array(sorted(wins), np.int64).tobytes())
        return pa.array(out, pa.binary())

    wins = near.groupBy(pack.alias("pack")).agg(F.collect_list(F.struct("akey", "rank", "score")).alias("own")).select("pack", ends("own").alias("wins"))
    far = _read(_needs(anchors.join(wins, "pack"), maps, False), blocks, negatives, False)
    found = far.select("akey", "prank", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    given = near.select("akey", "anchor_id", F.col("rank").alias("prank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(given, ["akey", "prank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
