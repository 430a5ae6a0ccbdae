"""SimHash near-duplicates with pigeonring filtering, and exact components.

Two fingerprints within 3 of 64 bits, seen as a ring of four 16-bit segments, have a segment i from which every
chain of l segments differs in at most 3l/4 bits: 0, 1, 2, 3 (the pigeonring principle). So segment i is equal and
the next differs in at most one bit, which makes a 32-bit key: each distinct fingerprint is stored under its four
(i, segment i, segment i+1), and, if segment i+1 has an odd number of ones, also under the 16 keys with one of its
bits flipped; of two segments one bit apart exactly one is odd. Under a key, the remaining chains prune pairs before
the full distance. A key's links come out as a forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.buffers import chunks, expand, fresh, quoted, small_batches, spans, text_buffer
from opinara.session import pin

SHINGLE, DISTANCE, SEED = 3, 3, 42
SEGMENTS, BITS = 4, 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Links held at once before they are merged into trees.
_HELD = 1 << 20


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text: bit b is set if over half of its shingles' XXH64 have it."""
    starts, ends, rows = spans(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    size = ends - starts
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    joined[expand(at, size)] = _LOWER[data[expand(starts, size)]]
    n_words = np.diff(rows)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first = expand(rows[:-1], n)
    last = np.minimum(first + shingle - 1, np.repeat(rows[1:], n) - 1)
    body, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True)), np.uint64, len(first))
    full = np.flatnonzero(n)
    cuts = np.concatenate([[0], np.cumsum(n[full])])
    for i in range(0, len(full), 256):
        part = hashes[cuts[i] : cuts[min(i + 256, len(full))]]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64)
        own = cuts[i : i + 257][: len(full[i : i + 256])]
        ones = np.add.reduceat(bits, own - cuts[i], axis=0, dtype=np.int32)
        out[full[i : i + 256]] = np.packbits(2 * ones > n[full[i : i + 256], None], axis=1).view(">u8").ravel()
    return out


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint as a long (the 64 bits as they are); texts without words, and null, have 0."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        parts = [fingerprints(part, own, shingle) for _, _, part, own in chunks(*text_buffer(texts))]
        return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64), pa.int64())

    return simhash(text)


def _trees(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under links a - b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (deeper := root[root] != root).any():
            root[deeper] = root[root[deeper]]


def _links(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest over equal keys (sorted): pairs of fingerprints whose chains and distance are within bounds."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cut, len(keys)))
    big = size > 1
    at = expand(cut[big], size[big])
    end = np.repeat(cut[big] + size[big], size[big])
    shift = (keys[at] >> 32).astype(np.uint64)
    held_a, held_b, held = [], [], 0
    n_bits = np.uint64(BITS)
    step = 1
    while len(at):
        inside = at + step < end
        at, end, shift = at[inside], end[inside], shift[inside]
        if not len(at):
            break
        apart = prints[at] ^ prints[at + step]
        # The key makes the first segment equal; the chain goes on round the ring from there.
        total = np.zeros(len(at), np.int64)
        ok = np.ones(len(at), bool)
        for chain in range(1, SEGMENTS):
            seg = (shift + np.uint64(chain)) % np.uint64(SEGMENTS)
            total += np.bitwise_count((apart >> (seg * n_bits)) & np.uint64(0xFFFF))
            ok &= total * SEGMENTS <= (chain + 1) * distance
        ok[ok] = np.bitwise_count(apart[ok]) <= distance
        held_a.append(at[ok])
        held_b.append(at[ok] + step)
        held += int(ok.sum())
        if held > _HELD:
            root = _trees(len(keys), np.concatenate(held_a), np.concatenate(held_b))
            moved = np.flatnonzero(root != np.arange(len(keys)))
            held_a, held_b, held = [moved], [root[moved]], 0
        step += 1
    if not held_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(held_a), np.concatenate(held_b)
    root = _trees(len(keys), a, b) if len(a) else np.arange(len(keys))
    moved = np.flatnonzero(root != np.arange(len(keys)))
    return prints[moved], prints[root[moved]]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that span every component of the relation
    "at most ``distance`` bits apart"; ``distance`` is at most 3."""
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"distance must be below {SEGMENTS}")
    keys = []
    for i in range(SEGMENTS):
        own = F.shiftrightunsigned("fp", BITS * i).bitwiseAND(0xFFFF)
        following = F.shiftrightunsigned("fp", BITS * ((i + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        key = F.lit(i << 32) + own * (1 << BITS) + following
        flips = F.array(*[key.bitwiseXOR(F.lit(1 << b)) for b in range(BITS)])
        keys += [F.array(key), F.when(F.bit_count(following) % 2 == 1, flips).otherwise(F.array().cast("array<bigint>"))]
    stored = distinct.select(F.explode(F.concat(*keys)).alias("key"), "fp")
    grouped = stored.repartition("key").sortWithinPartitions("key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[np.ndarray], prints: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links(np.concatenate(keys), np.concatenate(prints).view(np.uint64), distance)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

        keys: list[np.ndarray] = []
        prints: list[np.ndarray] = []
        for batch in batches:
            k, p = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            if last or (keys and keys[-1][-1] != k[0]):
                yield out([*keys, k[:last]], [*prints, p[:last]])
                keys, prints = [], []
            keys.append(k[last:])
            prints.append(p[last:])
        if keys:
            yield out(keys, prints)

    return grouped.mapInArrow(find, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the smallest node of its component.

    Large-star and small-star rounds until nothing changes; each round's edges are written to the shared folder.
    """

    def stars(e: DataFrame, both: bool) -> DataFrame:
        # Neighbours above (small star: below) take the smallest neighbour as theirs.
        up = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        sides = up.union(up.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else up
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        near = sides.join(low, sides.u == low.w)
        if both:
            new = near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("w").alias("a"), F.col("m").alias("b")))
        return new.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = pin(edges.filter("a <> b").distinct())
    seen = mark(now)
    while True:
        now = pin(stars(stars(now, True), False))
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, representative`` for each document.

    ``component_id`` is the smallest doc_id that links of at most ``distance`` bits reach (null ids come last and
    give null only where all are null); ``representative`` marks documents with that component's smallest
    (doc_id, text hash), which only repeated rows share. Empty, null and wordless texts have fingerprint 0 and link
    like any other. An empty table gives an empty result. Writes the small fingerprint tables to the shared folder.
    """
    rows = pin(small_batches(docs).select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("text_hash"), fingerprint(quoted(text), shingle).alias("fp")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = pin(rows.groupBy("fp").agg(least.alias("least")))
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    named = rooted.select("fp", "root").join(best, "root").select("fp", "best")
    out = rows.join(named, "fp")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return out.select("doc_id", "text_hash", "fp", F.col("best.doc_id").alias("component_id"), same.alias("representative"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; columns of ``docs``."""
    key_id, key_text, place = (fresh(docs, c) for c in ("kept_id", "kept_text", "kept_place"))
    kept = near_duplicates(docs, doc_id, text, **options).filter("representative").select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_text)).distinct()
    marked = docs.withColumn(place, F.xxhash64(quoted(text)))
    found = marked.join(kept, quoted(doc_id).eqNullSafe(F.col(key_id)) & (F.col(place) == F.col(key_text)), "left_semi")
    one = Window.partitionBy(quoted(doc_id), quoted(place)).orderBy(quoted(place))
    return found.withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1).select(*[quoted(c) for c in docs.columns])
