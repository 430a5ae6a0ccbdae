"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of ASCII letters, digits and all non-ASCII characters; a text is the set of its terms'
64-bit hashes. The machine adds a weight for each known term and, for each pair, the product of their factors, so a
pair such as an insult with a group mention counts beyond both weights. The model is fitted on a bounded sample of
labelled rows (``MAX_POSITIVE``, ``MAX_NEGATIVE`` expected, chosen by hash) and holds every term of that sample, so
pairs of terms that say nothing alone are learned too; it is broadcast, and every text is scored whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.buffers import chunks, expand, quoted, row_of, small_batches, span_hashes, spans, text_buffer

MAX_POSITIVE, MAX_NEGATIVE = 5_000, 10_000
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY, LEAST, KNOWN, POWER, REIN, START_W, START_V, SEED = 60, 256, 0.1, 1e-4, 5e-2, 1.5, 8, 1.0, 1e-6, 1e-3, 11
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and n + 1 offsets by row."""
    starts, ends, rows = spans(data, offsets, _GAP)
    return span_hashes(_FOLDED[data], starts, ends), rows


def term_set(text: Column) -> Column:
    """Distinct term hashes of a text, as longs."""

    @F.arrow_udf("array<bigint>")
    def terms(texts: pa.Array) -> pa.Array:
        out, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, part, own in chunks(*text_buffer(texts)):
            hashes, rows = term_hashes(part, own)
            sets = [np.unique(hashes[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            out += sets
            sizes.append(np.array([len(s) for s in sets], np.int64))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out).view(np.int64), pa.int64()))

    return terms(text)


class Machine:
    """Second-order factorization machine over presence of known terms."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, factors: np.ndarray, bias: float):
        self.terms, self.weights, self.factors, self.bias = terms, weights, factors, bias

    def raw(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log-odds of texts given all their term hashes."""
        n = len(rows) - 1
        out = np.full(n, self.bias)
        if not len(self.terms) or not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == hashes)
        pairs = np.unique(row_of(rows)[hit] * len(self.terms) + at[hit])
        row, term = pairs // len(self.terms), pairs % len(self.terms)
        out += np.bincount(row, self.weights[term], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def fit(sets: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Learn weights and factors of all terms in ``sets`` by AdaGrad on the logistic loss.

    No term is left out; terms are held back instead. Weights pay an absolute penalty that falls with how far a
    term's shares differ between the classes, factors a quadratic one that grows with what a single text can add to a
    direction of theirs (its terms over the number of texts). A step touches the terms of its batch only, with the
    penalty of the batches a term was not in, so the pull per epoch is the same however rare it is. Classes weigh
    the same, so the bias starts at 0.
    """
    rng = np.random.default_rng(SEED)
    if not len(sets) or labels.min() == labels.max():
        share = float(labels.mean()) if len(sets) else 0.5
        return Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    size = np.array([len(s) for s in sets])
    terms, back = np.unique(np.concatenate(sets), return_inverse=True)
    y = labels.astype(float)
    n1, n0 = y.sum(), (1 - y).sum()
    balance = np.where(y > 0, 0.5 * len(y) / n1, 0.5 * len(y) / n0)
    seen, toxic = np.bincount(back), np.bincount(back, np.repeat(y, size))
    share = seen / len(y)
    apart = np.abs(toxic / n1 - (seen - toxic) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    least = (LEAST * np.minimum(1, KNOWN / np.maximum(apart * seen / (seen + 2), 1e-9)) ** POWER).astype(np.float32)
    place = np.concatenate([[0], np.cumsum(size)])
    order, batches = rng.permutation(len(sets)), []
    for a in range(0, len(order), BATCH):
        i = order[a : a + BATCH]
        own, column = np.unique(back[expand(place[i], size[i])], return_inverse=True)
        row, by_term = np.repeat(np.arange(len(i)), size[i]), np.argsort(column, kind="stable")
        filled = np.flatnonzero(size[i])
        starts = np.cumsum(size[i])[filled] - size[i][filled]
        batches.append((y[i], balance[i] / len(i), own, column, row, row[by_term], np.searchsorted(column[by_term], np.arange(len(own))), filled, starts))
    rein = REIN * size.mean() / len(sets)
    often = len(batches) / np.maximum(1, np.bincount(np.concatenate([x[2] for x in batches]), minlength=len(terms))).astype(np.float32)
    w, v, b = np.zeros(len(terms), np.float32), rng.normal(0, 0.01, (len(terms), FACTORS)).astype(np.float32), np.float32(0)
    gw, gv, gb = np.full_like(w, START_W), np.full_like(v, START_V), START_W
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            target, weight, own, column, row, row_by_term, cuts, filled, starts = batches[k]
            if not len(own):
                continue
            wt, vt, rate = w[own], v[own], often[own]
            z, s = np.full(len(target), b, np.float32), np.zeros((len(target), FACTORS), np.float32)
            s[filled] = np.add.reduceat(vt[column], starts, axis=0)
            z[filled] += np.add.reduceat((wt - 0.5 * (vt**2).sum(1))[column], starts)
            z += 0.5 * (s**2).sum(1)
            g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)).astype(np.float32)
            dw = np.add.reduceat(g[row_by_term], cuts)
            dv = np.add.reduceat((g[:, None] * s)[row_by_term], cuts, axis=0) - vt * dw[:, None] + rein * rate[:, None] * vt
            dw += DECAY * rate * wt
            db = float(g.sum())
            gw[own] += dw**2
            gv[own] += dv**2
            gb += db**2
            step = RATE / np.sqrt(gw[own])
            moved = wt - step * dw
            w[own] = np.sign(moved) * np.maximum(np.abs(moved) - step * least[own] * rate, 0)
            v[own] -= RATE * dv / np.sqrt(gv[own])
            b -= np.float32(RATE * db / np.sqrt(gb))
    return Machine(terms, w, v, float(b))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Machine:
    """Fit on a sample of ``labels`` (key, label) that expects at most the given rows of each class.

    The share of each class follows from its count, and a row is in or out by the hash of its key; all rows of a
    class are in if there are fewer. Null labels are left out. The sample of keys meets the documents in a
    broadcast, so texts stay where they are; only term sets reach the one task that fits, and the model's bytes
    the driver.
    """
    small_batches(docs)
    known = labels.select(quoted(key).alias("label_key"), quoted(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    ceiling = 1 << 30
    keep = {c: min(ceiling, int(ceiling * m / max(1, n.get(c, 0)))) for c, m in ((1, max_positive), (0, max_negative))}
    place = F.pmod(F.xxhash64("label_key", F.lit(SEED)), F.lit(ceiling))
    chosen = known.filter(place < F.when(F.col("label") == 1, keep[1]).otherwise(keep[0]))
    side = F.broadcast(chosen) if chosen.count() <= 4 * (max_positive + max_negative) else chosen
    sample = docs.select(quoted(key).alias("doc_key"), quoted(text).alias("doc_text")).join(side, F.col("doc_key") == F.col("label_key"))
    sets = sample.select(F.col("doc_key").cast("string").alias("key"), "label", term_set(F.col("doc_text")).alias("terms"))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("label", "ascending")])
        terms = table.column("terms").combine_chunks()
        flat, cuts = terms.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
        got = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"model": pa.array([pickle.dumps(fit(got, table.column("label").to_numpy()).__dict__)], pa.binary())})

    rows = sets.withColumn("sample", F.lit(1)).groupBy("sample").applyInArrow(learn, "model binary").collect()
    return Machine(**pickle.loads(rows[0].model)) if rows else fit([], np.zeros(0))


def toxicity(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """Score from 0 to 1; texts without known terms, empty and null ones too, get the model's bias."""
    held = docs.sparkSession.sparkContext.broadcast(machine.__dict__)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = Machine(**held.value)
        raw = [model.raw(*term_hashes(part, own)) for _, _, part, own in chunks(*text_buffer(texts))]
        z = np.concatenate(raw) if raw else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

    return score(quoted(text))
