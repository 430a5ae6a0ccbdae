"""Masked pseudo-likelihood: a bidirectional window network scores every word from both sides.

The conditional probability of a word has two factors. A network predicts its class from the ``SIDE`` words on either
side (vectors of those words, scaled by weights of their place, add up to a hidden state; a softmax gives the class).
Within the class a word has the share of its count in the whole corpus. A text's score is the sum of the conditional
log-probabilities of all its words.

Vocabulary and counts grow with the corpus. Every distinct word is counted, in a Spark table. The ``HEAD`` most frequent
ones at most are broadcast; classes cut them into pieces of about equal root mass, so frequent words have one of
their own, and all rarer words share the last class. Those of the head that occur ``COMMON`` times have a vector of their
own (``ROWS`` at most, in order of frequency), the others that of their class. Shares of rare words are looked up by a
join, so words are told apart however rare they are.

Texts are split, hashed and encoded once; rounds of training and scoring read the integer rows. In each round every
task starts from the same parameters and learns by AdaGrad from every position of all its texts; parameters are then
averaged, weighted by positions, in steps: of tasks, of groups of tasks, and of the few rows that reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.buffers import U, chunks, quoted, small_batches, spans, text_buffer, word_hashes
from opinara.session import pin

CLASSES, WIDTH, SIDE = 64, 16, 2
HEAD, ROWS, COMMON = 1 << 18, 1 << 14, 64
ROUNDS, BATCH, RATE, SEED = 2, 4096, 0.1, 5
#: Distinct words that a task holds before it hands their counts on; what a word counts that the corpus lacks.
HELD, UNSEEN = 1 << 18, 0.5
#: Groups in which the parameters of tasks are averaged, and in which those of groups are.
SALTS, LAST_SALTS = 64, 4

Model = dict[str, np.ndarray]


@dataclass
class Vocabulary:
    """Counts of all words (``h``, ``n``), and of the head: sorted hashes, vector rows, log-shares in the class."""

    counts: DataFrame
    hashes: np.ndarray
    row: np.ndarray
    share: np.ndarray
    #: Class of each vector row; the last row of all, for places beyond a text, has none.
    classes: np.ndarray
    #: Log of the count of all words outside the head.
    rest: float

    @property
    def rows(self) -> int:
        return len(self.classes)


def _add_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Counts of the words of all whole texts; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, part, own in chunks(*text_buffer(batch.column(0))):
                starts, ends, _ = spans(part, own)
                held = _add_counts(held, np.unique(word_hashes(part, starts, ends), return_counts=True))
                if len(held[0]) > HELD:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(held[0].view(np.int64), pa.int64()), "n": pa.array(held[1], pa.int64())})
                    held = np.zeros(0, U), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"h": pa.array(held[0].view(np.int64), pa.int64()), "n": pa.array(held[1], pa.int64())})

    counts = pin(small_batches(docs).select(quoted(text)).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2("n") * 32).cast("int")
    sizes = {r.step: (r.words, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()}
    least, words, mass = None, 0, 0
    for s in sorted(sizes, reverse=True):
        if words + sizes[s][0] > HEAD or s == 0:
            break
        least, words, mass = s, words + sizes[s][0], mass + sizes[s][1]
    head = counts.filter(step >= least).toArrow() if least is not None else None
    h = head.column("h").to_numpy().view(U) if head else np.zeros(0, U)
    n = head.column("n").to_numpy() if head else np.zeros(0, np.int64)
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    root = np.cumsum(np.sqrt(n))
    kind = np.minimum(root / (root[-1] if len(root) else 1.0) * (CLASSES - 1), CLASSES - 2).astype(np.int64)
    own = min(ROWS, int((n >= COMMON).sum()))
    row = np.where(np.arange(len(h)) < own, np.arange(len(h)), own + kind)
    total = np.bincount(kind, n, CLASSES)
    rest = sum(x for _, x in sizes.values()) - mass + UNSEEN
    place = np.argsort(h)
    return Vocabulary(counts, h[place], row[place], (np.log(n) - np.log(total[kind]))[place], np.concatenate([kind[:own], np.arange(CLASSES)]), float(np.log(rest)))


def encode(docs: DataFrame, words: Vocabulary, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Texts as rows of vectors, written once: ``rid``, ``k0``.. (the columns ``keep``), ``n_words``, ``words``, ``fixed``, ``rare``.

    ``fixed`` is the part of the score that does not depend on neighbours, ``rare`` holds hashes of words outside the head.
    """
    names = list(docs.columns) if keep is None else list(keep)
    names = [c for c in names if c != text]
    held = docs.sparkSession.sparkContext.broadcast((words.hashes, words.row, words.share))
    last, rest = words.rows - 1, words.rest
    source = small_batches(docs).select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(names)], quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row_of_word, share = held.value
        for batch in batches:
            for first, end, part, own in chunks(*text_buffer(batch.column(len(names)))):
                starts, ends, bounds = spans(part, own)
                found = word_hashes(part, starts, ends)
                at = np.minimum(np.searchsorted(hashes, found), max(0, len(hashes) - 1))
                hit = hashes[at] == found if len(hashes) else np.zeros(len(found), bool)
                row, fixed = np.full(len(found), last), np.full(len(found), -rest)
                row[hit], fixed[hit] = row_of_word[at[hit]], share[at[hit]]
                summed = np.concatenate([[0.0], np.cumsum(fixed)])
                body, size = row.astype(np.uint16).tobytes(), 2 * bounds
                away = np.concatenate([[0], np.cumsum(~hit)])[bounds]
                columns = [batch.column(i).slice(first, end - first) for i in range(len(names))]
                columns += [
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([body[a:b] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)], pa.binary()),
                    pa.array(summed[bounds[1:]] - summed[bounds[:-1]], pa.float64()),
                    pa.ListArray.from_arrays(pa.array(away, pa.int32()), pa.array(found[~hit].view(np.int64), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(len(names))), "n_words", "words", "fixed", "rare"])

    added = {"n_words": T.LongType(), "words": T.BinaryType(), "fixed": T.DoubleType(), "rare": T.ArrayType(T.LongType())}
    kept = T.StructType([*source.drop("text").schema.fields, *(T.StructField(name, kind) for name, kind in added.items())])
    return pin(source.mapInArrow(run, kept).withColumn("rid", F.monotonically_increasing_id()))


def shapes(rows: int) -> dict[str, tuple[int, ...]]:
    return {"embed": (rows + 1, WIDTH), "offset": (2 * SIDE, WIDTH), "class_w": (CLASSES, WIDTH), "class_b": (CLASSES,)}


def initial(rows: int, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    out = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in shapes(rows).items()}
    out["offset"][:] = 1 / SIDE
    out["class_b"][:] = 0
    return out


def flat(model: Model) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in ("embed", "offset", "class_w", "class_b")])


def shaped(values: np.ndarray, rows: int) -> Model:
    out, at = {}, 0
    for k, s in shapes(rows).items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].astype(np.float32).reshape(s)
        at += n
    return out


def contexts(parts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words, rows around each (``pad`` beyond a text's ends), word offsets by text."""
    row = np.frombuffer(b"".join(parts), np.uint16).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(p) // 2 for p in parts])]).astype(np.int64)
    text = np.repeat(np.arange(len(parts)), np.diff(bounds))
    around = np.full((len(row), 2 * SIDE), pad, np.int64)
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), len(row) - max(0, d)
        if b > a:
            around[a:b, j] = np.where(text[a:b] == text[a + d : b + d], row[a + d : b + d], pad)
    return row, around, bounds


def _hidden(model: Model, around: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    near = [model["embed"].take(around[:, j], axis=0) for j in range(2 * SIDE)]
    hidden = near[0] * model["offset"][0]
    for x, w in zip(near[1:], model["offset"][1:], strict=True):
        hidden += x * w
    return near, np.tanh(hidden, out=hidden)


def _weights(model: Model, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the classes' scores and one over their sums, row by row."""
    z = hidden @ model["class_w"].T
    z += model["class_b"]
    # A hidden state is within -1 and 1, so this bounds all scores; beyond it the largest is taken out first.
    if np.abs(model["class_w"]).sum(1).max() + np.abs(model["class_b"]).max() > 80:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, 1 / (z @ np.ones(CLASSES, np.float32))


def learn(model: Model, kind: np.ndarray, around: np.ndarray, memory: Model) -> None:
    """One AdaGrad step on a batch of classes and the rows around them; ``memory`` sums squared gradients."""
    n = len(kind)
    near, hidden = _hidden(model, around)
    p, one = _weights(model, hidden)
    # Probabilities are p * one; the own class's 1 is taken off the gradients, not off each row.
    back = (p @ model["class_w"]) * one[:, None] - model["class_w"].take(kind, axis=0)
    back *= 1 - hidden * hidden
    own = np.stack([np.bincount(kind, h, CLASSES) for h in hidden.T], 1).astype(np.float32)
    grad = {"class_w": p.T @ (hidden * one[:, None]) - own, "class_b": one @ p - np.bincount(kind, minlength=CLASSES).astype(np.float32)}
    grad["offset"] = np.stack([np.einsum("ij,ij->j", x, back) for x in near])
    index = around.T.ravel().astype(np.uint16)
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    step = np.concatenate([back * w for w in model["offset"]]).take(order, axis=0)
    # Only the vectors of the batch move, so a step costs as much in a large vocabulary as in a small one.
    touched, summed = index[first], np.add.reduceat(step, first, axis=0) / np.float32(n) ** 0.5
    memory["embed"][touched] += summed * summed
    model["embed"][touched] -= RATE * summed / np.sqrt(memory["embed"][touched] + 1e-6)
    for k, g in grad.items():
        g = g / np.float32(n) ** 0.5
        memory[k] += g * g
        model[k] -= RATE * g / np.sqrt(memory[k] + 1e-6)


def log_probabilities(model: Model, kind: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each class given the rows around."""
    out = np.zeros(len(kind))
    for a in range(0, len(kind), BATCH):
        part = slice(a, a + BATCH)
        p, one = _weights(model, _hidden(model, around[part])[1])
        out[part] = np.log(p[np.arange(len(p)), kind[part]] * one)
    return out


def train(encoded: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Train on all positions of all texts; without a word the parameters stay as they began. One job per round."""
    spark = encoded.sparkSession
    rows, classes = words.rows, words.classes
    model = initial(rows)
    schema = "salt int, n long, v binary"
    fields = pa.schema([("salt", pa.int32()), ("n", pa.int64()), ("v", pa.binary())])
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(flat(model))

        def local(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = shaped(held.value.copy(), rows)
            memory, n, parts, size = {k: np.zeros(s, np.float32) for k, s in shapes(rows).items()}, 0, [], 0

            def take() -> int:
                row, around, _ = contexts(parts, rows)
                # Steps of equal size, so that none is small.
                cuts = np.linspace(0, len(row), max(1, round(len(row) / BATCH)) + 1).astype(int).tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    learn(own, classes[row[a:b]], around[a:b], memory)
                return len(row)

            for batch in batches:
                for part in batch.column(0).to_pylist():
                    parts.append(part)
                    size += len(part) // 2
                    if size >= 16 * BATCH:
                        n, parts, size = n + take(), [], 0
            if size:
                n += take()
            if n:
                yield pa.RecordBatch.from_pylist([{"salt": TaskContext.get().partitionId() % SALTS, "n": n, "v": flat(own).tobytes()}], fields)

        def mean(table: pa.Table) -> pa.Table:
            n = table.column("n").to_numpy()
            total = sum(np.frombuffer(v.as_py(), np.float32) * float(k) for v, k in zip(table.column("v"), n, strict=True))
            return pa.Table.from_pylist([{"salt": table.column("salt")[0].as_py() % LAST_SALTS, "n": int(n.sum()), "v": (total / n.sum()).astype(np.float32).tobytes()}], fields)

        parts = encoded.select("words").mapInArrow(local, schema).groupBy("salt").applyInArrow(mean, schema).groupBy("salt").applyInArrow(mean, schema).collect()
        if parts:
            total = sum(r.n for r in parts)
            model = shaped(sum(np.frombuffer(r.v, np.float32).astype(float) * (r.n / total) for r in parts), rows)
    return model


def score(encoded: DataFrame, words: Vocabulary, model: Model, names: Sequence[str] = ()) -> DataFrame:
    """Columns ``k0``.. under ``names``, ``n_words`` and ``log_likelihood`` (0 for texts without words, and null).

    A word that the corpus of the vocabulary lacks counts ``UNSEEN``.
    """
    held = encoded.sparkSession.sparkContext.broadcast(flat(model))
    rows, classes = words.rows, words.classes

    @F.arrow_udf("double")
    def from_both_sides(parts: pa.Array) -> pa.Array:
        own, out = shaped(held.value, rows), []
        texts = parts.to_pylist()
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < 1 << 18:
                size += len(texts[stop])
                stop += 1
            row, around, bounds = contexts(texts[at:stop], rows)
            summed = np.concatenate([[0.0], np.cumsum(log_probabilities(own, classes[row], around))])
            out.append(summed[bounds[1:]] - summed[bounds[:-1]])
            at = stop
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    rare = encoded.select("rid", F.explode("rare").alias("h")).join(words.counts, "h", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).alias("of_rare"))
    kept = [f"k{i}" for i in range(len(names))]
    scored = encoded.select("rid", *kept, "n_words", (F.col("fixed") + from_both_sides(F.col("words"))).alias("ll")).join(rare, "rid", "left")
    return scored.select(*[F.col(k).alias(c) for k, c in zip(kept, names, strict=True)], "n_words", (F.col("ll") + F.coalesce("of_rare", F.lit(0.0))).alias("log_likelihood"))


def pseudo_likelihood(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Columns ``keep`` (all but the text) of ``docs`` with ``n_words`` and ``log_likelihood`` under a model of all its texts.

    Null and empty texts have no words and score 0. Null ids, repeated rows and equal texts are rows like any other:
    each is learned from and scored. A column of ``docs`` named like a result is returned beside it.
    """
    words = vocabulary(docs, text)
    names = [c for c in (docs.columns if keep is None else keep) if c != text]
    encoded = encode(docs, words, text, names)
    return score(encoded, words, train(encoded, words, rounds), names)
