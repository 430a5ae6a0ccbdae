"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each of its letter trigrams (a letter with the characters on either side, lower
case, everything that is no letter read as one blank) is drawn from one of them. Expectation-maximisation finds the
proportions with the greatest likelihood, starting from equal shares. Languages are then ranked by share, and the
set of the first s is chosen whose likelihood, with proportions fitted anew, is greatest after a penalty of
``PENALTY`` * log(trigrams) for each language beyond the first. The prediction is the language with the largest
share of the chosen set. The score is that share, or for a set of one the posterior probability of its language
against each other one alone, so a text that says little scores low.

Probabilities come from counts over all texts with a language: add-``PRIOR`` towards the pooled distribution of all
languages, which gives every language some mass on every known trigram. Trigrams beyond the table of the
``TABLE_CELLS`` / (number of languages) most telling ones (by their largest share in any language) fall back to their
middle letter. The table's size is the bound of the broadcast; nothing else that is broadcast grows with the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.buffers import CHUNK_BYTES, chunks, mix, process_cache, quoted, small_batches, text_buffer
from opinara.session import pin

#: Cells (trigram, language) of the broadcast table, rows of letters in it, languages it can hold.
TABLE_CELLS, LETTER_ROWS, MAX_LANGUAGES = 1 << 21, 1 << 14, 1 << 8
PRIOR, PENALTY, ROUNDS, SURE = 200.0, 6.0, 12, 1e-3
#: Code points that one pass handles, and distinct (language, trigram) pairs that a task holds before it hands them on.
SLICE, HELD = 1 << 18, 1 << 20
UNKNOWN = "und"

_BITS = np.int64(21)
_MASK = np.int64((1 << 21) - 1)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    cache = process_cache("letters")
    if "is" not in cache:
        cache["is"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["is"]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every letter of a chunk of texts, in slices of at most ``SLICE`` code points or so.

    A key holds three code points of 21 bits, 0 for no letter.
    """
    alpha = letters()
    body = data.tobytes()
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    size = 0

    def ready() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(owners), np.concatenate(held)

    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = body[a:b].decode("utf-8", "replace").lower()
        for at in range(0, len(text), SLICE):
            # One character more on each side, so that slices know their neighbours.
            lead = 1 if at else 0
            points = np.frombuffer(text[at - lead : at + SLICE + 1].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            n = min(SLICE, len(text) - at)
            kept = np.zeros(n + 2, np.int64)
            part = np.where(alpha[points], points, 0)
            kept[1 - lead : 1 - lead + len(part)] = part[: n + 1 + lead]
            middle = np.flatnonzero(kept[1:-1])
            held.append(kept[middle] << (2 * _BITS) | kept[middle + 1] << _BITS | kept[middle + 2])
            owners.append(np.full(len(middle), row, np.int64))
            size += n
            if size >= SLICE:
                yield ready()
                held, owners, size = [], [], 0
    if held:
        yield ready()


def counted(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, gram, n)`` over all texts with a language; letters alone have the key of their middle only, negated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        place: dict[str, int] = {}
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def add(code: int, keys: np.ndarray, n: np.ndarray) -> None:
            if code in sums:
                keys, n = np.concatenate([sums[code][0], keys]), np.concatenate([sums[code][1], n])
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, n = keys[first], np.add.reduceat(n, first)
            sums[code] = keys, n

        def flush() -> Iterator[pa.RecordBatch]:
            for code, (keys, n) in sums.items():
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([names[code]] * len(keys[part]), pa.string()), "gram": pa.array(keys[part], pa.int64()), "n": pa.array(n[part], pa.int64())})
            sums.clear()

        for batch in batches:
            codes = []
            for name in batch.column(0).to_pylist():
                if name not in place:
                    place[name] = len(names)
                    names.append(name)
                codes.append(place[name])
            codes = np.array(codes, np.int64)
            for first, _, part, own in chunks(*text_buffer(batch.column(1))):
                for row, keys in trigrams(part, own):
                    spoken = codes[first + row]
                    for code in np.unique(spoken).tolist():
                        add(code, *np.unique(keys[spoken == code], return_counts=True))
                if sum(len(k) for k, _ in sums.values()) > HELD:
                    yield from flush()
        yield from flush()

    rows = docs.filter(quoted(lang).isNotNull()).select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"))
    grams = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return grams


def _most_telling(shares: DataFrame, limit: int) -> DataFrame:
    """Grams of the largest shares, as many as fit ``limit`` by whole steps of a fine logarithmic scale."""
    step = F.floor(F.log2("share") * 64).cast("int")
    sizes = {r.step: r.n for r in shares.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = None, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > limit:
            break
        least = s
    return shares.filter(step >= least) if least is not None else shares.filter(F.lit(False))


class Model:
    """Log-probabilities of trigrams and letters by language, found through one hash table."""

    def __init__(self, languages: list[str], keys: np.ndarray, logs: np.ndarray):
        self.languages, self.keys, self.logs = languages, keys, logs
        size = 1 << max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.mask = size - 1
        self.slot = np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        spot = self._home(keys)
        while len(left):
            free = self.slot[spot] < 0
            self.slot[spot[free]] = left[free]
            lost = self.slot[spot] != left
            left, spot = left[lost], (spot[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        spot, at = self._home(keys), np.arange(len(keys))
        while len(at):
            got = self.slot[spot]
            hit = (got >= 0) & (self.keys[got] == keys[at])
            out[at[hit]] = got[hit]
            on = (got >= 0) & ~hit
            at, spot = at[on], (spot[on] + 1) & self.mask
        return out

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each trigram, of its middle letter where it has none, or -1."""
        out = self.find(keys)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            out[miss] = self.find(-(keys[miss] >> _BITS & _MASK))
        return out


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts over all texts whose language is not null; null texts have no letters.

    A table without any language gives a model that answers ``und``; more than ``MAX_LANGUAGES`` languages raise.
    """
    small_batches(docs)
    grams = counted(docs, lang, text)
    letter = (-F.shiftright("gram", 21).bitwiseAND(F.lit(int(_MASK)))).alias("gram")
    single = grams.groupBy("lang", letter).agg(F.sum("n").alias("n"))
    every = pin(grams.unionByName(single))
    spoken = {r.lang: r.n for r in every.filter("gram < 0").groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(spoken) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(spoken)
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)))
    totals = np.array([spoken[x] for x in names], float)
    size = F.element_at(F.create_map(*[F.lit(v) for x in names for v in (x, float(spoken[x]))]), F.col("lang"))
    shares = every.groupBy("gram").agg(F.max(F.col("n") / size).alias("share"))
    limit = TABLE_CELLS // len(names)
    chosen = _most_telling(shares.filter("gram > 0"), limit).unionByName(_most_telling(shares.filter("gram < 0"), min(limit, LETTER_ROWS)))
    rows = every.join(chosen.select("gram"), "gram").toArrow()
    gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(float)
    place = {x: i for i, x in enumerate(names)}
    keys, back = np.unique(gram, return_inverse=True)
    count = np.zeros((len(keys), len(names)))
    count[back, [place[x] for x in rows.column("lang").to_pylist()]] = n
    # Towards the mean of the languages' own shares, so that a large language does not pull the others.
    pooled = (count / totals).mean(1, keepdims=True)
    return Model(names, keys, np.log((count + PRIOR * pooled) / (totals + PRIOR)))


def _fit(p: np.ndarray, n: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of texts after ``rounds`` of EM from ``share``; rows of ``p`` lie text by text.

    The number of rounds is fixed, so a text's result does not depend on the texts beside it.
    """
    sizes = np.diff(np.append(first, len(p)))
    total = np.add.reduceat(n, first)
    for _ in range(rounds):
        joint = p * np.repeat(share, sizes, axis=0)
        joint *= (n / np.maximum(joint.sum(1), 1e-300))[:, None]
        share = np.add.reduceat(joint, first, axis=0) / total[:, None]
    found = np.log(np.maximum((p * np.repeat(share, sizes, axis=0)).sum(1), 1e-300))
    return share, np.add.reduceat(n * found, first)


def infer(model: Model, rows: np.ndarray, grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the chosen languages of each text and a score; ``rows`` (sorted) number the texts from 0 without gaps.

    ``grams`` are rows of the model's table; the third result is the penalised log-likelihood per chosen set.
    """
    n = n.astype(float)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    logs = model.logs[grams]
    shift = logs.max(1)
    p = np.exp(logs - shift[:, None])
    base = np.add.reduceat(n * shift, first)
    k, texts = len(model.languages), len(first)
    total = np.add.reduceat(n, first)
    each = np.add.reduceat(logs * n[:, None], first, axis=0)
    share, _ = _fit(p, n, first, np.full((texts, k), 1.0 / k), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    # One language: the best by itself, which need not have the largest share; it goes to the front of the ranking.
    top = each.argmax(1)
    rank = np.argsort(np.argsort(order, axis=1), axis=1)
    rank[np.arange(texts), top] = -1
    order = np.argsort(rank, axis=1, kind="stable")
    best = np.zeros((texts, k))
    best[np.arange(texts), top] = 1.0
    score = each.max(1)
    live = np.arange(texts)
    for s in range(2, k + 1):
        # Texts for which the next language has a share worth asking about.
        live = live[share[live, order[live, s - 1]] > SURE]
        if not len(live):
            break
        sizes = np.diff(np.append(first, len(p)))
        at = np.repeat(np.isin(np.arange(texts), live), sizes)
        own = np.searchsorted(rows[at], np.unique(rows[at]))
        allowed = np.zeros((len(live), k))
        np.put_along_axis(allowed, order[live, :s], 1.0, axis=1)
        start = np.maximum(share[live], SURE) * allowed
        got, likely = _fit(p[at], n[at], own, start / start.sum(1, keepdims=True), ROUNDS)
        likely = likely + base[live] - PENALTY * (s - 1) * np.log(np.maximum(total[live], 2.0))
        better = likely > score[live]
        score[live[better]], best[live[better]] = likely[better], got[better]
        live = live[better]
    # How sure the leading language is against each other one alone, as if all were equally common.
    lead = best.argmax(1)
    gap = each - each[np.arange(texts), lead][:, None]
    sure = 1.0 / np.exp(np.minimum(np.maximum(gap, -700.0), 50.0)).sum(1)
    several = (best > 0).sum(1) > 1
    return best, np.where(several, best.max(1), sure), score


def _merged(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def languages(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct ``lang`` (``und`` where the text is null or has no letter), ``score`` and ``mix`` (lang, share, largest first).

    A text with letters gets a language even if the model knows none of its trigrams: the first by name, score
    1 / languages. Without any language every text is ``und`` with score 0.
    """
    small_batches(docs)
    held, token = docs.sparkSession.sparkContext.broadcast((model.languages, model.keys, model.logs)), uuid.uuid4().hex
    kind = "struct<lang:string,score:double,mix:array<struct<lang:string,share:double>>>"
    mixed = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        cache = process_cache("language models")
        if token not in cache:
            cache.clear()
            cache[token] = Model(*held.value)
        own_model: Model = cache[token]
        names, size = own_model.languages, max(1, len(own_model.keys)) + 1
        lang, score, mixes = [], [], []
        # Many languages make wide tables of likelihoods, so fewer texts are taken at a time.
        for row, end, part, own in chunks(*text_buffer(texts), max(1 << 13, CHUNK_BYTES * 8 // max(8, len(names)))):
            parts, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for owner, keys in trigrams(part, own):
                # Unknown trigrams keep a place of their own: the text has letters.
                found = owner * size + own_model.rows(keys) + 1
                got, n = np.unique(found, return_counts=True)
                parts.append(got)
                counts.append(n)
            keys, n = _merged(parts, counts)
            spoken = np.zeros(end - row, bool)
            spoken[keys // size] = True
            known = keys % size > 0
            keys, n = keys[known], n[known]
            out_lang, out_score, out_mix = [UNKNOWN] * (end - row), [0.0] * (end - row), [[]] * (end - row)
            if names:
                for i in np.flatnonzero(spoken).tolist():
                    out_lang[i], out_score[i], out_mix[i] = names[0], 1.0 / len(names), [{"lang": names[0], "share": 1.0}]
                which, rows = np.unique(keys // size, return_inverse=True)
                if len(which):
                    share, sure, _ = infer(own_model, rows, keys % size - 1, n)
                    for i, s, c in zip(which.tolist(), share, sure.tolist(), strict=True):
                        ranked = [j for j in np.argsort(-s, kind="stable").tolist() if s[j] > 0]
                        out_lang[i], out_score[i] = names[ranked[0]], min(1.0, max(0.0, c))
                        out_mix[i] = [{"lang": names[j], "share": float(s[j])} for j in ranked]
            lang += out_lang
            score += out_score
            mixes += out_mix
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, mixed)], ["lang", "score", "mix"])

    # Marked so that the optimiser does not evaluate it once per field.
    return predict.asNondeterministic()(quoted(text))
