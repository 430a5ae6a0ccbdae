"""Quality rules: counts of words, symbols, repeats, and tokeniser fertility with bands per language.

Public vocabularies measure each text: characters per token and entropy of its tokens under the byte-level BPE,
and the share of the piece vocabulary's own tokens of the text that are bytes. A text is rejected when a measure
leaves its language's band, which is set by the quartiles of all texts of that language that pass the base rules:
``SPREAD`` interquartile ranges (``LEAST`` at least) beyond them. Characters per token have a band on both sides,
entropy a lower and byte fallback an upper edge, because long clean texts have high entropy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.bpe import encoder, vocabulary_path
from opinara.llm.buffers import U, chunks, fresh, mix, process_cache, quoted, row_of, rows_join, small_batches, span_hashes, spans, text_buffer, window_hashes, word_hashes

MIN_WORDS, REPEAT_PERCENT = 50, 50
SPREAD = 4.0
LEAST = {"chars_per_token": 0.25, "token_entropy": 0.5, "byte_fallback": 0.02}
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = tuple(LEAST)


#: Segments that a worker remembers, by hash.
MAX_SEGMENTS = 1_000_000
_BLANK = np.arange(256) == 32
#: The character that stands for a blank in the piece vocabulary, as UTF-8.
_BLANK_PIECE = b"\xe2\x96\x81"


class Pieces:
    """Pieces of texts under the piece vocabulary, and how many of them are bytes.

    No piece has a blank behind another character, so the pieces of a text are those of its segments, each a run of
    blanks with the characters up to the next blank. Equal segments of a chunk are looked up once, and only unseen
    ones are encoded. The library puts a blank ahead of a text; a segment gives one of its own for that. A text with
    the character that stands for a blank goes to the library whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = frozenset(i for i in range(self.model.get_piece_size()) if self.model.is_byte(i))
        self.known: dict[int, tuple[int, int]] = {}

    def _encoded(self, texts: list[str]) -> list[tuple[int, int]]:
        return [(len(ids), sum(map(self.is_byte.__contains__, ids))) for ids in self.model.encode(texts, num_threads=1)]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row (pieces, bytes) for each text of a chunk."""
        starts, ends, rows = spans(data, offsets, _BLANK)
        body = data.tobytes()
        out = np.zeros((len(offsets) - 1, 2))
        if len(starts):
            before = np.concatenate([[0], ends[:-1]])
            first = rows[:-1][np.diff(rows) > 0]
            # Ahead of its first word a text has the library's blank besides its own.
            before[first] = offsets[:-1][np.diff(rows) > 0] - 1
            lead = starts - before
            keys = mix(span_hashes(data, starts, ends) ^ mix(lead.astype(U)))
            each, at, back = np.unique(keys, return_index=True, return_inverse=True)
            if len(self.known) > MAX_SEGMENTS:
                self.known.clear()
            get = self.known.get
            found = [get(k) for k in each.tolist()]
            new = [i for i, x in enumerate(found) if x is None]
            spelled = [" " * int(lead[at[i]] - 1) + body[starts[at[i]] : ends[at[i]]].decode("utf-8", "replace") for i in new]
            for i, x in zip(new, self._encoded(spelled), strict=True):
                found[i] = self.known[int(each[i])] = x
            summed = np.concatenate([np.zeros((1, 2)), np.cumsum(np.array(found, float)[back], axis=0)])
            out = summed[rows[1:]] - summed[rows[:-1]]
        last = np.where(np.diff(rows) > 0, np.append(ends, 0)[rows[1:] - 1], offsets[:-1])
        for i in np.flatnonzero(offsets[1:] > last).tolist():
            # Blanks at the end of a text, or nothing else in it.
            blanks = " " * int(offsets[i + 1] - last[i])
            if rows[i + 1] > rows[i]:
                (n, b), (m, c) = self._encoded(["a" + blanks, "a"])
                out[i] += n - m, b - c
            else:
                out[i] = self._encoded([blanks])[0]
        place = body.find(_BLANK_PIECE)
        while place >= 0:
            i = int(np.searchsorted(offsets, place, side="right")) - 1
            out[i] = self._encoded([body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")])[0]
            place = body.find(_BLANK_PIECE, int(offsets[i + 1]))
        return out


def byte_pieces(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each whole text of a chunk under the piece vocabulary, and how many of them are bytes."""
    cache = process_cache("pieces")
    if path not in cache:
        cache[path] = Pieces(path)
    found = cache[path].counts(data, offsets)
    return found[:, 0], found[:, 1]


def measure_chunk(data: np.ndarray, offsets: np.ndarray, bpe: str, piece: str) -> dict[str, np.ndarray]:
    """Counts and measures of each text of a chunk."""
    n_rows = len(offsets) - 1
    starts, ends, rows = spans(data, offsets)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    summed = lambda values, bounds: np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])
    out = {"n_words": np.diff(rows), "word_chars": summed(heads[ends] - heads[starts], rows), "n_symbols": summed(SYMBOL[data], offsets)}
    salt = mix(np.arange(1, n_rows + 1).astype(U))

    breaks = np.flatnonzero(data == 10)
    lines = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(breaks, offsets)))])
    line_start, line_end = np.zeros(lines[-1], np.int64), np.zeros(lines[-1], np.int64)
    inner = np.ones(lines[-1], bool)
    inner[lines[:-1]] = False
    line_start[lines[:-1]], line_start[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[lines[1:] - 1] = False
    line_end[lines[1:] - 1], line_end[inner] = offsets[1:], breaks
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row = row_of(lines)[worded]
    keys = span_hashes(data, line_start[worded], line_end[worded]) ^ salt[line_row]
    first = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n_rows) - np.bincount(line_row[first], minlength=n_rows)

    words = word_hashes(data, starts, ends)
    word_row = row_of(rows)
    grams = window_hashes(words, 3)
    at = np.flatnonzero(word_row[: len(grams)] == word_row[2 : len(grams) + 2])
    _, back, count = np.unique(grams[at] ^ salt[word_row[at]], return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = summed(covered[: len(words)], rows)

    n_tokens, entropy = np.zeros(n_rows), np.zeros(n_rows)
    for row, flat, cuts in encoder(bpe).ids(data, offsets):
        part = slice(row, row + len(cuts) - 1)
        n = np.diff(cuts)
        pairs, count = np.unique(row_of(cuts) << 32 | flat.astype(np.int64), return_counts=True)
        weight = np.bincount(pairs >> 32, count * np.log2(count), len(n))
        n_tokens[part] = n
        entropy[part] = np.log2(np.maximum(n, 1)) - weight / np.maximum(n, 1)
    n_pieces, spelled = byte_pieces(piece, data, offsets)
    out["chars_per_token"] = np.diff(heads[offsets]) / np.maximum(n_tokens, 1)
    out["token_entropy"] = np.maximum(entropy, 0.0)
    out["byte_fallback"] = spelled / np.maximum(n_pieces, 1)
    return out


def measures(docs: DataFrame, text: str = "text", bpe: str = "byte_bpe_50k.json", piece: str = "piece_bpe_32k.model", column: str = "quality") -> DataFrame:
    """Add a struct ``column`` with the counts and measures of each whole text (null text: no words, all 0)."""
    bpe, piece = vocabulary_path(bpe), vocabulary_path(piece)
    kind = "struct<" + ",".join([f"{c}:bigint" for c in COUNTS] + [f"{c}:double" for c in MEASURES]) + ">"

    @F.arrow_udf(kind)
    def quality(texts: pa.Array) -> pa.Array:
        parts = [measure_chunk(part, own, bpe, piece) for _, _, part, own in chunks(*text_buffer(texts))]
        whole = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in (*COUNTS, *MEASURES)}
        return pa.StructArray.from_arrays([pa.array(whole[c], pa.int64()) for c in COUNTS] + [pa.array(whole[c], pa.float64()) for c in MEASURES], [*COUNTS, *MEASURES])

    # Marked so that filters on its fields do not make the optimiser evaluate it again.
    return small_batches(docs).withColumn(column, quality.asNondeterministic()(quoted(text)))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"])


def bands(measured: DataFrame, lang: str = "lang", column: str = "quality") -> DataFrame:
    """Edges of each measure by language (null is a language), from all texts that pass the base rules."""
    q = F.col(column)
    passed = measured.filter(~base_failed(q)).groupBy(quoted(lang))
    stats = passed.agg(*[F.percentile_approx(q[m], [0.25, 0.75]).alias(m) for m in MEASURES])
    edges = [quoted(lang)]
    for m in MEASURES:
        width = SPREAD * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(LEAST[m]))
        edges += [(F.col(m)[0] - width).alias(f"{m}_low"), (F.col(m)[1] + width).alias(f"{m}_high")]
    return stats.select(*edges)


def judged(measured: DataFrame, edges: DataFrame, lang: str = "lang", column: str = "quality", kept: str = "kept", failed: str = "base_failed") -> DataFrame:
    """Add ``base_failed`` and ``kept``. A language without a band (no text of it passes the base) keeps nothing."""
    q = F.col(column)
    names = {f"{m}_{e}": fresh(measured, f"{m}_{e}") for m in MEASURES for e in ("low", "high")}
    near = rows_join(measured, edges.withColumnsRenamed({c: n for c, n in names.items() if c != n}), [lang], "left")
    edge = {c: quoted(n) for c, n in names.items()}
    inside = q["chars_per_token"].between(edge["chars_per_token_low"], edge["chars_per_token_high"])
    inside &= (q["token_entropy"] >= edge["token_entropy_low"]) & (q["byte_fallback"] <= edge["byte_fallback_high"])
    out = near.withColumn(failed, base_failed(q)).withColumn(kept, ~base_failed(q) & F.coalesce(inside, F.lit(False)))
    return out.drop(*names.values())


def quality_filter(docs: DataFrame, store: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """Documents that pass, with the columns of ``docs``.

    Texts are measured twice, once for the bands and once to judge, so that no text is shuffled; the bands are
    written below ``store``, a folder that executors share. An empty table stays empty.
    """
    column, kept, failed, key = (fresh(docs, c) for c in ("quality_of_text", "kept_by_rules", "failed_base", "lang_of_text"))
    measured = measures(docs.withColumn(key, quoted(lang)), text, column=column)
    bands(measured.select(key, column), key, column).write.mode("overwrite").parquet(store)
    edges = docs.sparkSession.read.parquet(store)
    return judged(measured, edges, key, column, kept, failed).filter(quoted(kept)).select(*[quoted(c) for c in docs.columns])

