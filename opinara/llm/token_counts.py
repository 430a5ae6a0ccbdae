"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Tier one is a broadcast table of the corpus's frequent pre-tokens: 64-bit hash and length, at most ``TABLE_SIZE``
entries of sixteen bytes (a pre-token may have any length). Tier two is the cache of each Python worker, which encodes what it has not seen. The table
only saves work: counts are the library's whatever it holds. It is chosen from counts over all texts: every task
keeps a bounded summary of its pre-tokens and hands on its ``TASK_TOP`` largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.bpe import Encoder, encoder, vocabulary_path
from opinara.llm.buffers import chunks, quoted, small_batches, text_buffer

TABLE_SIZE, TASK_TOP, SUMMARY = 32_768, 4_096, 131_072


def frequent_pretokens(docs: DataFrame, path: str, text: str = "text", top: int = TABLE_SIZE) -> list[str]:
    """The ``top`` pre-tokens with the largest summed task counts, most frequent first (ties by text)."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, lengths_only=True)
        keys, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for _, _, part, own in chunks(data, offsets):
                whole, _, _, starts, ends, hashes, _ = coder.pretokens(part, own)
                new, at, n = np.unique(hashes, return_index=True, return_counts=True)
                spelled = np.array([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], object)
                keys, first, back = np.unique(np.concatenate([keys, new]), return_index=True, return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                words = np.concatenate([words, spelled])[first]
                if len(keys) > 2 * SUMMARY:
                    best = np.sort(np.argpartition(-counts, SUMMARY)[:SUMMARY])
                    keys, counts, words = keys[best], counts[best], words[best]
        best = np.argsort(-counts, kind="stable")[:TASK_TOP]
        yield pa.RecordBatch.from_pydict({"pretoken": pa.array(words[best].tolist(), pa.string()), "n": pa.array(counts[best], pa.int64())})

    rows = docs.select(quoted(text)).mapInArrow(summaries, "pretoken string, n long")
    best = rows.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(top)
    return [r.pretoken for r in best.collect()]


def token_counter(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", top: int = TABLE_SIZE) -> Column:
    """Column with the token count of ``text`` as the library gives it (null text: 0), without added tokens.

    Building the column runs one job over ``docs`` for the table of frequent pre-tokens.
    """
    small_batches(docs)
    path = vocabulary_path(vocabulary)
    words = frequent_pretokens(docs, path, text, top)
    coder = Encoder(path, lengths_only=True)
    data, offsets = text_buffer(pa.array(words, pa.string()))
    sizes = coder.counts(data, offsets)
    hashes = np.zeros(len(words), np.uint64)
    for row, end, part, own in chunks(data, offsets):
        _, _, _, _, _, got, rows = coder.pretokens(part, own)
        single = np.diff(rows) == 1
        hashes[row:end][single] = got[rows[:-1][single]]
    usable = hashes != 0
    hashes, at = np.unique(hashes[usable], return_index=True)
    table = docs.sparkSession.sparkContext.broadcast((hashes, sizes[usable][at]))

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        coder = encoder(path, lengths_only=True)
        coder.known = table.value
        return pa.array(coder.counts(*text_buffer(texts)), pa.int64())

    return tokens(quoted(text))


def with_token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", limit: int = 1024, top: int = TABLE_SIZE) -> DataFrame:
    """Add ``n_bytes`` (UTF-8, null 0), ``n_tokens`` and ``over_limit`` (n_tokens > limit), replacing such columns.

    Empty and null texts have no tokens; an empty table gives an empty result; repeated rows are counted each.
    """
    out = docs.withColumn("n_tokens", token_counter(docs, vocabulary, text, top))
    out = out.withColumn("n_bytes", F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
