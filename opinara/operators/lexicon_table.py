"""Rule-based extraction from lexicon tables of any size.

Seeds, degree words, negations and their exceptions are DataFrames, as the readers of ``sources`` give them. One pass over
the texts of a batch finds all occurrences of all seeds (:class:`Words`), and of those that overlap the
leftmost stays, of those that start together the longest. Meaning of the windows around a hit is that of
:mod:`.lexicon`; words in them are looked up by hash or once per distinct window, so tables of modifiers may be large too.

Seeds are broadcast, after a check of their size. Beyond ``SHARD_CHARACTERS`` they are cut into shards of that
size, each with a scan of its own; the occurrences of a text then meet again by its row, to settle overlaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin
from .lexicon import MASK, WINDOW

#: Characters of seeds in one scan (13 to 20 bytes each in a worker's memory), and of all modifier words together.
SHARD_CHARACTERS, MODIFIER_CHARACTERS = 12_000_000, 4_000_000

SEEDS = "seed string, dimension string, polarity int, excluded boolean"
SEED_FIELDS = ["seed", "dimension", "polarity", "excluded"]
_MATCH = "match_id int, dimension string, span string, polarity int, degree_word string, negated boolean"
MATCH_FIELDS = ["match_id", "dimension", "span", "polarity", "degree_word", "negated"]

#: Characters, or hits, of texts that a task works on at once; rows that pass to Python together; places hashed together.
HELD, BATCH, BLOCK = 1 << 20, 500, 1 << 16

#: Stands between texts; no code point is as large. Three code points make a key of 63 bits.
GAP, POINT_BITS = 0x1FFFFF, 21

#: Windows whose meaning a worker keeps; runs of overlaps from which numpy is not worth its calls.
KEPT_WINDOWS, FEW = 1 << 16, 32


def one_meaning(seeds: DataFrame) -> DataFrame:
    """One row per seed text: exclusions first, then the smallest dimension, then the larger polarity. Null and empty seeds go."""
    rows = seeds.filter("seed IS NOT NULL AND seed <> ''")
    best = F.min(F.struct((~F.coalesce("excluded", F.lit(False))).alias("wanted"), "dimension", (-F.col("polarity")).alias("against")))
    return rows.groupBy("seed").agg(best.alias("m")).select("seed", "m.dimension", (-F.col("m.against")).cast("int").alias("polarity"), (~F.col("m.wanted")).alias("excluded"))


def seed_shards(seeds: DataFrame) -> list[pa.Table]:
    """Seeds as tables of at most about ``SHARD_CHARACTERS``, dealt by hash; one small job counts them."""
    kept = pin(one_meaning(seeds))
    total = kept.agg(F.sum(F.length("seed"))).first()[0] or 0
    n = max(1, -(-int(total) // SHARD_CHARACTERS))
    shard = F.pmod(F.xxhash64("seed"), F.lit(n))
    return [kept.filter(shard == i).toArrow().combine_chunks() for i in range(n)]


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Words:
    """Finds words by hashes of their prefixes, one length after another, at many places at once.

    A place goes on to the next length while some longer word may begin as it does. A hash only proposes a word:
    its characters are compared. Words are distinct and not empty.
    """

    def __init__(self, words: pa.Array):
        self.sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
        self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.points = np.concatenate([np.zeros(0, np.uint32), *[_points("".join(words[a : a + BLOCK].to_pylist())) for a in range(0, len(words), BLOCK)]])
        self.longest = int(self.sizes.max(initial=0))
        # Between lengths far apart prefixes are looked up too.
        self.levels = sorted({*np.unique(self.sizes).tolist(), *range(8, self.longest, 8)})
        for attempt in range(16):
            if self._built(np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * attempt & (1 << 64) - 1)):
                return
        raise ValueError("words repeat")

    def _built(self, factor: np.uint64) -> bool:
        """Tables for one factor of the hash; False where two words share a hash."""
        self.factor = factor
        self.hashes = np.full(len(self.sizes), factor)
        flags, self.slots = self._room(2 * int(np.searchsorted(self.levels, self.sizes, side="right").sum())), self._room(2 * len(self.sizes))
        self.flag_shift, self.slot_shift = (np.uint64(65 - n.bit_length()) for n in (flags, self.slots))
        ends, goes_on = np.zeros(flags, bool), np.zeros(flags, bool)
        left, done = np.arange(len(self.sizes)), 0
        for level in self.levels:
            hashes = self.hashes[left]
            for k in range(done, level):
                hashes = (hashes + self.points[self.begins[left] + k]) * factor
            done, self.hashes[left], place = level, hashes, hashes >> self.flag_shift
            over = self.sizes[left] == level
            ends[place[over]], goes_on[place[~over]] = True, True
            left = left[~over]
        self.flags = ends | goes_on.view(np.uint8) << 1
        if len(np.unique(self.hashes)) < len(self.hashes):
            return False
        self.table = np.full(self.slots, -1, np.int32)
        left, place = np.arange(len(self.sizes), dtype=np.int32), (self.hashes >> self.slot_shift).astype(np.int64)
        while len(left):
            free = self.table[place] < 0
            self.table[place[free]] = left[free]
            stay = self.table[place] != left
            left, place = left[stay], (place[stay] + 1) & (self.slots - 1)
        return True

    @staticmethod
    def _room(n: int) -> int:
        """A power of two, ``n`` at least, but no more than 2^25."""
        return 1 << min(25, max(8, (n - 1).bit_length()))

    def _of(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, -1 where there is none."""
        place = (hashes >> self.slot_shift).astype(np.int64)
        out = self.table[place]
        at = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        place = place[at]
        while len(at):
            place = (place + 1) & (self.slots - 1)
            out[at] = word = self.table[place]
            on = (word >= 0) & (self.hashes[word] != hashes[at])
            at, place = at[on], place[on]
        return out

    def same(self, points: np.ndarray, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether the characters of the words stand at the places."""
        out, sizes = np.ones(len(places), bool), self.sizes[words]
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            text, own, same = places[at], self.begins[words[at]], np.ones(len(at), bool)
            for k in range(size):
                same &= points[text + k] == self.points[own + k]
            out[at] = same
        return out

    def found(self, points: np.ndarray, places: np.ndarray, exact: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (by their number) and words that begin there, by length; ``points`` go on for ``longest`` after each place.

        Without ``exact`` words are told by their hashes alone, and the caller compares characters.
        """
        which, done = np.arange(len(places)), 0
        hashes = np.full(len(places), self.factor)
        dense = len(places) and places[-1] - places[0] == len(places) - 1
        for level in self.levels:
            for k in range(done, level):
                # Until some places are out, those of a block are neighbours.
                hashes += points[places[0] + k : places[0] + k + len(places)] if dense else points[places + k]
                hashes *= self.factor
            done, flags = level, self.flags[hashes >> self.flag_shift]
            at = np.flatnonzero(flags & 1)
            words = self._of(hashes[at])
            at, words = at[words >= 0], words[words >= 0]
            if exact:
                same = self.same(points, places[at], words)
                at, words = at[same], words[same]
            yield which[at], words
            on = np.flatnonzero(flags & 2)
            if not len(on):
                return
            if len(on) < len(places):
                places, hashes, which, dense = places[on], hashes[on], which[on], False


def settled(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of occurrences in order of their start, no two with the same, those that stay: the first start wins."""
    if not len(starts):
        return np.zeros(0, np.int64)
    # The first that begins where another ends, or later.
    follows = np.cumsum(np.bincount(starts, minlength=int(ends.max())))[ends - 1]
    stay = np.zeros(len(starts), bool)
    # What overlaps nothing before it stays, and begins a run of its own; the runs go on side by side.
    at = np.flatnonzero(np.append(True, starts[1:] >= np.maximum.accumulate(ends)[:-1]))
    until = np.append(at[1:], len(starts))
    while len(at) > FEW:
        stay[at] = True
        at = follows[at]
        at, until = at[at < until], until[at < until]
    follow, mark = memoryview(follows), memoryview(stay)
    for i, last in zip(at.tolist(), until.tolist()):
        while i < last:
            mark[i] = True
            i = follow[i]
    return np.flatnonzero(stay)


class Texts:
    """Code points of texts with gaps around each; windows of ``WINDOW`` never reach a neighbour."""

    def __init__(self, texts: pa.Array, room: int):
        bodies = [t or "" for t in texts.to_pylist()]
        self.sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.begins = np.cumsum(self.sizes + WINDOW) - self.sizes
        gap = "\0" * WINDOW
        self.points = np.frombuffer(bytearray(gap.join(["", *bodies, "\0" * room]).encode("utf-32-le")), np.uint32)
        for k in range(WINDOW):
            self.points[self.begins - 1 - k] = GAP
        self.end = int(self.begins[-1] + self.sizes[-1]) if bodies else 0
        self.points[self.end :] = GAP

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the texts in which places lie."""
        return np.searchsorted(self.begins, places, side="right") - 1

    def longest(self, words: Words, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Start and word of every occurrence that is the longest at its start."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for low in range(0, self.end, BLOCK):
            places = np.arange(low, min(low + BLOCK, self.end))
            best = np.full(len(places), -1, np.int32)
            for at, number in words.found(self.points, places, exact):
                best[at] = number
            at = np.flatnonzero(best >= 0)
            starts.append(at + low)
            found.append(best[at])
        return np.concatenate(starts), np.concatenate(found)


    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Start and word of the occurrences that stay."""
        for exact in (False, True):
            starts, number = self.longest(words, exact)
            stay = settled(starts, starts + words.sizes[number])
            starts, number = starts[stay], number[stay]
            # What does not stay had no part in it, so characters of the others are compared only if a hash deceived.
            if exact or words.same(self.points, starts, number).all():
                break
        return starts, number


_BUILT: dict[str, tuple] = {}


def _words_of(token: str, shard: pa.Table) -> tuple[Words, list[pa.Array]]:
    """The seeds of a shard, ready to be found, and their columns, built once per worker process."""
    if token not in _BUILT:
        _BUILT.clear()
        columns = [_column(shard, name) for name in SEED_FIELDS]
        _BUILT[token] = Words(columns[0]), columns
    return _BUILT[token]


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose lengths add up to about ``HELD``, so that few hits at a time are held."""
    at, ends = 0, np.cumsum(lengths)
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right")))
        yield at, stop
        at = stop


def _lengths(lists: pa.Array) -> np.ndarray:
    """Lengths of lists, 0 for null ones; ``flatten`` leaves those out too."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _substrings(text: str, longest: int) -> set[str]:
    return {text[a:b] for a in range(len(text)) for b in range(a + 1, min(len(text), a + longest) + 1)}


class Modifiers:
    """Degree words before and after a hit, negations, and phrases that only look like negation."""

    def __init__(self, before: dict[str, float], after: dict[str, float], negations: set[str], exceptions: list[str]):
        # Strongest last; ties go to the longer word, then to the larger text. Words without a weight are weakest.
        known = lambda w: w is not None and w == w
        meanings = sorted({(known(v), v if known(v) else 0.0, len(w), w) for t in (before, after) for w, v in t.items()})
        ranks = {m: i + 1 for i, m in enumerate(meanings)}
        rank = lambda t: {w: ranks[known(v), v if known(v) else 0.0, len(w), w] for w, v in t.items()}
        self.degrees, self.before, self.after = ["", *(m[3] for m in meanings)], rank(before), rank(after)
        self.negations = negations
        self.exceptions = {p: i for i, p in enumerate(exceptions)}
        self.longest = max(map(len, exceptions), default=0)
        self.reach = max(map(len, after), default=0)
        #: Beginnings of phrases, as far as they can reach out of a window.
        self.begun = {p[:n] for p in exceptions for n in range(1, WINDOW + 1)}
        #: Characters of the span on which negation can rest; a word that holds the mask may rest on all.
        self.plain = not any(MASK in w for w in (*negations, *exceptions))
        self.depth = sum(len(p) - 1 for p in exceptions)
        # Made by each worker.
        self.windows: dict[int, tuple[int, int]] = {}
        self.words, self.ranks = None, None

    def negated(self, before: str, span: str) -> bool:
        masked = before + span
        for phrase in sorted(_substrings(masked, self.longest) & self.exceptions.keys(), key=self.exceptions.get):
            masked = masked.replace(phrase, MASK * len(phrase))
        return bool(_substrings(masked[: len(before)], WINDOW) & self.negations)

    @staticmethod
    def text(window: int) -> str:
        """The characters before a hit from their key."""
        points = (window >> POINT_BITS * k & GAP for k in range(WINDOW))
        return "".join(chr(p) for p in points if p != GAP)

    def before_hit(self, window: int) -> tuple[int, int]:
        """Rank of the strongest degree word in the window; negation: 0 no, 1 yes, 2 depends on the span."""
        if window not in self.windows:
            if len(self.windows) >= KEPT_WINDOWS:
                self.windows.clear()
            text = self.text(window)
            parts = _substrings(text, WINDOW)
            negation = int(bool(parts & self.negations))
            if not self.plain or negation and (parts & self.exceptions.keys() or any(text[a:] in self.begun for a in range(len(text)))):
                negation = 2
            self.windows[window] = max((self.before[w] for w in parts & self.before.keys()), default=0), negation
        return self.windows[window]

    def around(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Degree word and negation of hits."""
        if self.words is None:
            self.words = Words(pa.array(list(self.after), pa.string()))
            self.ranks = np.fromiter(self.after.values(), np.int64, len(self.after))
        key = np.zeros(len(starts), np.int64)
        for k in range(WINDOW):
            key |= points[starts - WINDOW + k].astype(np.int64) << POINT_BITS * k
        coded = pa.array(key).dictionary_encode()
        which = coded.indices.to_numpy()
        windows = coded.dictionary.to_pylist()
        facts = np.array([self.before_hit(w) for w in windows], np.int64).reshape(-1, 2)
        rank, negated = facts[which, 0], facts[which, 1]
        # A word counts if it ends within WINDOW - 1 characters and its own length after the hit.
        for a in range(WINDOW):
            for at, word in self.words.found(points, ends + a):
                rank[at] = np.maximum(rank[at], self.ranks[word])
        unclear = np.flatnonzero(negated == 2)
        if len(unclear):
            rest = spans.take(pa.array(unclear))
            rest = (pc.utf8_slice_codeunits(rest, 0, self.depth) if self.plain else rest).dictionary_encode()
            texts = rest.dictionary.to_pylist()
            pairs = pa.array(which[unclear].astype(np.int64) * len(texts) + rest.indices.to_numpy()).dictionary_encode()
            said = [self.negated(self.text(windows[p // len(texts)]), texts[p % len(texts)]) for p in pairs.dictionary.to_pylist()]
            negated[unclear] = np.array(said)[pairs.indices.to_numpy()]
        return pa.array(self.degrees, pa.string()).take(pa.array(rank)), pa.array(negated > 0)


def _words(table: DataFrame | None, *columns: str) -> list:
    if table is None:
        return []
    rows = table.select(*columns).filter(f"{columns[0]} IS NOT NULL AND {columns[0]} <> ''").distinct()
    size = rows.agg(F.sum(F.length(columns[0]))).first()[0] or 0
    if size > MODIFIER_CHARACTERS:
        raise ValueError(f"modifier words of more than {MODIFIER_CHARACTERS} characters")
    return [tuple(r) for r in rows.orderBy(*columns).collect()]


def _matches(rows: list[pa.Array], texts: Texts, starts: np.ndarray, number: np.ndarray, columns: list[pa.Array], sizes: np.ndarray, modifiers: Modifiers) -> pa.RecordBatch:
    """``rows`` and the columns of ``_MATCH`` for each hit that is wanted.

    ``number`` has the place of each hit in ``columns`` (seed, dimension, polarity, excluded) and ``sizes``;
    hits are in order of their start and do not overlap.
    """
    owner = texts.owner(starts)
    first = np.searchsorted(owner, np.arange(len(texts.sizes)))
    ids = (np.arange(len(owner)) - first[owner]).astype(np.int32)
    excluded = columns[3].take(pa.array(number)).to_numpy(zero_copy_only=False).astype(bool)
    starts, number, owner, ids = (x[~excluded] for x in (starts, number, owner, ids))
    row, number_ = pa.array(owner), pa.array(number)
    span, dimension, polarity = (c.take(number_) for c in columns[:3])
    degree, negated = modifiers.around(texts.points, starts, starts + sizes[number], span)
    return _batch([c.take(row) for c in rows], [pa.array(ids), dimension, span, polarity, degree, negated])


def _scans(batches: Iterable[pa.RecordBatch], room: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows a few at a time, with the code points of their column ``text``."""
    for batch in batches:
        # A text has hardly more hits than characters.
        for low, high in _slices(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)):
            part = batch.slice(low, high - low)
            yield part, Texts(part.column("text"), room)


def _batch(rows: list[pa.Array], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows, *columns], [*[f"k{i}" for i in range(len(rows))], *MATCH_FIELDS])


def _single(held, token: str, modifiers, keep: int) -> Callable:
    """Matches where one scan finds all seeds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, columns = _words_of(token, held.value)
        for batch, texts in _scans(batches, max(words.longest, WINDOW + modifiers.value.reach)):
            starts, number = texts.hits(words)
            yield _matches(batch.columns[:keep], texts, starts, number, columns, words.sizes, modifiers.value)

    return run


def _scan(held, token: str) -> Callable:
    """Occurrences of the seeds of one shard, the longest at each start, with the row of their text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, columns = _words_of(token, held.value)
        for batch, texts in _scans(batches, words.longest):
            starts, number = texts.longest(words)
            owner = texts.owner(starts)
            own = [batch.column("row").take(pa.array(owner)), pa.array((starts - texts.begins[owner]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*own, *[c.take(pa.array(number)) for c in columns]], ["row", "start", *SEED_FIELDS])

    return run


def _settle(modifiers, keep: int) -> Callable:
    """Matches from the occurrences ``all`` of all shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _scans(batches, WINDOW + modifiers.value.reach):
            found = batch.column("all")
            values = found.flatten()
            starts = values.field("start").to_numpy(zero_copy_only=False) + np.repeat(texts.begins, _lengths(found))
            columns = [values.field(name) for name in SEED_FIELDS]
            sizes = pc.utf8_length(columns[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            number = np.lexsort((sizes, starts))
            number = number[np.append(np.diff(starts[number]) > 0, True)] if len(number) else number
            stay = settled(starts[number], starts[number] + sizes[number])
            yield _matches(batch.columns[:keep], texts, starts[number[stay]], number[stay], columns, sizes, modifiers.value)

    return run


def extract_from_tables(
    df: DataFrame,
    text: str,
    seeds: DataFrame,
    keep: Sequence[str],
    degrees: DataFrame | None = None,
    degrees_after: DataFrame | None = None,
    negations: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Matches ``keep.., match_id, dimension, span, polarity, degree_word, negated`` of every text.

    ``seeds``: seed, dimension, polarity, excluded (see :func:`one_meaning` for repeats). ``degrees`` and
    ``degrees_after``: word, weight. ``negations`` and ``exceptions``: word; exceptions apply longest first, then by text.
    ``match_id`` counts occurrences within the text, excluded ones included. Null and empty texts and texts without
    a seed give no rows; repeated rows give their matches each.
    """
    # Rows come in order of word and weight, so the larger weight of a repeated word stays.
    weights = [dict(_words(table, "word", "weight")) for table in (degrees, degrees_after)]
    phrases = sorted((w for (w,) in _words(exceptions, "word")), key=lambda w: (-len(w), w))
    spark = df.sparkSession
    modifiers = spark.sparkContext.broadcast(Modifiers(weights[0], weights[1], {w for (w,) in _words(negations, "word")}, phrases))
    # A text may have thousands of hits: few texts pass to Python together.
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    shards = [(spark.sparkContext.broadcast(shard), uuid.uuid4().hex) for shard in seed_shards(seeds)]
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(_MATCH).fields])
    if len(shards) == 1:
        found = rows.mapInArrow(_single(*shards[0], modifiers, len(keep)), schema)
    else:
        rows = pin(rows.withColumn("row", F.monotonically_increasing_id()))
        parts = [rows.select("row", "text").mapInArrow(_scan(*shard), f"row long, start int, {SEEDS}") for shard in shards]
        # Overlaps are settled per text; a text has at most as many occurrences in a shard as characters.
        hits = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.collect_list(F.struct("start", *SEED_FIELDS)).alias("all"))
        found = rows.join(hits, "row").select(*[f"k{i}" for i in range(len(keep))], "text", "all").mapInArrow(_settle(modifiers, len(keep)), schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MATCH_FIELDS)
