"""Byte-level BPE ids of whole texts with a pre-token cache.

The vocabulary's pre-tokenizer splits text into pre-tokens that the merges never cross, so ids of a text are
the ids of its pre-tokens one after another. Pre-tokens are found with array operations, equal ones in a chunk
are looked up once, and only unseen ones go to the ``tokenizers`` library. What counts as a letter, a number or
white space is asked of the library's own pre-tokenizer, a page of code points when one first occurs, so texts in
all scripts go this way. Only texts that hold an added token are given to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from opinara.llm.buffers import U, chunks, expand, process_cache, span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
PAGE = 256


class Classes:
    """Class of each code point as the pre-tokenizer has it, found page by page."""

    def __init__(self, pre_tokenizer):
        self.pre_tokenizer = pre_tokenizer
        self.kind = np.zeros(0x110000, np.uint8)
        self.known = np.zeros(0x110000 // PAGE, bool)

    def _joins(self, mate: str, points: list[int]) -> np.ndarray:
        """Which code points stay together with ``mate`` right before them."""
        # A new line parts the probes: it joins neither letters, numbers nor signs.
        probe = "".join(f"{mate}{chr(c)}\n" for c in points)
        starts = {a for _, (a, _) in self.pre_tokenizer.pre_tokenize_str(probe)}
        return np.array([3 * i + 1 not in starts for i in range(len(points))])

    def of(self, points: np.ndarray) -> np.ndarray:
        seen = self.known[points // PAGE]
        for page in np.unique(points[~seen] // PAGE).tolist():
            own = [c for c in range(page * PAGE, (page + 1) * PAGE) if not 0xD800 <= c < 0xE000]
            found = np.full(len(own), SPACE, np.uint8)
            for mate, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                found[self._joins(mate, own)] = kind
            self.kind[own] = found
            self.known[page] = True
        return self.kind[points]


#: Contractions that the public pre-tokenizer splits off.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary by file name; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_starts(points: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points of texts laid end to end; ``bounds`` are the texts' offsets."""
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    last = first[1:].copy()
    last[-1] = True
    first = first[:-1]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 0, kind[:-1]
    before[first] = 0
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 0, kind[1:]
    after[last] = 0
    space = kind == SPACE
    closes = space & (after != 0) & (after != SPACE)
    start = (kind != before) | closes
    # The last blank of a run belongs to what follows it.
    joined = np.zeros(n, bool)
    joined[1:] = (closes & (points == 32))[:-1]
    start &= ~joined
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        room = np.searchsorted(bounds, quote, side="right")
        end = bounds[np.minimum(room, len(bounds) - 1)]
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        cut = np.zeros(len(quote), np.int64)
        for a, b in LONG:
            cut[(one == ord(a)) & (two == ord(b)) & (quote + 2 < end)] = 2
        cut[np.isin(one, [ord(c) for c in SHORT]) & (quote + 1 < end)] = 1
        hit = quote[cut > 0]
        size = cut[cut > 0]
        start[hit + 1] = False
        start[hit[size == 2] + 2] = False
        after_cut = hit + size + 1
        after_cut = after_cut[after_cut < n]
        # A blank after the contraction keeps its own rules; anything else starts anew.
        start[after_cut] = True
    return np.flatnonzero(start)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes by their first place, these places, and the number of each hash's own; nothing is sorted."""
    back, unique = pd.factorize(hashes)
    at = np.empty(len(unique), np.int64)
    at[back[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return unique, at, back


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary (a ``tokenizers`` JSON file).

    ``known`` gives lengths of pre-tokens by hash (two arrays); with ``lengths_only`` the cache keeps counts
    and no ids. The cache is emptied at ``max_entries``.
    """

    def __init__(self, path: str, lengths_only: bool = False, known: tuple[np.ndarray, np.ndarray] | None = None, max_entries: int = 250_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.classes = Classes(self.tokenizer.pre_tokenizer)
        # How the byte-level step spells each byte: single characters below 0x80, two-byte ones for the rest.
        plain, spelled = ByteLevel(add_prefix_space=False, use_regex=False), {}
        for c in [*range(0x80), *range(0x80, 0x800, 0x20), *range(0x80, 0xC0), 0x1000, 0xFFFD, *range(0x10000, 0x110000, 0x10000), *range(0x800, 0xD800, 0x800), 0xE000, 0xF000]:
            spelled.update(zip(chr(c).encode(), plain.pre_tokenize_str(chr(c))[0][0], strict=True))
        self.spelling = {chr(b): x for b, x in spelled.items()}
        self.spelling = str.maketrans(self.spelling)
        self.lengths_only, self.max_entries = lengths_only, max_entries
        self.known, self.misses = known, 0
        self.reset()

    def reset(self) -> None:
        self.slots: dict[int, int] = {}
        self.length = np.zeros(1024, np.int32)
        self.at = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, hashes: list[int], words: list[str]) -> None:
        tokenize, spelling = self.model.tokenize, self.spelling
        ids = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(spelling))] for w in words]
        self.misses += len(words)
        k, size = len(self.slots), np.fromiter(map(len, ids), np.int64, len(ids))
        while k + len(ids) > len(self.length):
            self.length, self.at = np.concatenate([self.length, self.length * 0]), np.concatenate([self.at, self.at * 0])
        self.length[k : k + len(ids)] = size
        if not self.lengths_only:
            total = int(size.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.at[k : k + len(ids)] = self.used + np.cumsum(size) - size
            self.flat[self.used : self.used + total] = [i for x in ids for i in x]
            self.used += total
        self.slots.update(zip(hashes, range(k, k + len(ids)), strict=True))

    def _slots(self, hashes: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.slots) > self.max_entries:
            self.reset()
        keys = hashes.tolist()
        get = self.slots.get
        found = [get(h, -1) for h in keys]
        missing = [i for i, s in enumerate(found) if s < 0]
        if missing:
            a, b = starts[missing].tolist(), ends[missing].tolist()
            base = len(self.slots)
            self._add([keys[i] for i in missing], [text[x:y] for x, y in zip(a, b, strict=True)])
            for j, i in enumerate(missing):
                found[i] = base + j
        return np.array(found, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pretokens(self, data: np.ndarray, offsets: np.ndarray):
        """Text, odd rows, and of the others: code-point starts, ends, hashes and n + 1 offsets into them by row."""
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(text) == len(data):
            bounds = offsets
        else:
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            bounds = heads[offsets]
        odd = np.zeros(len(offsets) - 1, bool)
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                odd[np.searchsorted(bounds, at, side="right") - 1] = True
                at = text.find(token, at + 1)
        if not len(points):
            return text, bounds, odd, *(np.zeros(0, np.int64),) * 2, np.zeros(0, U), np.zeros(len(offsets), np.int64)
        starts = pretoken_starts(points, bounds, self.classes.of(points))
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(points, starts, ends)
        rows = np.searchsorted(starts, bounds)
        if odd.any():
            keep = np.repeat(~odd, np.diff(rows))
            starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
            rows = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(rows)))])
        return text, bounds, odd, starts, ends, hashes, rows

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        out = [np.zeros(0, np.int64)]
        for _, _, part, own in chunks(data, offsets):
            text, bounds, odd, starts, ends, hashes, rows = self.pretokens(part, own)
            unique, at, back = distinct(hashes)
            size = np.full(len(unique), -1, np.int64)
            if self.known is not None and len(self.known[0]) and len(unique):
                spot = np.minimum(np.searchsorted(self.known[0], unique), len(self.known[0]) - 1)
                hit = self.known[0][spot] == unique
                size[hit] = self.known[1][spot[hit]]
            rest = np.flatnonzero(size < 0)
            if len(rest):
                slots = self._slots(unique[rest], text, starts[at[rest]], ends[at[rest]])
                size[rest] = self.length[slots]
            total = np.concatenate([[0], np.cumsum(size[back])])
            n = total[rows[1:]] - total[rows[:-1]]
            for i in np.flatnonzero(odd):
                n[i] = len(self._whole(text[bounds[i] : bounds[i + 1]]))
            out.append(n)
        return np.concatenate(out)

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None):
        """Chunks of texts as (first row, ids of all texts, n + 1 offsets); ``end_id`` closes each text."""
        for row, _, part, own in chunks(data, offsets):
            text, bounds, odd, starts, ends, hashes, rows = self.pretokens(part, own)
            unique, at, back = distinct(hashes)
            slots = self._slots(unique, text, starts[at], ends[at])[back] if len(unique) else np.zeros(0, np.int64)
            size = self.length[slots].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            flat = self.flat[expand(self.at[slots], size)]
            cuts = total[rows]
            if odd.any() or end_id is not None:
                pieces, close = [], np.array([] if end_id is None else [end_id], np.uint32)
                n = np.diff(cuts)
                for i in range(len(own) - 1):
                    own_ids = np.array(self._whole(text[bounds[i] : bounds[i + 1]]), np.uint32) if odd[i] else flat[cuts[i] : cuts[i + 1]]
                    n[i] = len(own_ids) + len(close)
                    pieces += [own_ids, close]
                flat, cuts = np.concatenate(pieces), np.concatenate([[0], np.cumsum(n)])
            yield row, flat, cuts


def encoder(path: str, **options) -> Encoder:
    """One encoder per worker process and vocabulary, so that its cache outlives a task."""
    key = (path, *sorted(options.items()))
    known = process_cache("encoders")
    if key not in known:
        known[key] = Encoder(path, **options)
    return known[key]
