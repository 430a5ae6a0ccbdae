"""Rule-based opinion extraction from text, without Python workers.

Seeds are found by one alternation, longest first, so a longer seed wins and a
span belongs to one dimension. Degree and negation words count when they stand
within three characters before the hit; a few weak words may follow it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, MASK = "\u0001", "\u0002", "\u0003"
WINDOW = 3


@dataclass(frozen=True)
class Seed:
    text: str
    dimension: str
    polarity: int
    excluded: bool = False


@dataclass(frozen=True)
class Rules:
    """Seeds plus the modifier words around them."""

    seeds: Sequence[Seed]
    degrees: Mapping[str, float]
    degrees_after: Mapping[str, float] = field(default_factory=dict)
    negations: Sequence[str] = ()
    negation_exceptions: Sequence[str] = ()

    def by_text(self) -> dict[str, Seed]:
        """One meaning per seed text: exclusions first, then the order given."""
        out: dict[str, Seed] = {}
        for s in sorted(self.seeds, key=lambda s: not s.excluded):
            out.setdefault(s.text, s)
        return out

    def pattern(self) -> str:
        texts = sorted(self.by_text(), key=lambda t: (-len(t), t))
        return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in texts)

    def reach_after(self) -> int:
        return WINDOW - 1 + max((len(w) for w in self.degrees_after), default=1)


def _lookup(seeds: Mapping[str, Seed], span: Column, attr: str) -> Column:
    pairs = [F.lit(x) for t, s in seeds.items() for x in (t, getattr(s, attr))]
    return F.element_at(F.create_map(*pairs), span)


def _strongest(candidates: Iterable[tuple[str, float, Column]]) -> Column:
    """Strongest word present; ties go to the longer word, then to the larger text.

    Tested from strongest to weakest, so the first hit decides.
    """
    ordered = sorted(candidates, key=lambda c: (c[1], len(c[0]), c[0]), reverse=True)
    if not ordered:
        return F.lit("")
    chain = F.when(ordered[0][2], F.lit(ordered[0][0]))
    for word, _, hit in ordered[1:]:
        chain = chain.when(hit, F.lit(word))
    return chain.otherwise("")


def hits(df: DataFrame, text: str, rules: Rules, keep: Sequence[str]) -> DataFrame:
    """One row per seed occurrence: keep columns, ``match_id``, ``span``, ``before``, ``after``."""
    clean = F.col(text)
    for mark in (OPEN, CLOSE, MASK):
        clean = F.replace(clean, F.lit(mark), F.lit(" "))
    marked = F.regexp_replace(clean, f"({rules.pattern()})", f"{OPEN}$1{CLOSE}")
    pieces = df.select(*keep, F.split(marked, OPEN).alias("_p"))
    reach = rules.reach_after()

    def plain(x: Column) -> Column:
        return F.replace(x, F.lit(CLOSE), F.lit(""))

    def piece(i: Column) -> Column:
        return F.coalesce(F.get(F.col("_p"), i), F.lit(""))

    def one(this: Column, before_this: Column) -> Column:
        i = before_this + 1
        # Mostly the neighbouring piece covers a window. If not, every piece after
        # the first holds at least one character, so WINDOW pieces back and
        # ``reach`` pieces ahead always do.
        last = F.right(plain(F.right(piece(i - 1), F.lit(WINDOW + 1))), F.lit(WINDOW))
        back = plain(F.concat(*[piece(i - d) for d in range(WINDOW, 0, -1)]))
        tail = F.substring_index(this, CLOSE, -1)
        ahead = plain(F.concat(tail, *[piece(i + d) for d in range(1, reach + 1)]))
        return F.struct(
            F.substring_index(this, CLOSE, 1).alias("span"),
            F.when(F.length(last) == WINDOW, last).otherwise(F.right(back, F.lit(WINDOW))).alias("before"),
            F.left(F.when(F.length(tail) >= reach, tail).otherwise(ahead), F.lit(reach)).alias("after"),
        )

    # The first piece precedes every hit; a null text gives no rows.
    found = F.transform(F.slice("_p", F.lit(2), F.size("_p")), one)
    # The outer form keeps the optimiser from testing the array's size first, which would search twice.
    rows = pieces.select(*keep, F.posexplode_outer(found).alias("match_id", "_h")).filter(F.col("match_id").isNotNull())
    return rows.select(*keep, "match_id", "_h.*")


def lexicon_extract(df: DataFrame, text: str, rules: Rules, keep: Sequence[str]) -> DataFrame:
    """Matches (keep.., match_id, dimension, span, polarity, degree_word, negated).

    ``match_id`` counts seed occurrences within the text, excluded ones included,
    so it also gives their order.
    """
    seeds = rules.by_text()
    found = hits(df, text, rules, keep)
    wanted = found.filter(~_lookup(seeds, F.col("span"), "excluded"))
    before, after = F.col("before"), F.col("after")
    masked = F.concat(before, F.col("span"))
    for phrase in rules.negation_exceptions:
        masked = F.replace(masked, F.lit(phrase), F.lit(MASK * len(phrase)))
    context = F.left(masked, F.length(before))
    negated = F.lit(False)
    for word in rules.negations:
        negated = negated | F.contains(context, F.lit(word))
    degree = _strongest(
        [(w, v, F.contains(before, F.lit(w))) for w, v in rules.degrees.items()]
        + [
            (w, v, F.contains(F.left(after, F.lit(WINDOW - 1 + len(w))), F.lit(w)))
            for w, v in rules.degrees_after.items()
        ]
    )
    return wanted.select(
        *keep,
        "match_id",
        _lookup(seeds, F.col("span"), "dimension").alias("dimension"),
        "span",
        _lookup(seeds, F.col("span"), "polarity").alias("polarity"),
        degree.alias("degree_word"),
        negated.alias("negated"),
    )


def lexicon_polarity(df: DataFrame, text: str, phrases: Sequence[Seed], rules: Rules, keep: Sequence[str]) -> DataFrame:
    """Functional matches: phrases carry the user's final attitude, so polarity is used as given.

    An approximation: attitude that only the sentence's meaning shows is out of reach of phrases.
    """
    return lexicon_extract(
        df, text, Rules(phrases, rules.degrees, rules.degrees_after, rules.negations, rules.negation_exceptions), keep
    )


def score_texts(df: DataFrame, scorer, schema: str) -> DataFrame:
    """Hook for a caller's own model: ``scorer`` maps Arrow-batched pandas frames to result frames."""

    def run(batches):
        for pdf in batches:
            yield scorer(pdf)

    return df.mapInPandas(run, schema)
