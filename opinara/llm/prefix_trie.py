"""Prefix trie of conversations by fixed-length block hashing.

Each turn becomes a 128-bit digest of its role and text; texts go no further. A conversation is cut into blocks of
``BLOCK`` turns. Every turn's digest is mixed with its place to two 64-bit lanes, and the lanes of all turns so far,
added up bit by bit without carry, name a prefix; so the name of a block is the name of the prefix that it ends.
Conversations are grouped by the names of their successive blocks first. Inside a block that has no sibling all
turns lead the same conversations on, and its nodes follow from the block's row. Only where blocks under one parent
differ are they opened: each distinct block (not each conversation) gives one row per turn, grouped by prefix.

Sums over subtrees need no walk. A conversation *owns* the nodes of which it is the smallest member: these are the
lower end of its path. So a sum over the nodes below v is a sum over the members of v of what they own, without
the part of v's smallest member above v; the second grouping by blocks carries these sums like the first the counts.

All of it is joins and aggregates. The place of a turn comes from a range-partitioned sort, so one conversation may
span partitions; prefixes within a conversation are added in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinara.llm.buffers import quoted
from opinara.session import pin

#: Turns of a block; blocks whose prefixes are added up in one window; bytes of ids written into one row.
BLOCK, RUN, ID_BYTES = 4, 256, 1 << 16

KEY = ["depth", "x", "y"]
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns ``(c, p, d, len)`` and conversations ``(c, n)``: place from 1, digest, code points; number of turns.

    Null turns come first; turns of equal number are ordered by digest, so equal rows count each. Rows without a
    conversation id are left out; null role and text are empty. Both tables rest on one written copy.
    """
    said, body = F.coalesce(quoted(role).cast("string"), F.lit("")), F.coalesce(quoted(text).cast("string"), F.lit(""))
    framed = F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, body)
    rows = conversations.filter(quoted(conv).isNotNull()).select(
        quoted(conv).cast("long").alias("c"),
        quoted(turn).alias("t"),
        F.substring(F.unhex(F.sha2(framed, 256)), 1, 16).alias("d"),
        F.char_length(body).cast("long").alias("len"),
    )
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("d")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pin(ranged.select("c", "d", "len", F.monotonically_increasing_id().alias("at")))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    # One row per conversation and partition: a conversation has as many as it spans partitions.
    pieces = placed.groupBy("c", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("c", "part", (F.col("first") - 1 - F.coalesce(F.sum("m").over(before), F.lit(0))).alias("shift"), "m")
    turns = placed.join(pieces.select("c", "part", "shift"), ["c", "part"]).select("c", (F.col("at") - F.col("shift")).alias("p"), "d", "len")
    return turns, pieces.groupBy("c").agg(F.sum("m").alias("n"))


def with_shared_openings(turns: DataFrame, convs: DataFrame, every: int = 100, spread: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c opens with the first h turns of conversation c - c % every, h = crc32(c) % spread.

    Its own turns after its first h follow. Without that conversation the opening is empty; a conversation may
    end up without turns and keeps its row with n = 0.
    """
    base = F.col("c") - F.col("c") % every
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(spread))
    convs = pin(convs)
    bases = convs.filter(F.col("c") == base).select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    plan = convs.select("c", "n", base.alias("base"), h.alias("h")).join(bases, "base", "left")
    plan = plan.withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    opening = turns.filter((F.col("c") == base) & (F.col("p") < spread)).select(F.col("c").alias("base"), "p", "d", "len")
    opened = plan.select("c", "base", "h").join(opening, "base").filter(F.col("p") <= F.col("h")).select("c", "p", "d", "len")
    # Only conversations whose opening is shorter than h shift their own turns.
    own = turns.withColumn("h", h).filter(F.col("p") > F.col("h"))
    short = plan.filter(F.col("lead") < F.col("h")).select("c", "lead")
    own = own.join(short, "c", "left").select("c", (F.col("p") - F.col("h") + F.coalesce("lead", "h")).alias("p"), "d", "len")
    sizes = plan.select("c", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return opened.unionByName(own), sizes


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and block: place ``k``, turns in order, prefix names before and at its end, lengths.

    ``before`` and ``total`` are code points ahead of the block and of the whole conversation; ``last`` marks the
    block that ends the conversation.
    """
    cut = turns.withColumn("k", F.floor((F.col("p") - 1) / BLOCK).cast("long"))
    grouped = cut.groupBy("c", "k").agg(F.sort_array(F.collect_list(F.struct("p", "d", "len"))).alias("turns"))
    lanes = grouped.select(
        "c", "k", "turns",
        _xor(F.transform("turns", lambda t: F.xxhash64(t["p"], t["d"]))).alias("bx"),
        _xor(F.transform("turns", lambda t: F.xxhash64(t["d"], t["p"]))).alias("by"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["len"]).alias("bl"),
    )
    lanes = pin(lanes)
    sums = [F.bit_xor("bx").alias("rx"), F.bit_xor("by").alias("ry"), F.sum("bl").alias("rl")]
    run = F.floor(F.col("k") / RUN)
    runs = lanes.groupBy("c", run.alias("run")).agg(*sums)
    so_far = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = runs.select("c", "run", *[F.coalesce(f.over(so_far), zero).alias(n) for f, n in ((F.bit_xor("rx"), "rx"), (F.bit_xor("ry"), "ry"), (F.sum("rl"), "rl"))])
    later = runs.filter("run > 0")
    inside = Window.partitionBy("c", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = lanes.withColumn("run", run).withColumns({"ix": F.bit_xor("bx").over(inside), "iy": F.bit_xor("by").over(inside), "il": F.sum("bl").over(inside)})
    joined = local.join(later, ["c", "run"], "left").na.fill(0, ["rx", "ry", "rl"])
    x, y = F.col("ix").bitwiseXOR(F.col("rx")), F.col("iy").bitwiseXOR(F.col("ry"))
    total = lanes.groupBy("c").agg(F.sum("bl").alias("total"))
    ends = convs.join(total, "c").select("c", "n", "total")
    return joined.join(ends, "c").select(
        "c", "k", "turns", "total",
        x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("bx")).alias("px"), y.bitwiseXOR(F.col("by")).alias("py"),
        (F.col("il") + F.col("rl") - F.col("bl")).alias("before"),
        (F.col("k") * BLOCK + F.size("turns")).alias("depth"),
        (F.col("k") * BLOCK + F.size("turns") == F.col("n")).alias("last"),
    )


def _opened(blocks: DataFrame, *carried: str) -> DataFrame:
    """One row per turn of each distinct block, named by its prefix; ``j`` from 1, ``px, py`` name the parent."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size("turns")),
        lambda j: F.struct(
            j.alias("j"),
            _xor(F.transform(F.slice("turns", F.lit(1), j), lambda t: F.xxhash64(t["p"], t["d"]))).bitwiseXOR(F.col("px")).alias("x"),
            _xor(F.transform(F.slice("turns", F.lit(1), j), lambda t: F.xxhash64(t["d"], t["p"]))).bitwiseXOR(F.col("py")).alias("y"),
            F.aggregate(F.slice("turns", F.lit(1), j), F.lit(0).cast("long"), lambda a, t: a + t["len"]).alias("upto"),
            F.element_at("turns", j)["len"].alias("len"),
        ),
    )
    # Of each step, its own name and the name of the step before; the first step's parent is the end of the block before.
    wide = blocks.withColumn("steps", steps)
    start = F.struct(F.lit(0).alias("j"), F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("len"))
    pairs = F.transform("steps", lambda s, i: F.struct(s.alias("s"), F.when(i == 0, start).otherwise(F.get(F.col("steps"), i - 1)).alias("up")))
    rows = wide.withColumn("pair", F.explode(pairs))
    return rows.select(
        (F.col("k") * BLOCK + F.col("pair.s.j")).alias("depth"), F.col("pair.s.x").alias("x"), F.col("pair.s.y").alias("y"),
        F.col("pair.up.x").alias("px"), F.col("pair.up.y").alias("py"), F.col("pair.s.len").alias("len"),
        (F.col("before") + F.col("pair.up.upto")).alias("above"), (F.col("pair.s.j") == F.size("turns")).alias("end"), *carried,
    )


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids ``c`` of each key, ascending and joined by commas.

    Ids are range-partitioned by key and id and written into texts of at most ``ID_BYTES``, so a key of any size is
    spread; a digest runs over its texts in order, in constant memory. The digest itself cannot be split.
    """
    order = [*KEY, "c"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0
        out: list[dict] = []

        def close() -> None:
            nonlocal held, size
            if held:
                out.append(dict(zip(KEY, key, strict=True)) | {"first": first, "ids": ",".join(held)})
            held, size = [], 0

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for *own, c in zip(*columns, strict=True):
                if own != key or size >= ID_BYTES:
                    close()
                    key, first = own, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, digest, out = None, hashlib.sha256(), []
        fields = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends", pa.string())])
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for *own, ids in zip(*columns, strict=True):
                if own == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append(dict(zip(KEY, key, strict=True)) | {"ends": digest.hexdigest()})
                    key, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, fields)
                out = []
        if key is not None:
            out.append(dict(zip(KEY, key, strict=True)) | {"ends": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, fields)

    spread = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    written = spread.mapInArrow(texts, "depth long, x long, y long, first long, ids string")
    return written.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, x long, y long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of conversations ``(c, p, d, len)`` with sizes ``(c, n)``.

    One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Without conversations there is no node.
    """
    convs = pin(convs)
    blocks = pin(_blocks(turns, convs))
    same = ["k", "px", "py", "x", "y"]
    # Conversations grouped by successive blocks; one row per distinct block.
    distinct = pin(
        blocks.groupBy(*same).agg(
            F.first("turns").alias("turns"), F.first("before").alias("before"), F.min("c").alias("low"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("last")).alias("n_end"), F.sum("total").alias("total"),
        )
    )
    root = convs.agg(F.min("c").alias("low"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 0).alias("n_end")).filter("n > 0")
    up = distinct.select((F.col("k") + 1).alias("k"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("n") - F.col("n_end")).alias("onward"))
    # The first block of all is never looked up: under the root everything may differ.
    deeper = distinct.filter("k > 0").join(up, ["k", "px", "py"]).withColumn("alone", F.col("onward") == F.col("n")).drop("onward")
    marked = pin(distinct.filter("k = 0").withColumn("alone", F.lit(False)).unionByName(deeper))

    def nodes(table: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """Rows by node with ``sums`` over the distinct blocks through it; blocks without siblings need no grouping."""
        carried = [c for c in table.columns if c not in (*same, "turns", "before", "alone")]
        straight = _opened(table.filter("alone"), *carried)
        forked = _opened(table.filter("NOT alone"), *carried)
        key = [*KEY, "px", "py", "len", "above"]
        return straight.select(*key, *[f.alias(c) for c, f in sums.items()]).unionByName(
            forked.groupBy(*key).agg(*[(F.min(f) if c == "low" else F.sum(f)).alias(c) for c, f in sums.items()])
        )

    ended = F.when(F.col("end"), F.col("n_end")).otherwise(F.lit(0))
    first = nodes(marked, {"low": F.col("low"), "n": F.col("n"), "total": F.col("total"), "n_end": ended})
    top = root.select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("x", "y", "px", "py", "len", "above")],
        "low", "n", F.lit(0).cast("long").alias("total"), "n_end",
    )
    first = pin(first.withColumn("depth", F.col("depth").cast("long")).unionByName(top))
    # What each conversation owns: its code points from the first node of which it is the smallest member, and a leaf.
    owned = first.groupBy(F.col("low").alias("c")).agg(F.min("above").alias("above_own"), F.max(F.when(F.col("n_end") == F.col("n"), 1).otherwise(0)).alias("leaf"))
    lengths = blocks.filter("last").select("c", "total")
    owned = pin(owned.join(lengths, "c", "left").select("c", (F.coalesce("total", F.lit(0)) - F.col("above_own")).alias("own"), F.col("leaf").cast("long").alias("leaf"), "above_own"))
    weighed = blocks.select("c", *same).join(owned.select("c", "own", "leaf"), "c").groupBy(*same).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    second = nodes(marked.select(*same, "turns", "before", "alone").join(weighed, same), {"own": F.col("own"), "leaf": F.col("leaf")}).select(*KEY, "own", "leaf")

    # Everything about a node meets in one grouping by its name.
    none = F.lit(None)
    fields = {"low": "long", "n": "long", "total": "long", "len": "long", "above": "long", "px": "long", "py": "long", "own": "long", "leaf": "long", "kids": "long", "ends": "string"}

    def part(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast("long") for c in KEY], *[(F.col(c) if c in df.columns else none).cast(t).alias(c) for c, t in fields.items()])

    kids = first.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("kids"))
    finished = blocks.filter("last").select("depth", "x", "y", "c").unionByName(convs.filter("n = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "c"))
    whole = owned.agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf")).select(*[F.lit(0).cast("long").alias(c) for c in KEY], "own", "leaf").filter("leaf IS NOT NULL")
    every = reduce(DataFrame.unionByName, [part(first), part(second), part(kids), part(_digests(finished)), part(whole)])
    node = every.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in fields])
    node = pin(node)
    all_total = blocks.filter("last").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("t")).scalar()
    # Members' code points from this depth on, less those of the distinct nodes from here on.
    start_of_own = owned.select(F.col("c").alias("low"), "above_own")
    # The smallest member's own nodes begin at or above this node; what it owns above is taken out.
    node = node.join(start_of_own, "low")
    heads = node.select("depth", "x", "y", F.col("low").alias("parent_conv_id"))
    below = node.filter("depth > 1").join(heads.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), "parent_conv_id"), ["depth", "px", "py"])
    one = root.select(F.col("low")).scalar()
    shallow = node.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, one))
    total = F.when(F.col("depth") == 0, all_total).otherwise(F.col("total"))
    saved = total - F.col("n") * F.col("above") - (F.col("own") - (F.col("above") - F.col("above_own")))
    return shallow.unionByName(below).select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("kids", F.lit(0).cast("long")).alias("n_children"),
        F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", openings: int | None = None) -> DataFrame:
    """Prefix trie of a table of turns; other columns are not looked at.

    Null conversation ids take no part; null turns come first and turns of equal number are ordered by the digest of
    role and text; null role and text count as empty; repeated rows are turns of their own. ``openings`` rebuilds
    conversations on shared openings first (:func:`with_shared_openings`). An empty table gives no rows.
    """
    turns, convs = numbered(conversations, conv, turn, role, text)
    if openings:
        turns, convs = with_shared_openings(turns, convs, openings)
    return trie(turns, convs)
