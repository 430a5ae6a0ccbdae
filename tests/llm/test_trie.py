import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from opinara.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth int, k string, n long"


def rebuilt(rows, openings):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
            turns[c].append(((t is not None, t or 0, digest), (r, x)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    if not openings:
        return own
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - openings * int(c / openings))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute(rows, openings):
    convs = rebuilt(rows, openings)
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1]) if key else 0
    return sorted(
        (min(m), len(key), min(members[key[:-1]]) if key else None, len(m), kids[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest())
        for key, m in members.items()
    )


def found(spark, rows, openings):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = prefix_trie.conversation_trie(table, openings=openings)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def clash(rows):
    return [(*r, "x", 3, "y", 1) for r in rows]


def awkward():
    rng = random.Random(3)
    rows = []
    for c in [*range(-130, -120), -100, -3, *range(0, 60), 200, 205, 300, *range(301, 330), 512, 10**12 + 1]:
        for t in range(rng.randint(1, 11)):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé", "🙂 z", None, ""]) if rng.random() < 0.8 else f"own {c} {t}"))
    # Copies, turns of equal number and without one, repeated rows, null ids, a long conversation and a long text.
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1030) for t in range(6)]
    rows += [(2001, None, "user", "x"), (2001, None, "user", "a"), (2001, 1, "user", "a"), (2001, 1, "a", "usera"), (2001, 1, "user", "a"), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(2002, t, "user", f"{t % 7}") for t in range(90)] + [(2003, t, "user", f"{t % 7}") for t in range(93)] + [(2004, 0, "user", "long " * 50_000)]
    return clash(rows)


@pytest.mark.parametrize(("openings", "block", "run", "id_bytes"), [(100, 4, 256, 1 << 16), (None, 3, 2, 8)])
def test_trie_against_brute_force(spark, monkeypatch, openings, block, run, id_bytes):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "ID_BYTES", id_bytes)
    rows = awkward()
    want = brute(rows, openings)
    assert found(spark, rows, openings) == want and max(x[1] for x in want) > 80


def test_turnless_conversations_are_members_of_the_root(spark):
    # One turn each, all replaced by the opening of a conversation that is not there.
    one, two = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6][:2]
    rows = clash([(one, 0, "user", "a"), (two, 0, "user", "b")])
    assert rebuilt(rows, 100) == {one: [], two: []}
    assert found(spark, rows, 100) == brute(rows, 100) == [(one, 0, None, 2, 0, 1, 0, hashlib.sha256(f"{one},{two}".encode()).hexdigest())]


def test_no_conversations(spark):
    assert found(spark, [], 100) == []


def test_roles_and_texts_do_not_run_together(spark):
    rows = clash([(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, None, "abc")])
    got = found(spark, rows, None)
    assert got == brute(rows, None) and len(got) == 4
