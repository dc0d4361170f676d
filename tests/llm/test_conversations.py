"""The prefix trie against a plain version, and its arrays."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from taskmill.llm import prefix_trie
from taskmill.llm.prefix_trie import pack, prefix_nodes

DDL = "conv_id long, turn long, role string, text string, key string, __extra int"


def plain(rows):
    """All nodes, from the sets of members of every prefix."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in own.items():
        taken = zlib.crc32(str(conv).encode()) % 6
        path = tuple(own.get(int(conv / 100) * 100, [])[:taken] + turns[taken:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(conv)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        saved[path] += (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
    ) for p, m in members.items()) if members else []


def nodes(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL).repartition(3)
    return sorted(map(tuple, prefix_nodes(df, **options).collect()))


def corpus(seed):
    rng = random.Random(seed)
    rows = [
        (c, None if rng.random() < 0.1 else t, rng.choice(["user", None]), rng.choice(["a", "a", "a", "bb", "", None, "é\U0001F600"]))
        for c in range(-130, 260) for t in range(rng.choice([1, 2, 3, 5, 9, 14]))
    ]
    rows += [(None, 0, "user", "nobody"), (7, 0, "user", "a"), (7, 0, "user", "a"), (2**62, 1, None, "x" * 200_000)]
    return rows


@pytest.mark.parametrize("bucket_turns", [prefix_trie.BUCKET_TURNS, 40])
def test_equals_the_plain_version(spark, bucket_turns):
    rows = corpus(bucket_turns)
    assert nodes(spark, rows, bucket_turns=bucket_turns) == plain(rows)


def test_one_first_turn_and_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 4)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(8)]
    rows += [(c, t, "user", "same 0" if t == 0 else f"{c} {t}") for c in range(1000, 1200) for t in range(7)]
    assert nodes(spark, rows, bucket_turns=100) == plain(rows)


def test_long_shared_beginnings(spark):
    rows = [(c, t, "user", f"{t}" if t < 60 else f"{c % 3} {t}") for c in range(0, 900, 100) for t in range(60 + c // 100)]
    assert nodes(spark, rows, bucket_turns=20) == plain(rows)


def test_turnless_and_absent_conversations(spark):
    absent = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(absent, 0, "user", "gone")]
    assert nodes(spark, rows) == plain(rows)
    assert [r[1] for r in nodes(spark, rows)] == [0]
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []


def test_double_arrays_hold_exactly_the_paths():
    rng = random.Random(3)
    turns = [hashlib.sha256(bytes([i])).digest()[:16] for i in range(40)]
    paths = sorted({tuple(rng.choice(turns) for _ in range(rng.randint(0, 7))) for _ in range(500)})
    trie, codes, found = pack([list(p) for p in paths])
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)} | {()}
    assert len(found) == len(prefixes) == len({s for s, _ in found})
    assert sorted(codes.values()) == list(range(1, len(codes) + 1))
    reached = set()
    for prefix in prefixes:
        state = 1
        for turn in prefix:
            state = trie.child(state, codes[turn])
            assert state
        reached.add(state)
        for turn in turns:
            assert bool(trie.child(state, codes.get(turn, 0))) == ((*prefix, turn) in prefixes)
    assert len(reached) == len(prefixes)
