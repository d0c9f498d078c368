import random
import zlib
from hashlib import sha256

import pytest

from hustings.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, kind int, shard int, grp string"


def by_hand(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [row[2:] for row in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, convs in members.items():
        for k in range(len(p) + 1):
            leaves[p[:k]] += not children[p]
            saved[p[:k]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            min(convs), len(p), min(members[p[:-1]]) if p else -1, len(convs), children[p], leaves[p], saved[p],
            sha256(",".join(str(c) for c in sorted(convs) if len(built[c]) == len(p)).encode()).hexdigest(),
        )
        for p, convs in members.items()
    )


def run(spark, rows, shard_rows, block=32):
    df = spark.createDataFrame([(*r, "k", 1, 2, 3, "g") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(-1 if v is None else v for v in r) for r in pt.prefix_trie(df, shard_rows, block).collect())


def conversations(n, longest, words, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        same = rng.random() < 0.4
        turns = rng.choice([longest, 3]) if same else rng.randint(1, longest)
        for t in range(turns):
            text = "é" * (t % 3) if same else rng.choice(words)
            rows.append((c * 3 % (4 * n), t, "user" if t % 2 == 0 else "assistant", text))
    return rows


@pytest.mark.parametrize("n, longest, shard_rows, block", [(300, 7, 9, 32), (150, 40, 20, 4), (60, 90, 7, 3), (250, 3, 1, 1), (200, 12, 50_000, 4)])
def test_against_a_plain_trie(spark, n, longest, shard_rows, block):
    rows = conversations(n, longest, ["", "a", "bb", "ccc"], n)
    assert run(spark, rows, shard_rows, block) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 0, "user", "hello"), (0, 1, None, None), (0, 1, None, None),
        (1, 5, "user", "hello"), (2, 0, "", ""), (107, 0, "user", "no base"), (205, 1, "b", "tie"), (205, 1, "a", "tie"),
        (None, 0, "user", "nobody"), (300, 0, "user", "x" * 200_000), (301, None, None, None),
    ]
    assert run(spark, rows, 2) == by_hand(rows)
    assert run(spark, [(None, 1, "a", "b")], 2) == []
    assert run(spark, [], 2) == []
    # Conversations that lose all turns are members of the root, which is then a leaf.
    bare = [(c, 0, "user", "only") for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert run(spark, bare, 10) == by_hand(bare)


def test_one_conversation_copied_many_times(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(6)]
    assert run(spark, rows, 25) == by_hand(rows)
