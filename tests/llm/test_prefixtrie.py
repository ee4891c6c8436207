"""The prefix trie of conversations against one built in memory, and its message queue."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from txtrail.llm import prefixtrie


def conversations(seed=2, blocks=4, many=30):
    rng = random.Random(seed)
    rows = []
    for c in [b * 100 + i for b in range(blocks) for i in range(many)] + [-7, -300]:
        if c == 200:
            continue
        for turn in range(rng.choice([0, 1, 2, 3, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "hé日", "go on", ""])))
    rows += [(5, None, None, None), (5, 3, "user", "hi"), (5, 3, "user", "hi"), (None, 1, "user", "lost"), (6, 7, None, "x" * 30_000)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(mine)] for c, mine in turns.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(turns.get(block, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, mine in rebuilt.items():
        for d in range(len(mine) + 1):
            members[mine[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, mine in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(mine) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, mine in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in mine if rebuilt[c] == node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(mine), len(node), parent, len(mine), children[node], leaves[node], saved[node], digest))
    return out


@pytest.mark.parametrize(
    "shard_turns, limit, stretch",
    [(prefixtrie.SHARD_TURNS, prefixtrie.QUEUE_ROWS, prefixtrie.STRETCH), (25, 2, 2)],
)
def test_trie(spark, shard_turns, limit, stretch):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", "1 AS depth", "2 AS key", "'x' AS k1")
    found = prefixtrie.trie(df, shard_turns=shard_turns, limit=limit, stretch=stretch)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows)))


def test_trie_without_conversations(spark):
    df = spark.createDataFrame([(None, 1, "user", "lost")], "conv_id bigint, turn bigint, role string, text string")
    assert prefixtrie.trie(df).collect() == []


def test_long_lists_of_ends(spark):
    ends = spark.range(0, 3000).selectExpr("id % 3 AS k1", "0L AS k2", "id * 7 - 500 AS conv_id")
    found = {r.k1: r.ends_sha256 for r in prefixtrie.ends_digests(ends, chars=200).collect()}
    for k in range(3):
        ids = ",".join(str(i * 7 - 500) for i in range(k, 3000, 3))
        assert found[k] == hashlib.sha256(ids.encode()).hexdigest()


def test_queue_that_spills_gives_what_was_pushed():
    rng = np.random.default_rng(1)
    queue, want = prefixtrie.MessageQueue(limit=50, block=7), defaultdict(int)
    for _ in range(40):
        some = np.zeros(20, prefixtrie.MESSAGE)
        some["id"], some["saved"] = rng.integers(-100, 100, 20), rng.integers(0, 9, 20)
        for i, s in zip(some["id"].tolist(), some["saved"].tolist()):
            want[i] += s
        queue.push(some)
    assert len(queue.runs) > 3
    got = []
    for last in (-90, -90, 0, 55, None):
        got += [(int(m["id"]), int(m["saved"])) for m in queue.pop(last)]
    queue.close()
    assert got == sorted(want.items())
