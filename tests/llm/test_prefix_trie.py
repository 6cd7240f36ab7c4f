"""Trie of conversations against nested dictionaries, with shards of a few nodes and a queue that spills."""

from __future__ import annotations

import random
import re
import zlib

import pytest

from tenderglow.llm import prefix_trie
from tests.llm.brute import sha


def wanted(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        inner = {k[:-1] for k in nodes if k}
        saved = sum((len(nodes[k]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below),
                    sum(k not in inner for k in below), saved, sha(ends)))
    return sorted(out, key=repr)


def made():
    draw = random.Random(11)
    rows = []
    for c in [*range(0, 130), 399, 400, -7, -20, -25]:
        for t in range(draw.choice([1, 1, 2, 3, 5])):
            rows.append((c, t, draw.choice(["user", "assistant"]) if t > 1 else "user", f"words {draw.randint(0, 2)} to say"))
    rows += [(500, t, "user", "one\ttwo three" if t % 7 else "") for t in range(60)]  # deep, and a copy that leaves it late
    rows += [(c, t, "user", "one\ttwo three" if t % 7 else "") for c in (520, 540) for t in range(45)] + [(540, 99, None, None)]
    rows += [(600, None, "user", "first"), (600, None, "a", "also first"), (600, 5, None, "x"), (600, 5, "user", None), (601, 1, "u", "t"), (601, 1, "u", "t"), (None, 1, "u", "t")]
    return rows


@pytest.mark.parametrize("shard, chunk, most", [(3, 2, 2), (16, 7, 2), (40, 4096, 9), (None, 4096, 200_000)])
def test_trie(spark, monkeypatch, shard, chunk, most):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = made()
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, shard string").repartition(3)
    found = prefix_trie.conversation_trie(turns, shard=shard, most=most).collect()
    # Turns that are equal in number are ordered by hash, so that one conversation's nodes are compared by their counts.
    tied = lambda r: r[0] == 600
    got, want = [tuple(r) for r in found], wanted(rows)
    assert sorted((r for r in got if not tied(r)), key=repr) == [r for r in want if not tied(r)]
    assert sorted(r[1:2] + r[3:6] for r in got if tied(r)) == sorted(r[1:2] + r[3:6] for r in want if tied(r))


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(empty).collect() == []


def test_spilling_queue_returns_all_in_order():
    draw = random.Random(2)
    queue, out = prefix_trie.SpillingQueue(5), []
    put = [(draw.randint(-9, 9), bytes(draw.randint(0, 255) for _ in range(16)), i, -i, i * i) for i in range(700)]
    for i, m in enumerate(put):
        queue.push(m)
        if i % 3 == 2:
            out.append(queue.pop())
    while queue.peek() is not None:
        out.append(queue.pop())
    assert sorted(out) == sorted(put)
    assert out[-300:] == sorted(out[-300:])
