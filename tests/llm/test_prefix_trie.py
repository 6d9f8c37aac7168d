"""Prefix tries against a brute-force dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quayside.llm import prefix_trie
from quayside.llm.prefix_trie import _left, _least, _minima, _right, shared_openings, trie, turn_lists

SCHEMA = "conv_id long, turn int, role string, text string, key string, n_convs int"


def brute(rows, every=100, most=6):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    talks = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in talks.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % most
        path = talks.get(c - int(np.fmod(c, every)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
            if d:
                children[tuple(path[: d - 1])].add(tuple(path[:d]))
    out = Counter()

    def sums(node):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [sums(k) for k in children[node]]
        leaves, saved = sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)
        ends = ",".join(str(c) for c, e in sorted(members[node]) if e)
        up = min(c for c, _ in members[node[:-1]]) if node else None
        out[(min(c for c, _ in members[node]), len(node), up, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
        return leaves, saved

    if members:
        sums(())
    return out


def found(spark, rows, parts=4):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return Counter(map(tuple, trie(shared_openings(turn_lists(turns))).collect()))


@pytest.mark.parametrize(("seed", "block"), [(1, 1), (2, 3), (3, 50), (4, 100_000)])
def test_equal_to_brute_force(spark, monkeypatch, seed, block):
    """Few different turns, so that prefixes are shared at every depth; blocks of one row up make nodes span blocks and tasks."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-150, 900), 300):
        rows += [(c, t, rnd.choice("ua"), rnd.choice(["", "x", "yy"])) for t in range(rnd.randint(1, 8))]
    rows += [(c, t, "u", "copy" * (t + 1)) for c in range(1000, 1100) for t in range(7)]  # one conversation again and again
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [
        (5, None, "a", "first"), (5, 0, None, None), (5, 0, "", ""), (6, 1, "b", "tie"), (6, 1, "a", "tie"), (6, 1, "a", "tie"),
        (None, 0, "u", "nobody"), (7, 0, "u", "long " * 30_000), (8, 0, "ab", "c"), (9, 0, "a", "bc"), (100, 0, "u", "x"),
    ]
    rows += [(250, t, "u", "same") for t in range(3000)] + [(251, t, "u", "same") for t in range(2999)]
    got = found(spark, rows)
    short = [r for r in rows if r[0] is None or r[0] < 200]
    assert found(spark, short) == brute(short)
    deep = [r for r in got if r[1] > 100]
    assert max(r[1] for r in deep) >= 2999 and all(r[3] in (1, 2) for r in deep)
    assert not found(spark, []) and not found(spark, [(None, 1, "u", "x")])


def test_extents_are_those_of_a_walk():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 65):
        lcp = rnd.integers(0, 4, n)
        lcp[0] = 0
        at, depth = np.repeat(np.arange(n), 4), np.tile(np.arange(1, 5), n)
        low, high, table = at.copy(), at.copy(), _minima(lcp)
        for i in range(len(at)):
            while low[i] > 0 and lcp[low[i]] >= depth[i]:
                low[i] -= 1
            while high[i] < n - 1 and lcp[high[i] + 1] >= depth[i]:
                high[i] += 1
        assert (_left(table, at, depth) == low).all() and (_right(table, at, depth) == high).all()
        values = rnd.integers(0, 100, n)
        assert _least(_minima(values), low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]
