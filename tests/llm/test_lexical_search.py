"""Ranked lexical search against a brute-force score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quayside.llm import lexical_search
from quayside.llm.lexical_search import build_index, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    held = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n_docs, n_terms = len(held), sum(len(ts) for _, ts in held)
    df = Counter(t for _, ts in held for t in set(ts))
    out = []
    for item, text in dict.fromkeys(items):
        asked, scores = set(TERM.findall((text or "").translate(UPPER))), []
        for i, ts in held:
            tf, m = Counter(ts), 50 + 50 * len(ts) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in asked if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, place, None if none else i, -s) for place, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(spark, docs, items, k):
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, terms string, segment string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query int")
    return Counter(map(tuple, search(build_index(table), asked, k).select("item_id", "rank", "doc_id", "score").collect()))


def texts(rnd, n, words):
    """Documents of words of very unequal frequency; some words always come together, others never do."""
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rnd.choices(words, weights, k=rnd.randint(1, 30))) + (" Pair-one pair.two" if rnd.random() < 0.1 else "") for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 40)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 30)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = list(enumerate(texts(rnd, 600, words)))
    docs += [(1000 + i, "w1 w2 w3 copy") for i in range(80)]  # ties far beyond k
    items = list(enumerate(texts(rnd, 12, words))) + [(50, "copy w59"), (51, "pair one two"), (51, "w3"), (50, "copy w59")]
    assert found(spark, docs, items, 7) == brute(docs, items, 7)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Été été ÉTÉ x1"), (None, "x1"), (5, "x1"), (5, "x1"), (6, "long " * 60_000 + "x1"), (-3, "X1!"), (7, "a\x00b")]
    items = [(None, "x1 x1"), (1, None), (2, ""), (3, "unheard of"), (4, "été"), (5, "A b")]
    assert found(spark, docs, items, 50) == brute(docs, items, 50)
    assert not found(spark, [], items, 5) and not found(spark, docs, [], 5) and not found(spark, [(1, None)], items, 5)


def test_pair_bounds_skip():
    """Terms that never meet cannot lift a document over the best so far: with the joint maxima their lists are not even added up."""
    row = {
        "segment": 1, "ids": list(range(200)), "lengths": np.full(200, 4, "<i8").tobytes(), "terms": "a b c", "dfs": [100, 100, 50],
        "places": np.r_[0:100, 100:200, 0:50].astype("<u2").tobytes(), "tfs": np.ones(250, "<u4").tobytes(),
    }
    rows = [{"query": 0, "term": t} for t in "abc"]
    block = lexical_search._block(rows, {"a": 100, "b": 100, "c": 50}, 200, 800)
    block.queries[0].units[:] = [(block.terms[b"a"], block.terms[b"b"], 0), (block.terms[b"c"], None, None)]
    block.pairs[:] = [(block.terms[b"a"], block.terms[b"b"])]
    lists = lexical_search._Lists(lexical_search._impacts(block, row))
    a, b, c = (lists.top[block.terms[t]] for t in (b"a", b"b", b"c"))
    assert lists.bound(*block.queries[0].units[0]) == max(a, b) < a + b
    places, score = lexical_search.best_of(lists, block.queries[0], 1, 60)
    assert {a + c} == set(score[:50].tolist())
    assert len(lexical_search.best_of(lists, block.queries[0], a + c + 1, 60)[0]) == 0
