"""Best-fit packing: ids against the tokenizer itself, exact round trip of the pieces, and the program against its bound."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quayside.llm.config_packing import cuts, encoder, packed, solve

NAME = "byte_bpe_50k.json"


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(NAME))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def odd_texts():
    rnd = random.Random(4)
    letters = " \n\t\r\x0b\x1c\xa0 　ab'sZ09_.,-<|>éß中😀́\x00"
    return ["", None, " ", "\n\n", " a  b\n\n\nc ", "it's we'll <|endoftext|> x", *("".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(400))]


def test_ids_are_those_of_the_tokenizer():
    texts = odd_texts() + [" " * 700_000 + "x", "ab" * 50_000]
    for text, ids in zip(texts, plain_ids(texts)):
        assert encoder(NAME).ids(text).tolist() == ids


def held(packing):
    got = Counter()
    for parts, copies in packing.configurations:
        assert copies > 0 and sum(n * k for n, k in parts) <= packing.length
        for n, k in parts:
            got[n] += k * copies
    return got


@pytest.mark.parametrize("scale", [1, 100])
def test_program_holds_every_piece_near_its_bound(scale):
    rnd = random.Random(scale)
    histogram = Counter(min(256, 1 + int(rnd.expovariate(1 / 60))) for _ in range(2000))
    histogram = {n: c * scale for n, c in histogram.items()}
    p = solve(histogram, 256)
    assert held(p) == Counter(histogram)
    volume = -(-sum(n * c for n, c in histogram.items()) // 256)
    assert volume <= p.bound <= p.sequences <= p.bound * 1.01 + 2


def test_program_on_small_cases():
    assert solve({}, 8).sequences == 0 and solve({8: 3}, 8).sequences == 3
    assert solve({5: 2, 3: 2}, 8).sequences == 2 and solve({7: 4}, 8).sequences == 4
    # longest first with the best fitting partner: 6+2 leaves 5 alone, all in all 3 sequences are needed and enough
    assert solve({6: 2, 5: 1, 3: 1, 2: 2}, 8).sequences == 3
    p = solve({4: 10**9 + 1, 3: 10**9, 1: 10**9}, 8)
    assert held(p) == Counter({4: 10**9 + 1, 3: 10**9, 1: 10**9}) and p.sequences <= 10**9 + 2


def test_cuts():
    assert cuts(5, 4) == [(0, 1), (1, 4)] and cuts(4, 4) == [(0, 4)] and cuts(1, 4) == [(0, 1)] and cuts(8, 4) == [(0, 4), (4, 4)]


def test_round_trip(spark):
    texts = odd_texts()[:120] + ["copy of one text"] * 200 + ["long words go on " * 4000]
    rows = [(None if i == 7 else i % 250, t, "x", 1) for i, t in enumerate(texts)]  # ids repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, n int").repartition(5)
    got = packed(docs, NAME, end_id=2, length=64).collect()
    assert packed(docs.limit(0), NAME).count() == 0
    ids = lambda r: np.frombuffer(bytes(r.ids), "<u4").tolist()
    # every document's pieces put together are its ids and the end id
    pieces, wanted = Counter(), Counter()
    for r in got:
        assert r.length == len(ids(r)) and (r.piece == 0) == (r.start == 0)
        pieces[(r.doc_id, r.piece, r.start, tuple(ids(r)))] += 1
    for (key, _, _, _), own in zip(rows, plain_ids(texts)):
        own = [*own, 2]
        for i, (at, n) in enumerate(cuts(len(own), 64)):
            wanted[(key, i, at, tuple(own[at : at + n]))] += 1
    assert pieces == wanted
    # sequences are gapless from 0 and within their length
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 64) * 1.02 + 1
