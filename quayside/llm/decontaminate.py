"""Benchmark decontamination: SimHash over item-sized windows, Hamming blocks, exact verification.

Words are runs of letters, digits and underscores in lower case; shingles are ``width`` words (a shorter
item is one shingle). For every benchmark item the windows of a document that have as many words as the item
(a shorter document is one window) are fingerprinted: each shingle votes on 64 bits with its
multiplicity. Windows that share no shingle with any item of their size have similarity 0 and are left out before
fingerprinting, which loses nothing. A multi-index of ``radius + 1`` bit blocks finds every item within
``radius`` bits: two fingerprints that differ in at most ``radius`` bits agree in some block. A candidate counts when the
weighted Jaccard similarity of the shingles (multiplicities as weights) is at least ``similarity``.
At similarity 0.8 the expected distance is about 10 bits with a deviation of 3; the default radius of 24 lies
more than four deviations above, and unrelated pairs differ in 32 +- 4 bits.

The items travel to the tasks in portions of at most ``portion_chars`` characters, or one longer item (a documented bound);
equal items are matched once and reported as often as they stand in the benchmark. A larger benchmark is matched portion by portion,
over documents numbered in a table of the shared folder, and the matches of a row are put together. Documents are
read whole and never shuffled.

Defined cases: null or blank documents and items match nothing; repeated items are each reported; ties between
windows go to the first one; rows that repeat are each judged; null ids are carried; empty tables give no rows
(no benchmark: no document is contaminated); matches are in the order of the item, then of the place; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.shared import text_of, written
from quayside.llm.words import U64, mix, pieces, windows, word_hashes

_TABLE_BITS = 20


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1).view(">u8").ravel().astype(U64)


def _bits(h: np.ndarray) -> np.ndarray:
    """+1 and -1 votes of shingle hashes on 64 bits."""
    spread = mix(h + U64(0x5851F42D4C957F2D))
    return np.unpackbits(spread.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(h: np.ndarray) -> int:
    return int(_fingerprints(_bits(h).sum(axis=0, keepdims=True))[0])


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (a.total() + b.total() - shared) if shared else 0.0


class HammingIndex:
    """All stored fingerprints within ``radius`` bits of a query, by blocks of which one must agree."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            value = self._value(prints, low, high)
            order = np.argsort(value, kind="stable")
            self.blocks.append((low, high, order, value[order]))

    @staticmethod
    def _value(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> U64(low)) & U64((1 << (high - low)) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, stored) within the radius, each once."""
        seen = []
        for low, high, order, value in self.blocks:
            q = self._value(queries, low, high)
            first, last = np.searchsorted(value, q, "left"), np.searchsorted(value, q, "right")
            n = last - first
            who = np.repeat(np.arange(len(q)), n)
            which = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            close = np.bitwise_count(queries[who] ^ self.prints[which]) <= self.radius
            seen.append(who[close] * len(self.prints) + which[close])
        pairs = np.unique(np.concatenate(seen))
        return pairs // len(self.prints), pairs % len(self.prints)


class Matcher:
    """The items of one portion, prepared for scanning documents."""

    def __init__(self, items: list[tuple[int, str]], width: int = 5, similarity: float = 0.8, radius: int = 24):
        self.width, self.similarity = width, similarity
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for (key, _), words in zip(items, word_hashes([t for _, t in items], "letters")):
            if len(words):
                by_size[len(words)].append((key, windows(words, min(width, len(words)))))
        # per window size: item ids, shingle counts, index; per shingle width: which sizes have the shingle
        self.sizes = {n: ([k for k, _ in own], [Counter(h.tolist()) for _, h in own], HammingIndex(np.array([fingerprint(h) for _, h in own], U64), radius)) for n, own in by_size.items()}
        self.holders: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for n, own in by_size.items():
            for _, h in own:
                for x in h.tolist():
                    self.holders[min(width, n)][x].add(n)
        self.flags = {}
        for w, held in self.holders.items():
            self.flags[w] = np.zeros(1 << _TABLE_BITS, bool)
            self.flags[w][np.array(list(held), U64) >> U64(64 - _TABLE_BITS)] = True

    def all_matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        return [self.matches(h) for h in word_hashes(texts, "letters")]

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item found in a text's words."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for w, held in self.holders.items():
            found = windows(hashes, w)
            anchors: dict[int, list[int]] = defaultdict(list)
            for at in np.flatnonzero(self.flags[w][found >> U64(64 - _TABLE_BITS)]).tolist():
                for n in held.get(int(found[at]), ()):
                    anchors[n].append(at)
            for n, at in anchors.items():
                self._scan(n, w, np.array(at), found, len(hashes), best)
        return [(self.sizes[n][0][i], start, size, score) for (n, i), (score, start, size) in sorted(best.items())]

    def _scan(self, n: int, w: int, at: np.ndarray, found: np.ndarray, total: int, best: dict) -> None:
        keys, counts, index = self.sizes[n]
        size = min(n, total)
        inside = size - w + 1  # shingles of a window
        starts = np.unique(np.clip((at[:, None] - np.arange(inside)).ravel(), 0, total - size))
        cuts = np.flatnonzero(np.diff(starts) > inside) + 1
        for run in np.split(starts, cuts):  # stretches of neighbouring windows share running sums
            low = run[0]
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(found[low : run[-1] + inside]), axis=0, dtype=np.int32)))
            who, which = index.near(_fingerprints(sums[run - low + inside] - sums[run - low]))
            last, window = -1, None
            for q, i in zip(who.tolist(), which.tolist()):
                start = int(run[q])
                if q != last:
                    window, last = Counter(found[start : start + inside].tolist()), q
                score = weighted_similarity(counts[i], window)
                if score >= self.similarity and ((n, i) not in best or score > best[n, i][0]):  # starts ascend, so the first stays
                    best[n, i] = (score, start, size)


def _portions(benchmark: DataFrame, id_col: str, text_col: str, portion_chars: int) -> tuple[bool, Iterator[list[tuple[int, str, int]]]]:
    """Whether there are several portions, and the portions: lists of (item, text, how often it stands in the benchmark)."""
    items = benchmark.groupBy(F.col(id_col).alias("k"), text_of(text_col).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    if (items.agg(F.sum(F.length("t"))).first()[0] or 0) <= portion_chars:
        return False, iter([[tuple(r) for r in items.collect()]])
    items = written(items, "items")

    def cut():
        own, size = [], 0
        for r in items.toLocalIterator():
            if own and size + len(r["t"]) > portion_chars:
                yield own
                own, size = [], 0
            own.append(tuple(r))
            size += len(r["t"])
        yield own

    return True, cut()


_MATCH = ("item", "first_word", "words", "similarity")


def _found_in(items: list[tuple[int, str, int]], width: int, similarity: float, radius: int, every: bool):
    """A function over batches (key, text) to (key, matches); without ``every``, only of the rows with matches."""
    shape = pa.list_(pa.struct([("item", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())]))

    def run(batches):
        matcher = Matcher([(i, text) for i, (_, text, _) in enumerate(items)], width, similarity, radius)
        for batch, texts in pieces(batches, "text"):
            found = []
            for own in matcher.all_matches(texts):
                named = sorted(((items[i][0], *rest) for i, *rest in own for _ in range(items[i][2])), key=lambda m: (m[0] is not None, m[0] or 0, *m[1:]))
                found.append([dict(zip(_MATCH, m)) for m in named])
            out = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, shape)], ["key", "matches"])
            yield out if every else out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      width: int = 5, similarity: float = 0.8, radius: int = 24, portion_chars: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``: id and ``matches``, an array of (item, first_word, words, similarity)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = "matches array<struct<item:bigint,first_word:bigint,words:bigint,similarity:double>>"
    several, portions = _portions(benchmark, item_col, item_text, portion_chars)
    if not several:
        plain = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
        return plain.mapInArrow(_found_in(next(portions), width, similarity, radius, True), f"key {kind}, {shape}").withColumnRenamed("key", id_col)
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "documents")
    plain = rows.select("key", "text")
    # one portion at a time, so that the driver and the tasks hold no more than one
    parts = [written(plain.mapInArrow(_found_in(items, width, similarity, radius, False), f"key bigint, {shape}"), "matches") for items in portions]
    found = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    return rows.select("key", "id").join(found, "key", "left").select(F.col("id").alias(id_col), F.coalesce("matches", F.expr(f"CAST(array() AS {shape.split(' ', 1)[1]})")).alias("matches"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                    width: int = 5, similarity: float = 0.8, radius: int = 24, portion_chars: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item was found."""
    at = docs.columns.index(text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = out.schema
    for items in _portions(benchmark, item_col, item_text, portion_chars)[1]:

        def run(batches, items=[(k, t) for k, t, _ in items]):
            matcher = Matcher(items, width, similarity, radius)
            for batch, texts in pieces(batches, f"c{at}"):
                yield batch.filter(pa.array([not own for own in matcher.all_matches(texts)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.toDF(*docs.columns)
