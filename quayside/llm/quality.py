"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts inside tasks. The trees are grown on at most ``most_rows`` labelled rows (the documented bound: those
with the smallest hash of the id), flattened into arrays, and every document walks all trees at once
in numpy. Labels, ids, language and source are never inputs of a score.

Defined cases: null text counts as empty and is scored like any other; labels that are null are not learned from;
a document labelled several times gives several training rows; without labels of both kinds every score is the
smoothed share of label 1; an empty table gives no rows; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.shared import smallest_hashes
from quayside.llm.words import pieces

MOST_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "top_five_words", "distinct_pairs", "log_lines", "line_length", "repeated_lines",
    "upper", "lower", "digit", "space", "sentence_mark", "other_mark", "accented", "marked_words", "capital_words", "numeric_words", "short_words", "sentence_length",
)


def _character_class() -> np.ndarray:
    """Class of a code point: 0 other, 1 A-Z, 2 a-z, 3 digit, 4 white space, 5 sentence mark, 6 other mark, 7 letter beyond ASCII."""
    kind = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        x = chr(c)
        kind[c] = 1 if "A" <= x <= "Z" else 2 if "a" <= x <= "z" else 3 if x.isdigit() else 4 if x.isspace() else 5 if x in ".,;:?'\"-" else 7 if x.isalpha() else 6
    return kind


_KIND = _character_class()


def _kinds(text: str) -> np.ndarray:
    total = np.zeros(8, np.int64)
    for at in range(0, len(text), 1_000_000):  # a very long text is counted in parts
        points = np.frombuffer(text[at : at + 1_000_000].encode("utf-32-le", "surrogatepass"), np.uint32)
        total += np.bincount(np.where(points < len(_KIND), _KIND[np.minimum(points, len(_KIND) - 1)], 7), minlength=8)
    return total


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = _kinds(text) / chars
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)]
    lines = [x for x in text.split("\n") if x]
    sentences = max(1, text.count(".") + text.count("?") + text.count("!"))
    marked = sum(map(str.isalpha, (w[-1] for w in words)))
    return [
        np.log1p(len(text)), np.log1p(len(words)), (len(text) - kinds[4] * chars) / n, max(map(len, words), default=0), len(counts) / n, (top[0] if top else 0) / n, sum(top) / n,
        len(set(zip(words, words[1:]))) / n, np.log1p(len(lines)), len(text) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        *kinds[1:], 1 - marked / n, sum(map(str.isupper, words)) / n, sum(map(str.isnumeric, words)) / n, sum(len(w) <= 3 for w in words) / n, len(words) / sentences,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Forest:
    """All nodes of all trees in flat arrays; a leaf is its own child."""

    start: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] > self.threshold[at], self.right[at], self.left[at])
        return 1 / (1 + np.exp(-np.clip(self.start + self.value[at].sum(axis=1), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 20, shrink: float = 1.0) -> Forest:
    """Boost level-wise trees on the logistic loss; splits are searched over histograms of binned values."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots = []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        offset = np.arange(x.shape[1]) * bins
        margin = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            base = len(nodes)
            roots.append(base)
            nodes.append([0, np.inf, base, base, 0.0])
            where = np.full(len(y), base)
            frontier = [base]
            for level in range(depth + 1):
                slot = {node: i for i, node in enumerate(frontier)}
                at = np.array([slot.get(w, -1) for w in range(base, len(nodes))])[where - base]
                live = at >= 0
                size = len(frontier) * x.shape[1] * bins
                cell = ((at[live] * x.shape[1] * bins)[:, None] + offset + binned[live]).ravel()
                hist = [np.bincount(cell, np.repeat(v[live], x.shape[1]) if v is not None else None, size).reshape(len(frontier), x.shape[1], bins).cumsum(2) for v in (grad, hess, None)]
                nexts = []
                for i, node in enumerate(frontier):
                    g, h, c = (a[i] for a in hist)
                    nodes[node][4] = rate * g[0, -1] / (h[0, -1] + shrink)
                    gain = g**2 / (h + shrink) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + shrink) - g[:, -1:] ** 2 / (h[:, -1:] + shrink)
                    gain[(c < least) | (c[:, -1:] - c < least)] = 0
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if level == depth or gain[f, b] <= 1e-6 or b >= len(edges[f]):
                        continue
                    left, right = len(nodes), len(nodes) + 1
                    nodes[node][:4] = [f, edges[f][b], left, right]
                    nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                    mine = where == node
                    where[mine] = np.where(binned[mine, f] > b, right, left)
                    nexts += [left, right]
                frontier = nexts
                if not frontier:
                    break
            margin = margin + np.array([n[4] for n in nodes[base:]])[where - base]
    flat = np.array(nodes or [[0, np.inf, 0, 0, 0.0]], np.float64)
    index = lambda c: flat[:, c].astype(np.int32)
    return Forest(start, np.array(roots or [0], np.int32), index(0), flat[:, 1], index(2), index(3), flat[:, 4], depth)


def fold(key: Column) -> Column:
    """Remainder that decides which labels are learned from."""
    return F.crc32(key.cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Forest:
    """Grow the trees on rows whose fold is not 1; at most ``most_rows`` of them, by the hash of the id."""
    known = labels.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_y")).where("_key IS NOT NULL AND _y IS NOT NULL").where(fold(F.col("_key")) != 1)
    picked = smallest_hashes(known.withColumn("_h", F.xxhash64("_key")), "_h", most_rows).drop("_h")
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_key").select("text", "_y")

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(matrix(texts).tolist(), pa.list_(pa.float64())), batch.column("_y")], ["x", "y"])

    found = texts.mapInArrow(rows, "x array<double>, y int").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(found.num_rows, len(FEATURES))
    y = found.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))  # the same trees whatever order the rows came in
    return grow(x[order], y[order])


def scored(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, with whole texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(forest.score(matrix(texts)))], ["key", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, score double")
    return found.withColumnRenamed("key", id_col)


def good_documents(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in pieces(batches, names[at]):
            yield batch.filter(pa.array(forest.score(matrix(texts)) >= threshold))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
