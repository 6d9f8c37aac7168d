"""Ranked lexical search by MaxScore with pair bounds, over an index cut into segments of documents.

``build_index`` writes one row per segment (some thousand documents that one task reads one after the other): the ids, the lengths and,
term by term, the places of the documents that hold it and how often. Nothing shuffles, so a term that every document holds
is a list no longer than its segment.

``search`` takes the queries in blocks of bounded size. For a block it writes, segment by segment, the impacts of the queries' terms with their
maxima, and for chosen pairs of terms the list of documents that hold both with the largest joint impact among them. Pairs are
neighbours in the order of weights of a query, each term in one pair, so a query's pairs split its terms:
a document scores at most the sum over the pairs of ``max(joint maximum, maximum of either alone)``. For rare terms that never
meet this is half the sum of their maxima. A query walks its pairs from the largest bound down. Documents found only in pairs whose
bounds together stay below the k-th best score so far are never looked up, and a document is dropped once its score so far and
the bounds of the pairs left cannot reach it. The pair lists are looked at first: their documents, scored whole, give the first k-th best score.

The k-th best scores of a few segments (``SEEDS`` at most) are found first; every task starts from them, so that tasks return few
documents beyond the result. They only save work: equal scores stay, and the result is exact.

A document's score sums ``w * ((10^9 * tf) div (1000 * tf + 20 * m))`` over the query's terms, with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
``m = 50 + (50 * n * N) div L``: N documents with a term, L terms in all, n terms of the document, df documents with the term, tf its occurrences.

Defined cases: null or empty text has no terms and is never found; rows that repeat an id are documents of their own; a null id comes after all
others of the same score; queries equal in id and text are one query, queries without terms give no rows; equal scores go by
ascending id; empty tables give no rows; other columns are ignored. Ids of documents are 64-bit integers, the largest of which stands for null.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.shared import table_of_rows, written
from quayside.llm.words import pieces

SEGMENT_DOCS = 8192  # documents of a segment at most
SEGMENT_TERMS = 4_000_000  # a segment ends once it holds so many terms
BLOCK_TERMS = 200_000  # terms of the queries that are searched for together, on average
SEEDS = 64  # segments that give the first thresholds, or a sixteenth of all if that is less
_NULL = np.iinfo(np.int64).max
#: separators become spaces, A-Z become lower case; every byte of a character beyond ASCII belongs to a term
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

INDEX = "segment long, n_docs long, n_terms long, ids array<long>, lengths binary, terms string, dfs array<int>, places binary, tfs binary"
IMPACTS = "segment long, ids binary, terms binary, starts binary, places binary, impacts binary, pairs binary, pair_starts binary, pair_places binary, joint binary"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters and digits of ASCII and of all characters beyond it; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


# --- index ----------------------------------------------------------------------------------------


class _Segment:
    """Documents of one segment while it is built."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.counted: list[np.ndarray] = []
        self.size = 0

    def add(self, key: int | None, words: list[bytes]) -> None:
        found, counts = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.counted.append(np.stack([found, np.full(len(found), len(self.ids)), counts]))
        self.ids.append(key)
        self.lengths.append(len(words))
        self.size += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        term, place, tf = np.concatenate(self.counted, axis=1)
        order = np.argsort(term, kind="stable")
        columns = {
            "segment": pa.array([number], pa.int64()),
            "n_docs": pa.array([len(self.ids)], pa.int64()),
            "n_terms": pa.array([self.size], pa.int64()),
            "ids": pa.array([self.ids], pa.list_(pa.int64())),
            "lengths": pa.array([np.array(self.lengths, "<i8").tobytes()], pa.binary()),
            "terms": pa.array([b" ".join(self.numbers).decode("utf-8", "surrogatepass")], pa.string()),
            "dfs": pa.array([np.bincount(term, minlength=len(self.numbers)).astype(np.int32)], pa.list_(pa.int32())),
            "places": pa.array([place[order].astype("<u2").tobytes()], pa.binary()),
            "tfs": pa.array([tf[order].astype("<u4").tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents that have a term, as a table in the shared folder: one row per segment."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, _Segment()
        for batch, texts in pieces(batches, "text"):
            for key, text in zip(batch.column("key").to_pylist(), texts):
                if words := terms(text):
                    open_.add(key, words)
                    if len(open_.ids) == SEGMENT_DOCS or open_.size >= SEGMENT_TERMS:
                        yield open_.row(number)
                        number, open_ = number + 1, _Segment()
        if open_.ids:
            yield open_.row(number)

    plain = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return written(plain.mapInArrow(segments, INDEX), "lexical-index")


# --- queries --------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Segments one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


@dataclass
class Query:
    number: int
    weights: dict[int, int]  # weight of each term that some document holds
    units: list[tuple[int, int | None, int | None]]  # (term, term or None, number of the pair)


@dataclass
class Block:
    """Queries that are searched for together, with the numbers of their terms and pairs."""

    queries: list[Query]
    terms: dict[bytes, int]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # by term
    docs: int
    length: int


def _block(rows: list, df: dict[str, int], docs: int, length: int) -> Block:
    names = sorted({r["term"] for r in rows if df.get(r["term"])})
    number = {t: i for i, t in enumerate(names)}
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) for t in names], np.int64)
    held: dict[int, list[int]] = defaultdict(list)
    for r in rows:
        if r["term"] in number:
            held[r["query"]].append(number[r["term"]])
    pairs: dict[tuple[int, int], int] = {}
    queries = []
    for q, own in sorted(held.items()):
        own.sort(key=lambda t: (-weights[t], t))
        units: list[tuple[int, int | None, int | None]] = [(*sorted(two), pairs.setdefault(tuple(sorted(two)), len(pairs))) for two in zip(own[::2], own[1::2])]
        if len(own) % 2:
            units.append((own[-1], None, None))
        queries.append(Query(q, {t: int(weights[t]) for t in own}, units))
    return Block(queries, {t.encode("utf-8", "surrogatepass"): i for t, i in number.items()}, list(pairs), weights, docs, length)


def _impacts(block: Block, row: dict) -> dict:
    """Impacts of the block's terms in one segment, and the lists of its pairs."""
    lengths, dfs = np.frombuffer(row["lengths"], "<i8"), row["dfs"]
    places, tfs = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["tfs"], "<u4")
    ends = np.cumsum(dfs)
    norm = 20 * (50 + (50 * lengths * block.docs) // block.length)
    mine: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at, term in enumerate(row["terms"].encode("utf-8", "surrogatepass").split(b" ")):
        if (t := block.terms.get(term)) is not None:
            low, high = ends[at] - dfs[at], ends[at]
            tf = tfs[low:high].astype(np.int64)
            mine[t] = places[low:high], block.weights[t] * ((1_000_000_000 * tf) // (1000 * tf + norm[places[low:high]]))
    lists, joint = {}, {}
    for p, (a, b) in enumerate(block.pairs):
        if a in mine and b in mine:
            both, i, j = np.intersect1d(mine[a][0], mine[b][0], assume_unique=True, return_indices=True)
            if len(both):
                lists[p], joint[p] = both, int((mine[a][1][i] + mine[b][1][j]).max())
    found = sorted(mine)
    starts = lambda sizes: np.cumsum([0, *sizes]).astype("<i4").tobytes()
    whole = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes() if parts else b""
    return {
        "segment": row["segment"],
        "ids": np.array([_NULL if i is None else i for i in row["ids"]], "<i8").tobytes(),
        "terms": np.array(found, "<i4").tobytes(),
        "starts": starts([len(mine[t][0]) for t in found]),
        "places": whole([mine[t][0] for t in found], "<u2"),
        "impacts": whole([mine[t][1] for t in found], "<i8"),
        "pairs": np.array(list(lists), "<i4").tobytes(),
        "pair_starts": starts([len(x) for x in lists.values()]),
        "pair_places": whole(list(lists.values()), "<u2"),
        "joint": np.array(list(joint.values()), "<i8").tobytes(),
    }


class _Lists:
    """Lists of one segment as they are searched."""

    def __init__(self, row: dict):
        def cut(keys, starts, *values):
            starts = np.frombuffer(row[starts], "<i4").tolist()
            return {k: tuple(v[a:b] for v in values) for k, a, b in zip(np.frombuffer(row[keys], "<i4").tolist(), starts, starts[1:])}

        self.ids = np.frombuffer(row["ids"], "<i8")
        self.terms = cut("terms", "starts", np.frombuffer(row["places"], "<u2"), np.frombuffer(row["impacts"], "<i8"))
        self.pairs = {k: v[0] for k, v in cut("pairs", "pair_starts", np.frombuffer(row["pair_places"], "<u2")).items()}
        self.joint = dict(zip(self.pairs, np.frombuffer(row["joint"], "<i8").tolist()))
        self.top = {t: int(impacts.max()) for t, (_, impacts) in self.terms.items()}

    def bound(self, a: int, b: int | None, pair: int | None) -> int:
        """Most that a document can gain from the two terms: the joint maximum, or that of one term alone."""
        return max(self.top.get(a, 0), self.top.get(b, 0), self.joint.get(pair, 0))

    def gain(self, places: np.ndarray, term: int) -> np.ndarray | int:
        """Impacts of a term in the documents at ``places`` (ascending)."""
        if term not in self.terms:
            return 0
        held, impacts = self.terms[term]
        at = np.minimum(np.searchsorted(held, places), len(held) - 1)
        return np.where(held[at] == places, impacts[at], 0)


def best_of(lists: _Lists, query: Query, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents of a segment that can be among the best k and score ``least`` or more."""
    units = [(bound, *unit) for unit in query.units if (bound := lists.bound(*unit))]
    units.sort(key=lambda u: (-u[0], u[1]))
    rest = np.cumsum([0] + [u[0] for u in reversed(units)])[::-1].tolist()  # bounds of the units from the i-th on
    none = np.zeros(0, np.uint16), np.zeros(0, np.int64)
    if not units or rest[0] < least:
        return none
    both = [lists.pairs[pair] for _, _, _, pair in units if pair in lists.pairs]
    if both and len(lists.ids) > k:  # documents with both terms of the best pairs, scored whole, raise the least score
        first = np.zeros(0, np.uint16)
        for own in both:
            first = np.union1d(first, own[: 2 * k])
            if len(first) >= k:
                score = sum(lists.gain(first, t) for t in query.weights)
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
                break
    score, done = np.zeros(len(lists.ids), np.int64), 0
    while done < len(units) and rest[done] >= least:
        for t in units[done][1:3]:
            if t in lists.terms:
                places, impacts = lists.terms[t]
                score[places] += impacts
        done += 1
        if len(score) > k and done & (done - 1) == 0:
            least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
    places = np.flatnonzero((score > 0) & (score + rest[done] >= least)).astype(np.uint16)
    score = score[places]
    for i in range(done, len(units)):
        score = score + sum(lists.gain(places, t) for t in units[i][1:3])
        stays = score + rest[i + 1] >= least
        places, score = places[stays], score[stays]
    return places, score


def _searched(block: Block, k: int, least: dict[int, int]):
    """Function for ``mapInArrow`` on segments: the best k documents of the task for each query, as (query, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q.number: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q in block.queries}
        floor = {q.number: max(1, least.get(q.number, 1)) for q in block.queries}
        for row in _rows(batches):
            lists = _Lists(row)
            for query in block.queries:
                places, score = best_of(lists, query, floor[query.number], k)
                if len(places):
                    ids, had = best[query.number]
                    ids, score = np.concatenate([ids, lists.ids[places]]), np.concatenate([had, score])
                    order = np.lexsort((ids, -score))[:k]
                    best[query.number] = ids[order], score[order]
                    if len(order) == k:
                        floor[query.number] = max(floor[query.number], int(score[order[-1]]))
        for q, (ids, score) in best.items():
            if len(ids):
                columns = [pa.array(np.full(len(ids), q, np.int64)), pa.array(ids, mask=ids == _NULL), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query: (id_col, rank, doc_id, score)."""
    spark = index.sparkSession
    asked = written(queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct(), "queries")
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries-numbered")

    def split(batches):
        for batch, texts in pieces(batches, "text"):
            rows = [(q, t.decode("utf-8", "surrogatepass")) for q, text in zip(batch.column("query").to_pylist(), texts) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["query", "term"])

    wanted = written(asked.select("query", "text").mapInArrow(split, "query long, term string"), "query-terms")
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms"), F.count(F.lit(1)).alias("segments")).first()
    blocks = -(-wanted.count() // BLOCK_TERMS)
    none = spark.createDataFrame([], "query long, doc_id long, score long, rank int")
    results = [] if totals["docs"] and blocks else [none]
    for b in range(blocks if totals["docs"] else 0):
        rows = wanted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        names = table_of_rows(spark, sorted({(r["term"],) for r in rows}), "term string")
        held = index.select(F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("dfs").alias("df"))).alias("t")).select("t.*")
        df = {r["term"]: r["df"] for r in held.join(F.broadcast(names), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        plan = spark.sparkContext.broadcast(_block(rows, df, totals["docs"], totals["terms"]))

        def impacts(batches, plan=plan):
            for row in _rows(batches):
                yield pa.RecordBatch.from_pylist([_impacts(plan.value, row)])

        lists = written(index.mapInArrow(impacts, IMPACTS), "impacts")
        seeds = min(SEEDS, -(-totals["segments"] // 16))
        spread = F.pmod(F.xxhash64("segment"), F.lit(1 << 30))
        chosen = lists.where(spread < int((1 << 30) * min(1.0, 2 * seeds / totals["segments"])))

        def found(some, least, plan=plan):
            def run(batches):
                yield from _searched(plan.value, k, least)(batches)

            return written(_top(some.mapInArrow(run, "query long, doc_id long, score long"), k), "found")

        least = {r["query"]: r["score"] for r in found(chosen, {}).where(F.col("rank") == k).select("query", "score").collect()}
        results.append(found(lists, least))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return asked.select("query", F.col("id").alias(id_col)).join(out, "query").select(id_col, "rank", "doc_id", "score")
