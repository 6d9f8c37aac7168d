"""Best-fit packing: which lengths share a sequence is solved as a configuration linear program over the histogram of lengths.

Documents are tokens and one end id. One longer than a sequence is cut into whole sequences, of which the first may be shorter; all other
documents stay in one piece. A configuration is a multiset of lengths that fits a sequence; the program asks for the least number of
configurations that hold the pieces of every length. It has a row for each length (at most ``length`` of them) whatever the data,
so it is solved on the driver:

* multiplicative weights: in each phase every length is to be served a further share of its pieces; a length's weight, its price,
  falls as it runs ahead of that and rises as it lags. Configurations are priced by the knapsack program over the weights, which gives for every length
  the most valuable configuration that holds it. Weights divided by the most valuable configuration of all are a solution
  of the dual program, so every pricing also bounds the number of sequences from below (``Packing.bound``).
* rounding: whole multiples of the configurations, then single ones that leave no gap. What is left, less than one multiple of
  each configuration, is solved again or put in piece by piece by best fit, whichever gives fewer sequences. Where
  a table has few pieces of each length, most amounts are below one and best fit does most of the work.

Tokens are counted once and written piece by piece with the number that a piece has among those of its length in its task. Running counts per
(task, length) make these the numbers among all pieces of the length, and the packing maps a length and a number to a sequence and an offset:
no pieces meet in one place, so that equal lengths may be any share of all rows. A packing holds at most
``PHASES * PRICINGS`` configurations for each length and round besides the rest, far fewer in practice: a broadcast bounded by constants.

Ids are those of the ``tokenizers`` file; byte-level files are encoded by ``tiktoken`` with the ranks read from that file, which gives the same ids four times as
fast (a test compares them).

Defined cases: null or empty text is only the end id; repeated rows and null ids are packed like others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.shared import written
from quayside.llm.words import pieces as portions

PHASES = 8  # phases of the multiplicative weights
PRICINGS = 16  # pricings in a phase
STEP = 0.1  # how far the weight of a length moves when it is one share ahead or behind
SPENT = (0.5, 0.8)  # the program is solved with each of these, and the packing with fewer sequences is kept
ROUNDS = 4  # the pieces that rounding leaves are solved again so many times at most
MOST_LEFT = 200_000  # pieces that best fit is tried on before the last round
_PLACES = 1 << 40  # more than the pieces of one length


# --- tokens ---------------------------------------------------------------------------------------


def _bytes_of_marks() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its Latin-1 character where that is printable, the others as characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteEncoder:
    """Ids of whole texts by a byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        marks = _bytes_of_marks()
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(map(marks.__getitem__, token)): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def ids(self, text: str | None) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text or "", allowed_special=self.special, disallowed_special=())
        except ValueError:  # its pattern matcher gives up on white space runs of some 10^5 characters
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(name: str) -> ByteEncoder:
    """One encoder for each worker process."""
    import public_tokenizers

    if name not in _ENCODERS:
        _ENCODERS[name] = ByteEncoder(public_tokenizers.path(name), public_tokenizers.PATTERN)
    return _ENCODERS[name]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n - (n - 1) // length * length
    return [(0, first), *((at, length) for at in range(first, n, length))]


# --- the program ----------------------------------------------------------------------------------


@dataclass
class Packing:
    """Configurations and how many sequences have each. A configuration lists (length, times), longest first."""

    length: int
    bound: int  # no packing has fewer sequences
    configurations: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(copies for _, copies in self.configurations)

    def places(self) -> np.ndarray:
        """Rows (length * _PLACES + first number, first sequence, times, offset) in ascending order: the configuration that holds the numbers from there on."""
        rows, numbers, sequence = [], {}, 0
        for parts, copies in self.configurations:
            at = 0
            for length, times in parts:
                number = numbers.get(length, 0)
                rows.append((length * _PLACES + number, sequence, times, at))
                numbers[length] = number + copies * times
                at += length * times
            sequence += copies
        return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _price(lengths: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, list[int]]:
    """Knapsack: the most value that fits each capacity, and the index of a length of it (-1: nothing more)."""
    value, taken = np.zeros(size + 1), [-1] * (size + 1)
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right").tolist()
    for room in range(1, size + 1):
        value[room], taken[room] = value[room - 1], -2
        if n := upto[room]:
            with_one = value[room - lengths[:n]] + weights[:n]
            best = int(with_one.argmax())
            if with_one[best] > value[room]:
                value[room], taken[room] = with_one[best], best
    return value, taken


def _filled(first: int, lengths: list[int], taken: list[int], size: int) -> tuple[int, ...]:
    """Indices of the most valuable configuration that holds the length of index ``first``."""
    own, room = [first], size - lengths[first]
    while room > 0 and taken[room] != -1:
        if taken[room] == -2:
            room -= 1
        else:
            own.append(taken[room])
            room -= lengths[taken[room]]
    return tuple(sorted(own, reverse=True))


def fractional(histogram: dict[int, int], size: int, spent: float) -> tuple[dict[tuple[int, ...], float], int]:
    """Configurations (indices into the ascending lengths) with their amounts, and the lower bound of the dual program.

    ``spent`` scales the weight of a length that has had its share of the phase: it still fills gaps, but costs its worth in later phases."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], float)
    share, served, amounts, bound = counts / PHASES, np.zeros(len(counts)), {}, 0.0
    plain = lengths.tolist()
    for phase in range(1, PHASES + 1):
        for pricing in range(1, PRICINGS + 1):
            lacking = share * phase - served
            open_ = lacking > 1e-9 * counts
            if not open_.any():
                break
            weights = lengths / size * np.exp(STEP * np.clip(lacking / share, -4, 4)) * np.where(open_, 1.0, spent)
            value, taken = _price(lengths, weights, size)
            bound = max(bound, float(counts @ weights) / value[size])
            for i in np.flatnonzero(open_)[::-1].tolist():
                if lacking[i] <= 1e-9 * counts[i]:
                    continue
                own = _filled(i, plain, taken, size)
                times = Counter(own)
                # as much as all its lengths lack; what is still open at the end of a phase is served whatever else comes with it
                amount = min(lacking[j] / k for j, k in times.items()) if pricing < PRICINGS else lacking[i] / times[i]
                if amount > 1e-9:
                    amounts[own] = amounts.get(own, 0.0) + amount
                    for j, k in times.items():
                        served[j] += amount * k
                        lacking[j] -= amount * k
    return amounts, int(np.ceil(bound - 1e-6))


def _best_fit(left: dict[int, int], size: int) -> list[list[int]]:
    """Pieces one by one, longest first, each where it leaves the least room."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            i = bisect_left(free, (n, -1))
            room, number = free.pop(i) if i < len(free) else (size, len(bins))
            if number == len(bins):
                bins.append([])
            bins[number].append(n)
            insort(free, (room - n, number))
    return bins


class _Rounding:
    """Pieces still left, and the configurations taken so far."""

    def __init__(self, left: dict[int, int], size: int):
        self.left, self.size = dict(left), size
        self.taken: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(self, own: list[int], most: int) -> int:
        times = Counter(own)
        copies = min(most, min(self.left.get(n, 0) // k for n, k in times.items()))
        if copies > 0:
            self.taken.append((tuple(sorted(times.items(), reverse=True)), copies))
            for n, k in times.items():
                self.left[n] -= copies * k
                if not self.left[n]:
                    del self.left[n]
        return max(copies, 0)

    def finished(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        """The configurations with the pieces that are left put in by best fit."""
        rest = Counter(tuple(sorted(Counter(own).items(), reverse=True)) for own in _best_fit(self.left, self.size))
        return self.taken + list(rest.items())


def solve(histogram: dict[int, int], size: int) -> Packing:
    """A packing of ``histogram[length]`` pieces of each length into sequences of ``size``."""
    small = {n: c for n, c in histogram.items() if c and n < size}
    whole = histogram.get(size, 0)
    best, bound = None, 0
    for spent in SPENT if small else ():
        state = _Rounding(small, size)
        for _ in range(ROUNDS):
            plain = sorted(state.left)
            amounts, least = fractional(state.left, size, spent)
            bound = max(bound, least) if len(plain) == len(small) and not state.taken else bound
            # fullest first, then by amount: whole multiples, then single ones that leave no gap
            order = sorted((-sum(plain[i] for i in own), -amount, [plain[i] for i in own]) for own, amount in amounts.items())
            for some in ([(own, int(-amount)) for _, amount, own in order if amount <= -1], [(own, 1) for gap, _, own in order if gap == -size]):
                got = sum(state.take(own, most) for own, most in some)
                if sum(state.left.values()) <= MOST_LEFT:
                    done = state.finished()
                    if best is None or sum(c for _, c in done) < sum(c for _, c in best):
                        best = done
            if not state.left or not got:
                break
        best = best or state.finished()
    return Packing(size, bound + whole, (best or []) + ([(((size, 1),), whole)] if whole else []))


# --- documents ------------------------------------------------------------------------------------


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, sequence_id, offset and its ids (unsigned little-endian 32-bit).

    ``tokenizer`` is a file name of the public tokenizers; their folder is looked up on each executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        numbers = np.zeros(length + 1, np.int64)
        for batch, texts in portions(batches, "text"):
            rows, piece, start, size, number, ids = [], [], [], [], [], []
            for row, text in enumerate(texts):
                own = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4")
                for i, (at, n) in enumerate(cuts(len(own), length)):
                    rows.append(row)
                    piece.append(i)
                    start.append(at)
                    size.append(n)
                    number.append(int(numbers[n]))
                    numbers[n] += 1
                    ids.append(own[at : at + n].tobytes())
            columns = [batch.column("key").take(pa.array(rows, pa.int64())), pa.array([part] * len(rows), pa.int32()), pa.array(piece, pa.int32())]
            columns += [pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(number, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "part", "piece", "start", "n", "number", "ids"])

    plain = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    held = written(plain.mapInArrow(tokens, f"key {kind}, part int, piece int, start long, n long, number long, ids binary"), "pieces")
    by_part = written(held.groupBy("part", "n").agg(F.count(F.lit(1)).alias("pieces")), "piece-counts")
    histogram = {r["n"]: r["pieces"] for r in by_part.groupBy("n").agg(F.sum("pieces").alias("pieces")).collect()}  # at most ``length`` rows
    before = F.sum("pieces").over(W.partitionBy("n").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = written(by_part.select("part", "n", F.coalesce(before, F.lit(0)).alias("base")), "piece-bases")
    places = docs.sparkSession.sparkContext.broadcast(solve(histogram, length).places())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, times, offset = places.value.T
        for batch in batches:
            n, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "number"))
            at = np.searchsorted(first, n * _PLACES + number, side="right") - 1
            turn = n * _PLACES + number - first[at]
            columns = [pa.array(sequence[at] + turn // times[at]), pa.array(offset[at] + turn % times[at] * n)]
            own = ["key", "piece", "start", "n", "ids"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + columns, [*own, "sequence_id", "offset"])

    numbered = held.join(bases, ["part", "n"]).withColumn("number", F.col("base") + F.col("number"))
    out = numbered.select("key", "piece", "start", "n", "number", "ids").mapInArrow(place, f"key {kind}, piece int, start long, n long, ids binary, sequence_id long, offset long")
    return out.select(F.col("key").alias(id_col), "piece", "start", F.col("n").alias("length"), "sequence_id", "offset", "ids")
