"""Mixture-controlled packing: source queues served by deficit round-robin into windows of token sequences.

Every source is a queue of its documents' tokens (ids, then one end id). A window is ``window_sequences``
sequences. In each window every queue is served its share of the window's tokens; what a queue is owed or
has had in excess of its exact share (always less than two tokens) is its deficit, which carries into the next
window. Because the deficits after any number of windows follow from the running totals of the shares in
whole numbers, every partition knows the deficits at which it starts: they carry across partitions without
partitions waiting for each other. Targets default to the sources' own shares, so all queues end together;
with given ``targets`` a queue that runs dry leaves its share to the others in proportion, and the next phase
carries on at the very next token.

Sequences hold exactly ``length`` tokens; the rest at the end is cut into powers of two, so nothing is
padded. Documents are cut at queue turns and sequence ends and nowhere else.

Tokens are counted once and kept as a table; then one row per (input partition, source) gives each partition its place in the queues, and the pieces
follow partition by partition. No document moves to another task unless those rows are too many to broadcast, when Spark joins by a shuffle.

Sources that hold less than two tokens of a window, and all beyond the ``MOST_QUEUES`` largest, share one queue; a source that ``targets`` names has its
own, however small.

Defined cases: null or empty text is only the end id; a null source is a source of its own; repeated rows and null ids
are packed like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.shared import written
from quayside.llm.words import pieces

MOST_QUEUES = 1000
MOST_WORDS = 500_000  # words whose ids a worker remembers
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts by a public tokenizer that folds case and drops white space, so that words can be encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}

    def _core(self, core: str) -> bytes:
        """Ids of letters without marks: the model is asked directly, which is several times faster than the whole tokenizer."""
        runs = [core] if core.isascii() else [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(core)]
        return np.array([t.id for run in runs for t in self.tokenizer.model.tokenize(run)], self.kind).tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.cores) > MOST_WORDS:
            self.cores = {"": b""}
        cores, plain = self.cores, []
        for word in words:
            core = word.rstrip(_MARKS)
            if core.isalpha() and _latin1(core):
                low, marks = core.lower(), word[len(core) :]
                if (ids := cores.get(low)) is None:
                    ids = cores[low] = self._core(low)
                if marks and marks not in cores:
                    cores[marks] = self._whole([marks])[0]
                self.words[word] = ids + cores[marks]
            else:
                plain.append(word)
        for at in range(0, len(plain), 10_000):
            some = plain[at : at + 10_000]
            self.words.update(zip(some, self._whole(some)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.words
        # case does not matter to the tokenizer; Python folds it alike for the Latin-1 letters
        folded = (text.lower() if _latin1(text) else text for text in (text or "" for text in texts))
        split = [text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in folded]
        missing = {w for words in split for w in words if w not in known}
        whole = len(missing) <= MOST_WORDS // 2
        if whole:
            if len(known) + len(missing) > MOST_WORDS:
                known.clear()
                missing = {w for words in split for w in words}
                whole = len(missing) <= MOST_WORDS // 2
            if whole and missing:
                self._learn(missing)
        for words in split:  # a portion with more different words than are remembered goes word by word
            yield b"".join(map(known.__getitem__ if whole else self._one, words))

    def _one(self, word: str) -> bytes:
        if word not in self.words:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            self._learn({word})
        return self.words[word]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass
class Plan:
    """Where the tokens of each queue go. Positions count all tokens in packing order."""

    phases: list[list[int]]  # tokens that each queue gives in each phase
    window: int
    length: int

    def __post_init__(self):
        queues = len(self.phases[0]) if self.phases else 0
        self.given = [[sum(p[k] for p in self.phases[:i]) for k in range(queues)] for i in range(len(self.phases))]
        self.upto = [[sum(p[: k + 1]) for k in range(queues)] for p in self.phases]
        self.begin = [sum(map(sum, self.phases[:i])) for i in range(len(self.phases))]
        self.total = sum(map(sum, self.phases))
        whole = self.total // self.length
        self.ends, at = [], whole * self.length
        for bit in reversed(range(self.length.bit_length())):
            if (self.total - whole * self.length) >> bit & 1:
                at += 1 << bit
                self.ends.append(at)
        self.whole = whole

    def served(self, phase: int, queue: int, at: int) -> int:
        """Tokens that the queues up to this one have given in the phase's first ``at`` positions."""
        return at * self.upto[phase][queue] // self.upto[phase][-1] if queue >= 0 else 0

    def sequence(self, at: int) -> tuple[int, int, int]:
        """Sequence of a position, its first position and its end."""
        if at < self.whole * self.length:
            n = at // self.length
            return n, n * self.length, (n + 1) * self.length
        i = next(i for i, end in enumerate(self.ends) if at < end)
        return self.whole + i, self.ends[i - 1] if i else self.whole * self.length, self.ends[i]

    def pieces(self, queue: int, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of n tokens that begin at place ``first`` of their queue."""
        for p, tokens in enumerate(self.phases):
            low, high = max(first, self.given[p][queue]), min(first + n, self.given[p][queue] + tokens[queue])
            if low >= high:
                continue
            size, base = self.upto[p][-1], self.given[p][queue]
            edge = lambda w, b=self.begin[p], s=size: min(max(0, w * self.window - b), s)
            had = lambda at, p=p: self.served(p, queue, at) - self.served(p, queue - 1, at)
            w = max(0, (self.begin[p] + (low - base) * size // tokens[queue]) // self.window - 1)
            while had(edge(w + 1)) <= low - base:
                w += 1
            while low < high:
                here, there = edge(w), edge(w + 1)
                stop = min(high, base + had(there))
                turn = self.served(p, queue - 1, there) - self.served(p, queue - 1, here)  # tokens of the queues served before
                at = self.begin[p] + here + turn + low - base - had(here)
                while low < stop:
                    sequence, start, end = self.sequence(at)
                    take = min(stop - low, end - at)
                    yield low - first, take, sequence, at - start
                    low, at = low + take, at + take
                w += 1


def phases(tokens: list[int], weights: list[float] | None) -> list[list[int]]:
    """How many tokens each queue gives until the next one runs dry; by the queues' own shares there is one phase."""
    if not sum(tokens):
        return []
    if weights is None:
        return [list(tokens)]
    rest, out = list(tokens), []
    while sum(rest):
        live = [Fraction(w).limit_denominator(10**9) if r else Fraction(0) for w, r in zip(weights, rest)]
        if not sum(live):
            live = [Fraction(r) for r in rest]
        most = min(r / w for r, w in zip(rest, live) if w)
        given = [min(r, int(most * w)) if w else 0 for r, w in zip(rest, live)]
        if not sum(given):  # less than a token each: the rest goes out as it is
            given = list(rest)
        out.append(given)
        rest = [r - g for r, g in zip(rest, given)]
    return out


def _queues(sources: DataFrame, window: int, targets: dict[str, float] | None) -> tuple[list[str], list[int]]:
    """Names of the queues of their own, and the tokens of these and of the shared last queue. A source that ``targets`` names always has its own."""
    total = sources.agg(F.sum("n")).first()[0] or 0
    wanted = [f"={s}" for s in targets or {}]
    large = [(r["source"], r["n"]) for r in sources.orderBy(F.desc("n"), "source").limit(MOST_QUEUES).collect() if r["n"] * window >= 2 * total and r["source"] not in wanted]
    chosen = [(r["source"], r["n"]) for r in sources.where(F.col("source").isin(wanted)).orderBy(F.desc("n"), "source").collect()] if wanted else []
    rest = total - sum(n for _, n in large + chosen)
    if large and 0 < rest * window < 2 * total:
        rest += large.pop()[1]
    named = chosen + large
    return [s for s, _ in named], [n for _, n in named] + [rest]


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, window_sequences: int = 16, targets: dict[str, float] | None = None,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset and its ids (unsigned little-endian 32-bit).

    ``tokenizer`` is a file name of the public tokenizers; their folder is looked up on each executor.
    ``targets`` maps sources to weights; sources it does not name come after them.
    """
    spark, window = docs.sparkSession, length * window_sequences
    kind = docs.schema[id_col].dataType.simpleString()

    def tokens(batches):
        import public_tokenizers

        enc, part, place = encoder(public_tokenizers.path(tokenizer)), TaskContext.get().partitionId(), {}
        end = np.array([end_id], enc.kind).tobytes()
        for batch, texts in pieces(batches, "text"):
            sources = batch.column("source").to_pylist()
            starts, counts, ids = [], [], []
            for source, own in zip(sources, enc.ids(texts)):
                own += end
                n = len(own) // enc.kind.itemsize
                starts.append(place.get(source, 0))
                place[source] = starts[-1] + n
                counts.append(n)
                ids.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                ["key", "source", "part", "start", "n", "ids"],
            )

    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    plain = docs.select(F.col(id_col).alias("key"), source.alias("source"), F.col(text_col).alias("text"))
    counted = written(plain.mapInArrow(tokens, f"key {kind}, source string, part int, start long, n long, ids binary"), "tokens")
    parts = written(counted.groupBy("part", "source").agg(F.sum("n").alias("n")), "part-tokens")
    names, sizes = _queues(parts.groupBy("source").agg(F.sum("n").alias("n")), window, targets)
    weights = None if targets is None else [targets.get(s[1:], 0.0) if s != "null" else 0.0 for s in names] + [0.0]
    plan = Plan(phases(sizes, weights), window, length)
    numbers = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, queue int")
    queued = parts.join(F.broadcast(numbers), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    # running sums over the partitions of a queue, then over the sources that share the queue within a partition
    by_part = queued.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    so_far = F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("queue", "part").orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = queued.withColumn("inside", inside).join(by_part.select("queue", "part", so_far.alias("before")), ["queue", "part"])
    bases = written(bases.select("part", "source", "queue", (F.col("before") + F.col("inside")).alias("base")), "queue-places")

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            rows = []
            for i, (queue, first, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("queue", "first", "n", "ids")))):
                size = len(ids) // n
                for start, take, sequence, offset in plan.pieces(queue, first, n):
                    own = ids[start * size : (start + take) * size]
                    own = own if size == 4 else np.frombuffer(own, "<u2").astype("<u4").tobytes()
                    rows.append(i)
                    for column, v in zip(out, (start, take, n, sequence, offset, own)):
                        column.append(v)
            columns = [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 5 + [pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *columns], ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = counted.join(bases, ["part", "source"]).select("key", "queue", (F.col("base") + F.col("start")).alias("first"), "n", "ids")
    out = placed.mapInArrow(cut, f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("key", id_col)
