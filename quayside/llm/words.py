"""Words and shingle hashes of whole texts, for the operators that work on word shingles inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULTIPLIER = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BLOCK = 1 << 18  # characters that are hashed together
_TABLES: dict[str, np.ndarray] = {}


def _word_points() -> np.ndarray:
    """Which code points are word characters: letters, digits and the underscore."""
    if "word" not in _TABLES:
        _TABLES["word"] = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
    return _TABLES["word"]


def _hash_block(values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of word characters: differences of running sums, without a loop over words.

    A character is mixed together with its place in the word before it is summed. Sums of powers, whatever their base, are equal
    modulo 2**64 for some words of 1024 letters.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    stops = np.cumsum(lengths)
    places = np.arange(stops[-1] if len(stops) else 0, dtype=np.int64) - np.repeat(stops - lengths, lengths)
    placed = mix(values[inside].astype(U64) + U64(1) + (places.astype(U64) << U64(21)))  # code points have 21 bits
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(placed, dtype=U64)))
    return starts, mix(sums[stops] - sums[stops - lengths] + lengths.astype(U64))


def _cut(data, pattern) -> list:
    """A long text in blocks that end between words."""
    out, at = [], 0
    while len(data) - at > _BLOCK:
        found = pattern.search(data, at + _BLOCK)
        stop = found.end() if found else len(data)
        out.append(data[at:stop])
        at = stop
    return [*out, data[at:]]


def word_hashes(texts: list[str | None], words: str) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order.

    ``words`` is "space": runs of anything but white space (code points 9 to 13 and 32), A-Z in lower case; or
    "letters": runs of letters, digits and underscores of the text in lower case.
    """
    if words == "space":
        ready = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
        gap, pattern = b"\n", re.compile(rb"[\x20\x09-\x0d]")
    else:
        ready = [t.lower() if t else "" for t in texts]
        gap, pattern = "\n", re.compile(r"\W")
    out: list[np.ndarray] = []
    group: list = []

    def hashed(data):
        if words == "space":
            values = np.frombuffer(data, np.uint8)
            return _hash_block(values, ~((values == 32) | ((values >= 9) & (values <= 13))))
        values = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        return _hash_block(values, _word_points()[values])

    def flush():
        if group:
            starts, found = hashed(gap.join(group))
            ends = np.cumsum([len(x) + 1 for x in group])
            out.extend(np.split(found, np.searchsorted(starts, ends[:-1])))
            group.clear()

    size = 0
    for data in ready:
        if size + len(data) > _BLOCK:
            flush()
            size = 0
        if len(data) > _BLOCK:
            out.append(np.concatenate([hashed(x)[1] for x in _cut(data, pattern)]))
        else:
            group.append(data)
            size += len(data)
    flush()
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; empty when there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out = out * _MULTIPLIER + hashes[i : i + n]
    return mix(out)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """As ``windows``, but a shorter sequence is one shingle as a whole."""
    return windows(hashes, min(width, len(hashes))) if len(hashes) else np.zeros(0, U64)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches and their texts, cut so that one holds about ``most_chars`` bytes, or a single longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = sizes.cumsum() // most_chars
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                part = batch.slice(low, high - low)
                yield part, part.column(column).to_pylist()
