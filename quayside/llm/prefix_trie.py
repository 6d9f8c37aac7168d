"""Prefix trie of conversations from sorted sequences: intervals by range minima over the common prefixes of neighbours.

A conversation is the sequence of keys of its turns (a 128-bit digest of role and text). Equal conversations are counted first, then the
different ones are sorted over all tasks. In sorted order the conversations that start with a prefix are one
interval: around any of them as far as neighbours share at least that many turns (the LCP array). A task reads its rows in blocks. For every
candidate prefix of a block, left and right extents are found independently of all others, each by binary search in a sparse table of LCP minima:
all candidates take the same few steps, without a stack and whatever their depth. Intervals give members, smallest ids (a second sparse
table), parents (left extent of the prefix one turn shorter) and, as nodes are listed in preorder, sums over subtrees by differences of running sums.

Only prefixes of the first and the last conversation of a block can go on in its neighbours. They are handed on as rows of two paths per block
and put together in order of the blocks by one pass that holds a single path, the only work that is not split: it reads two paths for each
``BLOCK_ROWS`` conversations. Every other node is final in its task; where its parent goes on, it takes the parent's name by a join on the block.

The ids of the conversations that end in a node are digested in order: sorted over all tasks, joined to text in parts, and the parts of a node
run through one digest, so that no list of ids is held.

Defined cases: null role or text is empty; turns sort by number (null first), then role and text; turns without a conversation id are ignored; an id
without turns does not exist; an empty table gives no rows, not even a root; other columns are ignored. The turns of one conversation meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.shared import text_of, written

BLOCK_ROWS = 100_000  # different conversations of a block at most
BLOCK_TURNS = 2_000_000  # a block ends once it holds so many turns
NOBODY = hashlib.sha256(b"").hexdigest()  # digest of no ids
_KEY = 16  # bytes of a turn's key

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"
_BLOCK_NODE = f"block long, side int, parent_side int, parent_depth long, key binary, chars long, {_NODE}"
_MERGED = f"block long, side int, uid long, parent_uid long, {_NODE}"


# --- conversations --------------------------------------------------------------------------------


def turn_lists(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): the keys and lengths of each conversation's turns in order, as a table."""
    role, text = text_of(role_col), text_of(text_col)
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))
    ordered = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(key(t).alias("key"), F.length(t["text"]).cast("long").alias("chars")))
    own = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv")).agg(ordered.alias("turns"))
    return written(own, "turn-lists")


def shared_openings(talks: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Every conversation rebuilt: the first h turns of the conversation whose id is the next lower multiple of ``every``, then its own
    turns after its first h; h is the CRC-32 of its decimal id modulo ``most``."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    first = talks.where(F.col("conv") % every == 0).select(F.col("conv").alias("opening"), F.slice("turns", 1, most).alias("head"))
    none = F.array().cast(talks.schema["turns"].dataType)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    both = talks.withColumn("opening", F.col("conv") - F.col("conv") % every).join(first, "opening", "left")
    return both.select("conv", F.concat(F.coalesce(F.slice("head", F.lit(1), h), none), own).alias("turns"))


def _paths(talks: DataFrame) -> DataFrame:
    """(conv, path, chars, seq): keys as one binary, lengths, and a digest that stands for the sequence."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = talks.select("conv", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    return written(rows.withColumn("seq", F.md5("path")), "paths")


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    values = column.to_pylist()
    cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def id_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending decimal ids of each ``seq`` of ``members(seq, conv)``, joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, conv = batch.column("seq"), batch.column("conv").to_pylist()
            runs = _runs(seq)
            texts = [",".join(map(str, conv[a:b])) for a, b in runs]
            yield pa.RecordBatch.from_arrays([seq.take(pa.array([a for a, _ in runs], pa.int64())), pa.array([conv[a] for a, _ in runs], pa.int64()), pa.array(texts, pa.string())], ["seq", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[str, str]] = []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
                if seq != last:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = seq, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["seq", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["seq", "ends"])

    parts = members.repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(joined, "seq string, first long, ids string")
    return parts.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digested, "seq string, ends string")


# --- blocks ---------------------------------------------------------------------------------------


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minimum of every run of 2^k values."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _right(lcp: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last position that shares ``depth`` turns with position ``at``, for all candidates at once."""
    at = at.copy()
    for k in reversed(range(len(lcp))):
        first = at + 1
        fits = first < len(lcp[k])
        at[fits] += np.where(lcp[k][first[fits]] >= depth[fits], 1 << k, 0)
    return at


def _left(lcp: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First position that shares ``depth`` turns with position ``at``, for all candidates at once."""
    at = at.copy()
    for k in reversed(range(len(lcp))):
        first = at - (1 << k) + 1
        fits = first > 0
        at[fits] -= np.where(lcp[k][first[fits]] >= depth[fits], 1 << k, 0)
    return at


def _least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum between two positions, both included."""
    level = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), table[0].dtype)
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(table[k][low[own]], table[k][high[own] - (1 << k) + 1])
    return out


def lcps(keys: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it (0 for the first). ``keys`` has a row per turn."""
    out = np.zeros(len(size), np.int64)
    alive, depth = np.arange(1, len(size)), 0
    while len(alive):
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        alive = alive[(keys[offset[alive] + depth] == keys[offset[alive - 1] + depth]).all(axis=1)]
        out[alive] += 1
        depth += 1
    return out


def block_nodes(paths: list[bytes], chars: np.ndarray, convs: np.ndarray, smallest: np.ndarray, ends: list[str], block: int) -> dict[str, Any]:
    """Nodes of sorted, different sequences as columns of ``_BLOCK_NODE``. Closed nodes are final but for the name of an open parent (``side`` -1); open ones,
    the root and the prefixes of the first (side 0) and of the last sequence (side 1), hold the sums of their closed children."""
    size = np.array([len(p) // _KEY for p in paths], np.int64)
    offset = np.concatenate(([0], np.cumsum(size)))[:-1]
    keys = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    n, lcp = len(paths), lcps(keys, offset, size)
    table, least = _minima(lcp), _minima(smallest)
    start = np.concatenate(([0], np.cumsum(size - lcp)))  # first node of each position
    at = np.repeat(np.arange(n), size - lcp)
    depth = lcp[at] + 1 + np.arange(len(at)) - start[at]
    low, high = _left(table, at, depth), _right(table, at, depth)
    so_far = np.concatenate(([0], np.cumsum(convs)))
    members, name = so_far[high + 1] - so_far[low], _least(least, low, high)
    # the parent one turn up was listed right before, or is the prefix shared with the sequence before: found by its own left extent
    parent = np.arange(len(at)) - 1
    top = np.flatnonzero(depth == lcp[at] + 1)
    up = _left(table, at[top], depth[top] - 1)
    parent[top] = np.where(depth[top] == 1, -1, start[up] + depth[top] - 1 - lcp[up] - 1)
    length = chars[offset[at] + depth - 1]
    is_open = (low == 0) | (high == n - 1)
    children = np.bincount(parent[parent >= 0], minlength=len(at))
    leaf, own = np.concatenate(([0], np.cumsum(children == 0))), np.concatenate(([0], np.cumsum((members - 1) * length)))
    after = start[high + 1]
    here = np.arange(len(at))
    leaves, saved = leaf[after] - leaf[here], own[after] - own[here]
    # open nodes and the root (last slot) take the sums of their closed children only
    closed = np.flatnonzero(~is_open)
    sums = np.zeros((3, len(at) + 1), np.int64)
    for row, values in zip(sums, (np.ones(len(at), np.int64), leaves, saved)):
        np.add.at(row, parent[closed], values[closed])  # -1 is the root's slot
    for values, row in zip((children, leaves, saved), sums):
        values[is_open] = row[:-1][is_open]
    side = np.where(~is_open, -1, np.where(low == 0, 0, 1))
    parent_open = np.where(parent < 0, True, is_open[parent])
    parent_side = np.where(parent < 0, 0, side[parent])
    up_name = np.where(parent < 0, 0, name[parent])
    end = [ends[p] if d == size[p] else None for p, d in zip(at.tolist(), depth.tolist())]
    key = [paths[p][(d - 1) * _KEY : d * _KEY] if o else None for p, d, o in zip(at.tolist(), depth.tolist(), is_open.tolist())]
    root = [[block], [0], [0], [0], [b""], [0], [int(smallest.min())], [0], [None], [int(so_far[-1])], *([int(row[-1])] for row in sums), [ends[0] if size[0] == 0 else None]]
    final = ~is_open & ~parent_open
    found = [
        np.full(len(at), block), side, parent_side, depth - 1, key, length, name, depth, pa.array(up_name, pa.int64(), mask=~final), members, children, leaves, saved, end,
    ]
    return {"root": root, "nodes": found, "count": len(at)}


def _block_batch(held: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
    chars = np.concatenate([np.asarray(r[1], np.int64) for r in held])
    out = block_nodes([r[0] for r in held], chars, np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held], np.int64), [r[4] for r in held], block)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 8, pa.string()]
    names = [c.split()[0] for c in _BLOCK_NODE.split(", ")]
    for columns in (out["root"], out["nodes"]):
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, held, turns = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "n_convs", "conv_id", "ends"))):
            held.append(row)
            turns += len(row[1])
            if len(held) == BLOCK_ROWS or turns >= BLOCK_TURNS:
                yield from _block_batch(held, block)
                block, held, turns = block + 1, [], 0
    if held:
        yield from _block_batch(held, block)


# --- paths that go on over blocks -------------------------------------------------------------------


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes in order of block, side and depth: one path is held, nodes that it leaves are final."""
    path: list[dict] = []
    out: list[dict] = []
    uid, block, side = 0, None, None

    def close(depth: int) -> None:
        while len(path) > depth:
            node = path.pop()
            node["n_leaves"] += node["n_children"] == 0
            node["saved"] += (node["n_convs"] - 1) * node["chars"]
            if path:
                for name, value in (("n_children", 1), ("n_leaves", node["n_leaves"]), ("saved", node["saved"])):
                    path[-1][name] += value
            out.append(node | {"block": None, "side": None, "parent_uid": path[-1]["uid"] if path else None})

    names = [c.split()[0] for c in _MERGED.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "ends" else pa.int32() if n == "side" else pa.int64()) for n in names])

    def flush() -> pa.RecordBatch:
        found = pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema)
        out.clear()
        return found

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if (block, side) != (row["block"], row["side"]):
                block, side = row["block"], row["side"]
                if side == 1:
                    close(depth)  # the last sequence leaves the first one here
            if depth < len(path) and path[depth]["key"] == row["key"]:
                node = path[depth]
                for name in ("n_convs", "n_children", "n_leaves", "saved"):
                    node[name] += row[name]
                node["conv_id"] = min(node["conv_id"], row["conv_id"])
                node["ends"] = node["ends"] or row["ends"]
            else:
                close(depth)
                uid += 1
                path.append(row | {"uid": uid})
            out.append({"block": block, "side": side, "depth": depth, "uid": path[depth]["uid"]})
        yield flush()
    close(0)
    yield flush()


def trie(talks: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``talks(conv, turns)``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends."""
    paths = _paths(talks)
    groups = written(paths.groupBy("path", "chars", "seq").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")), "path-groups")
    repeated = groups.where("n_convs > 1").select("seq")
    digests = written(id_digests(paths.select("seq", "conv").join(repeated, "seq", "left_semi")), "id-digests")
    alone = F.when(F.col("n_convs") == 1, F.sha2(F.col("conv_id").cast("string"), 256))
    ready = groups.join(digests, "seq", "left").select("path", "chars", "n_convs", "conv_id", F.coalesce(alone, "ends").alias("ends"))
    found = written(ready.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_blocks, _BLOCK_NODE), "trie-blocks")
    merged = written(found.where("side >= 0").repartition(1).sortWithinPartitions("block", "side", "depth").mapInArrow(_merge, _MERGED), "trie-paths")
    ends: Column = F.coalesce("ends", F.lit(NOBODY)).alias("ends")
    sums = ["n_convs", "n_children", "n_leaves", "saved"]
    spanning = merged.where("block IS NULL").drop("block", "side", "parent_conv_id")
    named = spanning.select(F.col("uid").alias("parent_uid"), F.col("conv_id").alias("parent_conv_id"))
    spanning = spanning.join(named, "parent_uid", "left").select("conv_id", "depth", "parent_conv_id", *sums, ends)
    parents = merged.where("block IS NOT NULL").select("block", F.col("side").alias("parent_side"), F.col("depth").alias("parent_depth"), F.col("uid").alias("parent_uid"))
    parents = parents.join(named, "parent_uid").drop("parent_uid")
    closed = found.where("side < 0")
    final = closed.where("parent_conv_id IS NOT NULL").select("conv_id", "depth", "parent_conv_id", *sums, ends)
    under = closed.where("parent_conv_id IS NULL").drop("parent_conv_id").join(parents, ["block", "parent_side", "parent_depth"])
    return spanning.unionByName(final).unionByName(under.select("conv_id", "depth", "parent_conv_id", *sums, ends))
