"""Prefix trie of conversations (operator 13).

Conversations that begin alike share work if their common beginnings are kept once.  A node is a distinct sequence of
first turns, each a role and a text; the root is the empty one.

A conversation is one path: ``CELL`` bytes a turn, the first 16 of the SHA-256 of its role and text, then the
length of the text.  Paths in byte order are the trie in depth-first order, so they are dealt to ranges and cut
into shards of about ``SHARD_TURNS`` turns; a common beginning, a common conversation or a long conversation spreads over as many shards as
it takes.  A shard keeps its trie as balanced parentheses.  The excess's minima of blocks and of ranges of
blocks find where a node closes; what lies between is its subtree, the rank of "()" counts its leaves, and
differences of cumulative arrays give its conversations and bytes.

Only beginnings that a shard shares with the last path of the shard before or the first path of the shard after,
its spines, are not complete there.  A node's bytes and its place among its parent's children are counted by the
first shard that has it, a leaf by the last one, so all parts of a spine node add up.

Defined results: rows without a conv_id are no conversation's; turns stand by number, a null one first, those of
the same number by the digest of role and text; a null role or text is empty; repeated rows are repeated turns; a
conversation that has no turns left is at the root; a negative conv_id has a remainder of its own sign; an empty table gives an empty result; other columns are not
read.  A path is one value, so a conversation of t turns takes 24 t bytes in one task.  Sequences are told apart
by 128 bits a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CELL = 24
SHARD_TURNS = 1 << 17
BLOCK_BITS = 64
NODE = (
    "key binary, parent_key binary, part int, chunk int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, weight long, once long, ends_sha256 string, ends string"
)
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and cells (hex, one a turn, in order) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    cell = F.concat(F.substring(told, 1, 32), F.lpad(F.lower(F.hex(F.octet_length(text))), 16, "0"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), cell.alias("cell"))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), "cell")))
    return rows.groupBy("conv_id").agg(listed.alias("turns")).select("conv_id", F.transform("turns", lambda t: t["cell"]).alias("cells"))


def as_paths(told: DataFrame) -> DataFrame:
    """conv_id and path of conversations given as lists of cells."""
    return told.select("conv_id", F.unhex(F.array_join("cells", "")).alias("path"))


def spliced(told: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % family, h = crc32(c) % (most + 1)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = told.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("_base"), h.alias("_h"), "cells")
    heads = told.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_head"), F.slice("cells", 1, most).alias("_cells"))
    head = F.slice(F.coalesce("_cells", F.array().cast("array<string>")), F.lit(1), F.col("_h"))
    rest = F.slice("cells", F.col("_h") + 1, F.size("cells"))
    return own.join(heads, F.col("_base") == F.col("_head"), "left").select("conv_id", F.concat(head, rest).alias("cells"))


def _cut(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """A sorted range cut into shards of about ``most`` turns."""
    part, chunk, held = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        chunks = []
        for path in batch["path"]:
            held += len(path) // CELL + 1
            chunks.append(chunk)
            if held >= most:
                chunk, held = chunk + 1, 0
        yield batch.assign(part=part, chunk=chunks)


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // CELL
    d = 0
    while d < n and a[CELL * d : CELL * (d + 1)] == b[CELL * d : CELL * (d + 1)]:
        d += 1
    return d


class Parentheses:
    """A balanced sequence with the minima of its excess over blocks, and over pairs of blocks, pairs of pairs and so on."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        n = len(opens)
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int32)
        padded = np.full(-(-n // BLOCK_BITS) * BLOCK_BITS, np.iinfo(np.int32).max, np.int32)
        padded[:n] = self.excess
        self.blocks = padded.reshape(-1, BLOCK_BITS)
        self.minima = [self.blocks.min(axis=1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            self.minima.append(np.minimum(low[0::2], np.append(low[1::2], np.full(len(low) % 2, np.iinfo(np.int32).max, np.int32))))
        self.pairs = np.concatenate(([0], np.cumsum(opens[:-1] & ~opens[1:])))  # "()" that begin before a place

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where each "(" of ``at`` closes: the next place whose excess is one less than at it."""
        out = np.empty(len(at), np.int64)
        for low in range(0, len(at), 1 << 14):
            out[low : low + (1 << 14)] = self._find_close(at[low : low + (1 << 14)])
        return out

    def _find_close(self, at: np.ndarray) -> np.ndarray:
        goal = self.excess[at] - 1
        block = at // BLOCK_BITS
        inside = (self.blocks[block] <= goal[:, None]) & (np.arange(BLOCK_BITS)[None] > (at % BLOCK_BITS)[:, None])
        found = inside.any(axis=1)
        out = block * BLOCK_BITS + inside.argmax(axis=1)
        left = np.flatnonzero(~found)
        node, level = block[left].copy(), np.zeros(len(left), np.int64)
        goal, going = goal[left], np.ones(len(left), bool)
        for up in range(len(self.minima)):  # up to a right sibling that goes low enough
            low = self.minima[up]
            right = node + 1
            fits = going & (node % 2 == 0) & (right < len(low))
            fits[fits] = low[right[fits]] <= goal[fits]
            node[fits], level[fits] = right[fits], up
            going &= ~fits
            node[going] //= 2
        for down in range(len(self.minima) - 1, 0, -1):  # and down to its first block that does
            here = level == down
            child = node[here] * 2
            node[here] = child + (self.minima[down - 1][child] > goal[here])
            level[here] = down - 1
        out[left] = node * BLOCK_BITS + (self.blocks[node] <= goal[:, None]).argmax(axis=1)
        return out

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """The number of "()" from each "(" to its ")"."""
        return self.pairs[close] - self.pairs[at]


def least_of_ranges(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, span, level = np.empty(len(first), np.int64), 1, values
    while True:
        here = (size >= span) & (size < 2 * span)
        out[here] = np.minimum(level[first[here]], level[first[here] + size[here] - span])
        if 2 * span > len(values):
            return out
        level, span = np.minimum(level[:-span], level[span:]), 2 * span


def _prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """A name for each of the path's first 0, 1, ... ``depth`` turns."""
    running, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        out.append(running.copy().digest())
        running.update(path[CELL * d : CELL * (d + 1)])
    return out


def shard_nodes(rows: list[tuple[bytes, int]], before: bytes | None, after: bytes | None, part: int, chunk: int) -> pd.DataFrame:
    """The nodes of a shard, its rows (path, conv_id) in order; ``before`` and ``after`` are the paths next to it, None at an end."""
    depth, length, parent, opens = [0], [0], [-1], [True]
    count, low, ends = [0], [np.iinfo(np.int64).max], [[]]
    stack, last = [0], b""
    for path, conv in rows:
        shared = shared_turns(last, path)
        if (len(last), len(path)) != (CELL * shared, CELL * shared):
            opens += [False] * (len(last) // CELL - shared) + [True] * (len(path) // CELL - shared)
            del stack[shared + 1 :]
            for d in range(shared, len(path) // CELL):
                parent.append(stack[-1])
                stack.append(len(depth))
                depth.append(d + 1)
                length.append(int.from_bytes(path[CELL * d + 16 : CELL * (d + 1)], "big"))
                count.append(0)
                low.append(np.iinfo(np.int64).max)
                ends.append([])
            last = path
        node = stack[-1]
        count[node] += 1
        low[node] = min(low[node], conv)
        ends[node].append(conv)
    opens += [False] * (len(last) // CELL + 1)
    depth, length, parent, count, low = (np.array(x, np.int64) for x in (depth, length, parent, count, low))
    n = len(depth)

    first_path = rows[0][0] if rows else b""
    left = shared_turns(before, first_path) if before is not None else 0
    right = shared_turns(last, after) if after is not None else 0
    spine: dict[int, bytes] = {}
    for path, deep in ((first_path, left), (last, right)):
        keys, node = _prefix_keys(path, deep), 0
        spine[0] = keys[0]
        if path is first_path:  # the first path's nodes come first
            chain = range(deep + 1)
        else:
            chain = stack[: deep + 1]
        for node, key in zip(chain, keys, strict=True):
            spine[node] = key
    owned = np.ones(n, bool)
    owned[: left + 1 if before is not None else 0] = False

    marks = Parentheses(np.array(opens))
    at = np.flatnonzero(marks.opens)
    close = marks.find_close(at)
    size = (close - at + 1) // 2
    first = np.arange(n)
    within = lambda x: (total := np.concatenate(([0], np.cumsum(x))))[first + size] - total[first]
    convs = np.concatenate(([0], np.cumsum(count)))
    n_convs = convs[first + size] - convs[first]
    n_leaves = marks.leaves(at, close)
    if after is not None and right == len(last) // CELL:  # the next shard has the last node too
        n_leaves[stack] -= 1
    n_children = np.bincount(parent[1:], weights=owned[1:], minlength=n).astype(np.int64)
    least = least_of_ranges(low, first, size)
    named = np.array([i in spine for i in range(n)])
    parent_named = np.concatenate(([False], named[parent[1:]]))
    listed = [",".join(map(str, e)) for e in ends]
    return pd.DataFrame(
        {
            "key": [spine.get(i) for i in range(n)],
            "parent_key": [spine[int(p)] if held else None for p, held in zip(parent, parent_named, strict=True)],
            "part": np.full(n, part, np.int32), "chunk": np.full(n, chunk, np.int32), "conv_id": least, "depth": depth,
            "parent_conv_id": pd.array(np.where(parent < 0, 0, least[np.maximum(parent, 0)]), "Int64"),
            "n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "weight": within(n_convs * length), "once": within(owned * length),
            "ends_sha256": [None if held else hashlib.sha256(e.encode()).hexdigest() for e, held in zip(listed, named, strict=True)],
            "ends": [e if held else None for e, held in zip(listed, named, strict=True)],
        }
    )


def _shard(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    edge = edges.iloc[0]
    return shard_nodes(sorted(zip(rows["path"], rows["conv_id"].tolist(), strict=True)), edge["before"], edge["after"], *map(int, key))


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts of each spine node, which come one after the other in the order of the shards, added up."""
    held: dict | None = None

    def done(x: dict) -> pd.DataFrame:
        x["ends_sha256"] = x.pop("sha").hexdigest()
        return pd.DataFrame([x])[["key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "weight", "once", "ends_sha256"]]

    for batch in batches:
        for r in batch.itertuples():
            if held is None or held["key"] != r.key:
                if held is not None:
                    yield done(held)
                held = {"key": r.key, "parent_key": r.parent_key, "conv_id": r.conv_id, "depth": r.depth, "sha": hashlib.sha256(), "any": False} | dict.fromkeys(("n_convs", "n_children", "n_leaves", "weight", "once"), 0)
            held["conv_id"] = min(held["conv_id"], r.conv_id)
            for c in ("n_convs", "n_children", "n_leaves", "weight", "once"):
                held[c] += getattr(r, c)
            if r.ends:
                held["sha"].update((("," if held["any"] else "") + r.ends).encode())
                held["any"] = True
    if held is not None:
        yield done(held)


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie over ``paths`` (conv_id, path)."""
    spread = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = materialize(spread.select("conv_id", "path").mapInPandas(lambda batches: _cut(batches, shard_turns), "conv_id long, path binary, part int, chunk int"))
    order = Window.orderBy("part", "chunk")  # a row a shard
    edges = rows.groupBy("part", "chunk").agg(F.min("path").alias("_low"), F.max("path").alias("_high"))
    edges = edges.select("part", "chunk", F.lag("_high").over(order).alias("before"), F.lead("_low").over(order).alias("after"))
    nodes = rows.groupBy("part", "chunk").cogroup(edges.groupBy("part", "chunk")).applyInPandas(_shard, NODE)
    nodes = materialize(nodes)
    parts = nodes.where("key IS NOT NULL").select("key", "parent_key", "part", "chunk", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "weight", "once", "ends")
    merged = parts.repartition("key").sortWithinPartitions("key", "part", "chunk").mapInPandas(
        _merged, "key binary, parent_key binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, weight long, once long, ends_sha256 string"
    )
    merged = materialize(merged)
    whole = nodes.where("key IS NULL")
    known = merged.select(F.col("key").alias("_key"), F.col("conv_id").alias("_parent"))
    columns = [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")] + [(F.col("weight") - F.col("once")).alias("saved_tokens"), F.col("ends_sha256")]
    inner = whole.where("parent_key IS NULL").select(*columns)
    both = merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*[c for c in merged.columns if c != "key"], "parent_conv_id").unionByName(whole.select(*[c for c in merged.columns if c != "key"], "parent_conv_id"))
    outer = both.where("parent_key IS NOT NULL").drop("parent_conv_id").join(known, F.col("parent_key") == F.col("_key")).withColumnRenamed("_parent", "parent_conv_id").select(*columns)
    root = both.where("depth = 0").select(*columns)
    return inner.unionByName(outer).unionByName(root)
