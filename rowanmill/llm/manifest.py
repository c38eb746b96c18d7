"""Merkle manifest of a table of documents (operator 12).

Every row is a leaf, the SHA-256 of its fields.  The leaves of a source stand in order of doc_id and form a tree of
fan-out ``RUN``; the roots of the sources form another.  A tree is kept as blocks: aligned subtrees of ``HEIGHT``
levels of hashing, each one row with its digests in a van Emde Boas layout (a tree of L levels is its upper L // 2
levels, then the lower subtrees from left to right, all laid out alike), so a walk from a leaf to the root stays
within few stretches of memory whatever the size of a cache line or page.  ``address`` gives a node's place by
arithmetic alone; it serves building and the retrieval of siblings.  The roots of the blocks are the leaves of
the next round, so a source of n documents takes log(n) / log(RUN ** HEIGHT) rounds, no task holds more than one
block, and a hot source is as many tasks as it has blocks.

Proofs go down the same way: a block's root has a path (the siblings to its left and right on each level above),
the block adds its own levels, and that is the path of each block below it.

Defined results: a null field counts as ``-`` and not as an empty one; a null source is one source and the first; rows
with a null doc_id come first in their source; rows with the same source and doc_id stand in order of their
leaves, so equal rows are interchangeable; a source of one row is its own root; a text of any length is hashed
by Spark's own functions; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

RUN, HEIGHT = 16, 3
BLOCK = RUN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row: each field as its UTF-8 length, a colon and its text, or ``-`` where it is null."""
    parts = []
    for name in FIELDS:
        value = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def tree_size(levels: int) -> int:
    return (RUN**levels - 1) // (RUN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """The places, in the layout of a complete tree of ``levels`` levels, of the nodes ``index`` (from the left) at ``depth``."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = RUN ** (depth - upper)
        at += tree_size(upper) + index // below * tree_size(levels - upper)
        index, depth, levels = index % below, depth - upper, levels - upper
    return at


def combined(digests: np.ndarray) -> bytes:
    return hashlib.sha256(digests.tobytes().hex().encode()).digest()


def height_of(n: int) -> int:
    """Levels of hashing of a block in a tree (or its rest) of ``n`` leaves: all of them, or HEIGHT if there are more blocks."""
    height = 0
    while RUN**height < min(n, BLOCK):
        height += 1
    return height


def lay_out(leaves: np.ndarray, height: int) -> np.ndarray:
    """The digests (rows of 32 bytes) of a block over ``leaves``; places right of the last node are zero."""
    store = np.zeros((tree_size(height + 1), 32), np.uint8)
    n = len(leaves)
    store[address(height + 1, height, np.arange(n))] = leaves
    for depth in range(height - 1, -1, -1):
        below = address(height + 1, depth + 1, np.arange(n))
        n = -(-n // RUN)
        made = b"".join(combined(store[below[RUN * i : RUN * (i + 1)]]) for i in range(n))
        store[address(height + 1, depth, np.arange(n))] = np.frombuffer(made, np.uint8).reshape(-1, 32)
    return store


def inner_path(store: np.ndarray, height: int, n: int, at: int) -> list[tuple[str, str]]:
    """The siblings left and right of the nodes from leaf ``at`` of a block up to, not including, its root."""
    out = []
    for depth in range(height, 0, -1):
        low, high = at // RUN * RUN, min(n, (at // RUN + 1) * RUN)
        digests = store[address(height + 1, depth, np.arange(low, high))].tobytes().hex()
        cut = 64 * (at - low)
        out.append((digests[:cut], digests[cut + 64 :]))
        at, n = at // RUN, -(-n // RUN)
    return out


def _digests(column: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column)), np.uint8).reshape(-1, 32)


def _build(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("pos")
    n = int(nodes["n"].iloc[0])
    store = lay_out(_digests(nodes["hash"]), height_of(n))
    return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "pos": [int(nodes["pos"].iloc[0]) // BLOCK], "n": [-(-n // BLOCK)], "own": [len(nodes)], "height": [height_of(n)], "hash": [store[0].tobytes().hex()], "store": [store.tobytes()]})


def blocks(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of blocks over ``nodes`` (tree, pos, n, hash; n nodes in the tree): the last round has one block a tree at most.

    A round holds tree, pos (the block's), n (blocks of the tree), own (its leaves), height, hash (its root) and store.
    """
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most:
        made = nodes.select("tree", "pos", "n", "hash").groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).applyInPandas(_build, "tree long, pos long, n long, own int, height int, hash string, store binary")
        rounds.append(materialize(made))
        nodes, most = rounds[-1].where("n > 1"), -(-most // BLOCK) if most > BLOCK else 0
    return rounds


def _below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The path of each leaf of the blocks."""
    for batch in batches:
        for r in batch.itertuples():
            store, above = np.frombuffer(r.store, np.uint8).reshape(-1, 32), [(p["left"], p["right"]) for p in r.path]
            for low in range(0, r.own, 256):
                at = range(low, min(low + 256, r.own))
                yield pd.DataFrame({"tree": r.tree, "pos": [r.pos * BLOCK + i for i in at], "path": [inner_path(store, r.height, r.own, i) + above for i in at]})


def with_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first round's blocks with their paths; ``tops``: tree, path (of the tree's own root)."""
    paths = None
    for blocks_ in reversed(rounds):
        found = tops.join(blocks_.where("n = 1").select("tree", "pos"), "tree").select("tree", "pos", "path")
        paths = found if paths is None else paths.unionByName(found)
        held = blocks_.join(paths, ["tree", "pos"])
        if blocks_ is not rounds[0]:
            paths = held.select("tree", "pos", "own", "height", "store", "path").mapInPandas(_below, f"tree long, pos long, path {PATH}")
    return held


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def _prove(key: tuple, leaves: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Proof digest and folded root of every leaf of one block."""
    r = next(block.itertuples())
    store, above = np.frombuffer(r.store, np.uint8).reshape(-1, 32), [(p["left"], p["right"]) for p in r.path]
    rest = "".join(a + b for a, b in above).encode()
    proofs, roots = [], []
    for at, claim in zip((leaves["pos"] % BLOCK).tolist(), leaves["claim"].tolist(), strict=True):
        path = inner_path(store, r.height, r.own, at)
        proof = hashlib.sha256("".join(a + b for a, b in path).encode())
        proof.update(rest)
        proofs.append(proof.hexdigest())
        roots.append(folded(claim, path + above))
    return pd.DataFrame({"tree": leaves["tree"], "doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "proof_sha256": proofs, "folded_root": roots})


class Manifest:
    """The trees of ``docs``: ``leaves`` (tree, pos, n, doc_id, hash and the row's claim), ``sources`` (tree, source, subroot), ``root`` and the blocks.

    ``claim`` is a text to hold against the manifest in place of the recorded one, as a Column over ``docs``.
    """

    def __init__(self, docs: DataFrame, claim: Column | None = None):
        values = {c: F.col(c) for c in FIELDS}
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(values).alias("hash"), leaf(values | {"text": values["text"] if claim is None else claim}).alias("claim"))
        rows = numbered(rows, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("hash")], "_number")
        rows = materialize(rows)
        counts = rows.groupBy("source").agg(F.min("_number").alias("_first"), F.count("*").alias("n"))
        known = materialize(numbered(counts, [F.col("_first")], "tree"))
        named = known.select(F.col("source").alias("_source"), "_first", "n", "tree")
        placed = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("tree", (F.col("_number") - F.col("_first")).alias("pos"), "n", "doc_id", "hash", "claim")
        self.leaves = materialize(placed)
        self.rounds = blocks(self.leaves)
        subroots = None
        for made in self.rounds:
            ended = made.where("n = 1").select("tree", F.col("hash").alias("subroot"))
            subroots = ended if subroots is None else subroots.unionByName(ended)
        self.sources = materialize(known.join(subroots, "tree").select("tree", "source", "subroot")) if self.rounds else known.select("tree", "source", F.lit("").alias("subroot"))
        n = self.sources.count()
        self.upper = blocks(self.sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("hash")))
        self.root: str | None = self.upper[-1].first()["hash"] if self.upper else None

    def paths(self) -> DataFrame:
        """The blocks that hold leaves, with the siblings on each level from the block's root to the root of all."""
        start = self.leaves.sparkSession.createDataFrame([(0, [])], f"tree long, path {PATH}")
        tops = with_paths(self.upper, start).select("tree", "pos", "own", "height", "store", "path").mapInPandas(_below, f"tree long, pos long, path {PATH}")
        return with_paths(self.rounds, tops.select(F.col("pos").alias("tree"), "path"))

    def checked(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256 (over all siblings), folded_root (of the claim) and verified for every leaf."""
        kept = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if self.root is None:
            return self.leaves.sparkSession.createDataFrame([], kept)
        held = self.paths().select("tree", F.col("pos").alias("block"), "own", "height", "store", "path").groupBy("tree", "block")
        leaves = self.leaves.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "doc_id", F.col("hash").alias("leaf"), "claim").groupBy("tree", "block")
        proved = leaves.cogroup(held).applyInPandas(_prove, "tree long, doc_id long, leaf string, proof_sha256 string, folded_root string")
        root = F.lit(self.root)
        return proved.join(self.sources, "tree").select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tampered(text: Column, doc_id: Column) -> Column:
    """``text`` in lower case where 5 divides the crc32 of the decimal doc_id (of the empty text, where it is null)."""
    return F.when(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, lowered(text)).otherwise(text)
