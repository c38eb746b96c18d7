"""Near-duplicates by resemblance of word shingles, for what fingerprints of 64 bits can't tell apart.

Texts with a Jaccard resemblance of 0.8 differ in about ten fingerprint bits; Golay keys for that many
errors would be over a thousand a document.  So the pipeline first drops what near_duplicates finds and
then the rest by minwise keys: ``BANDS`` keys of ``ROWS`` minima each meet for two texts of resemblance s
with probability 1 - (1 - s**ROWS)**BANDS, which is 0.9996 at 0.8.  In each bucket rows are first compared
with two pivots; minima tell which pairs to verify, and these are verified on their whole shingle sets.
What is left of the buckets that then still hold several components is compared pair by pair on whole
shingle sets, in blocks of two chunks that any task may take; a block gives one link for each two components.

Shingles are told apart by 64-bit hashes, so a set of n of them differs from the true one with probability n / 2**64.

Defined results: a text with fewer words than a shingle is one shingle, one without words (or a null text) none
and is like no other; a text of any length is one set, made in one task; equal texts are like each other, and of
rows that are alike the one with the least doc_id stays; rows with a null doc_id stay, rows with the same
doc_id count as one; an empty table gives an empty result; all columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, buffers, gram_hashes, materialize, mix, slices
from .components import components

BANDS, ROWS, SEED = 20, 5, 17
#: Pairs are verified if their minima agree this much less often than asked, four deviations of the estimate.
SLACK = 0.16
#: A chunk holds about so many rows and shingles at most; overlaps are counted for so many shingles at a time.
CHUNK_ROWS, CHUNK_SHINGLES, COLUMNS = 256, 1 << 16, 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row of a slice."""
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(gram_hashes(hashes[a:b], min(shingle, b - a))) if b > a else np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        for i, j in slices(offsets):
            yield ids[i:j], list(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle))


def minima(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, sig (the minima as bytes) and keys of every text with words."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kept = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, shingle):
            rows, sigs, keys = [], [], []
            for doc, hashes in zip(ids.tolist(), sets, strict=True):
                if len(hashes):
                    low = np.full(len(odd), (1 << 64) - 1, np.uint64)
                    for at in range(0, len(hashes), 4096):
                        low = np.minimum(low, mix(hashes[at : at + 4096, None] * odd[None]).min(axis=0))
                    band = np.arange(BANDS, dtype=np.uint64)
                    for row in low.reshape(BANDS, ROWS).T:
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + row)
                    rows.append(doc)
                    sigs.append((low >> np.uint64(32)).astype(np.uint32).tobytes())
                    keys.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, kept.field("keys").type)], schema=kept)

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "doc_id long, sig binary, keys array<bigint>")


def agreement(pairs: DataFrame) -> DataFrame:
    """Pairs a, b whose minima agree, with the share that does."""
    kept = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(c)), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).mean(axis=1))], schema=kept)

    return pairs.mapInArrow(run, "a long, b long, share double")


def shingled(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id and the distinct shingle hashes of the rows in ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, hashes in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return materialize(docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles array<bigint>"))


def overlap(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of ``x`` has in common with each of ``y``."""
    common = np.zeros((len(x), len(y)), np.int64)
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    sides = []
    for sets in (x, y):
        row, value = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(shared, value)
        held = at < len(shared)
        held[held] = shared[at[held]] == value[held]
        order = np.argsort(at[held], kind="stable")
        sides.append((row[held][order], at[held][order]))
    for low in range(0, len(shared), COLUMNS):
        parts = []
        for (row, at), n in zip(sides, common.shape, strict=True):
            i, j = np.searchsorted(at, (low, low + COLUMNS))
            part = np.zeros((n, COLUMNS), np.float32)
            part[row[i:j], at[i:j] - low] = 1
            parts.append(part)
        common += (parts[0] @ parts[1].T).astype(np.int64)
    return common


def block_links(x: list[dict], y: list[dict], least: float) -> list[tuple[int, int]]:
    """One link for each two components that rows of ``x`` and ``y`` join."""
    x_sets, y_sets = ([np.array(r["shingles"], np.int64) for r in side] for side in (x, y))
    x_part, y_part = (np.array([r["part"] for r in side], np.int64) for side in (x, y))
    common = overlap(x_sets, y_sets)
    total = np.array([len(s) for s in x_sets])[:, None] + np.array([len(s) for s in y_sets])[None]
    root: dict[int, int] = {}

    def top(part: int) -> int:
        while (up := root.get(part, part)) != part:
            part = up
        return part

    out = []
    for i, j in np.argwhere((x_part[:, None] != y_part[None]) & (common >= least * (total - common))).tolist():
        a, b = top(int(x_part[i])), top(int(y_part[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x[i]["doc_id"], y[j]["doc_id"]))
    return out


def left_links(docs: DataFrame, loose: DataFrame, found: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links a, b between rows of a bucket (``loose``: key, doc_id) that the links ``found`` leave in several components."""
    first = components(found)
    placed = loose.join(first, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("part"))
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    placed = materialize(placed.join(several, "key"))
    sets = shingled(docs, placed.select("doc_id").distinct(), shingle)
    sizes = placed.join(sets.select("doc_id", F.size("shingles").alias("n")), "doc_id").groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    sizes = sizes.select("key", F.ceil(F.greatest(F.col("rows") / CHUNK_ROWS, F.col("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    rows = placed.join(sizes, "key").join(sets, "doc_id").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    packs = materialize(rows.groupBy("key", "chunks", "chunk").agg(F.collect_list(F.struct("doc_id", "part", "shingles")).alias("pack")))
    # a pack goes to its blocks with every other pack and, on both sides, with itself
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    x = packs.select("key", "chunk", F.col("pack").alias("x"), other).where("chunk <= other")
    y = packs.select("key", F.col("chunk").alias("other"), F.col("pack").alias("y"), other.alias("chunk")).where("chunk <= other")
    kept = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = block_links(batch.column("x")[i].as_py(), batch.column("y")[i].as_py(), least)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=kept)

    return materialize(x.join(y, ["key", "chunk", "other"]).select("x", "y").mapInArrow(run, "a long, b long"))


def links(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs a, b of doc_ids with a resemblance of ``least`` or more, enough of them to join each group."""
    marked = materialize(minima(docs, shingle))
    bucket = Window.partitionBy("key")
    rows = marked.select("doc_id", F.explode("keys").alias("key")).withColumns({"size": F.count("*").over(bucket), "p1": F.min("doc_id").over(bucket), "p2": F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), "doc_id")).over(bucket)["doc_id"]})
    rows = materialize(rows.where("size > 1").select("key", "doc_id", "p1", "p2"))
    pairs = rows.select(F.col("doc_id").alias("b"), F.explode(F.array_distinct(F.array("p1", "p2"))).alias("a")).where("a <> b")
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sig = lambda c: marked.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"))
    close = agreement(pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b"))
    close = materialize(close.where(F.col("share") >= least - SLACK).select("a", "b"))
    held = shingled(docs, close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), shingle)
    side = lambda c: held.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = close.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    found = materialize(both.where(common >= least * (F.size("s_a") + F.size("s_b") - common)).select("a", "b"))
    loose = rows.where("doc_id <> p1 AND doc_id <> p2").select("key", "doc_id")
    return found.unionByName(left_links(docs, loose, found, shingle, least))


def drop_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, whose doc_ids don't repeat, without those that are like one with a smaller doc_id, directly or over others."""
    known = docs.where("doc_id IS NOT NULL")
    found = components(links(known, shingle, least)).where("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(materialize(found), "doc_id", "left_anti")
