"""Set-similarity join of word shingles by PartEnum signatures (operator 11).

A document's set is its distinct word n-grams; documents link where ``100 * common >= percent * union``.  Texts that are
equal but for the case of A-Z are put together first.

Signatures.  Sizes are cut into bands, each so wide that linked sets lie in one band or in two neighbouring ones.  Linked
sets whose sizes do not exceed r differ in at most k(r) elements.  In each band the domain of shingles is parted in
groups of ``PARTS`` parts each, more groups than k(r) / 2, so some group holds one of the differences at most; then all its parts
but one are the same in both sets.  A signature names the band, the group, the part that is left out and the
elements in the others; a set gives those of its own band and the next.  No linked pair is missed.  A few more
groups than needed are made, so that for nearly all sets some agreeing group has elements in the parts that are
named; a set gives signatures without any element only if it is one of the others.

Groups.  What is asked for are components, so links inside one need not be listed.  Each set is first compared
with the set it shares most signatures with among the least of its buckets.  What is then left of the buckets
that still hold several components is compared in blocks of packs of sets, the buckets of a small family put together and
its largest component not against itself; each pair of packs comes once.  A block first gets
counts of the sets' elements by hash: sets whose counts differ by more than linked sets may differ in elements
are apart.  Only sets that this leaves with a partner are made from their texts again and compared exactly.

Defined results: a text with fewer words than a shingle is one shingle, one without words (or a null text) has an
empty set and links with nothing; a text of any length is one set, made in one task; rows with a null doc_id take part, a
component's id is its least doc_id that is not null; rows with the same doc_id are judged by their own texts;
repeated rows are kept; an empty table gives an empty result; other columns are not read.  Shingles are told
apart by 64-bit hashes, so a set of n of them differs from the true one with probability n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, buffers, materialize, mix, slices
from .components import components
from .manifest import LOWER, UPPER
from .resemblance import overlap, shingle_sets

SHINGLE, PERCENT = 4, 85
PARTS = 3
#: Sets that one task holds against a pivot at a time, and in a pack of the last step.
STAR_ROWS, PACK_ROWS, PACK_SHINGLES = 1024, 512, 1 << 20
#: Sets that meet in one bucket or another are compared as one family up to this size, and by their buckets beyond it.
FAMILY_ROWS = 16384
#: Bins that a set's elements are counted in, one byte each.
BINS = 512
SIGNATURE = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64())])


def bands(most: int, percent: int) -> np.ndarray:
    """The greatest size of each band, up to the one that holds ``most`` and the next."""
    ends, at = [], 1
    while len(ends) < 2 or ends[-2] < most:
        ends.append(at * 100 // percent)
        at = ends[-1] + 1
    return np.array(ends, np.int64)


def layout(end: int, percent: int) -> tuple[int, int]:
    """Groups of a band and how many of them are sure to hold one difference at most."""
    differences = 2 * end * (100 - percent) // (100 + percent)
    groups = differences // 2 + 1 + (differences + 24) // 32
    return groups, groups - differences // 2


def band_signatures(hashes: np.ndarray, band: int, end: int, percent: int) -> np.ndarray:
    """The signatures of a set in one band."""
    groups, sure = layout(end, percent)
    spread = mix(hashes + np.uint64((band + 1) * GOLDEN & (1 << 64) - 1))
    part = ((spread >> np.uint64(32)) * np.uint64(groups * PARTS) >> np.uint64(32)).astype(np.int64)
    held = np.zeros(groups * PARTS, np.uint64)
    np.add.at(held, part, mix(spread))
    size = np.bincount(part, minlength=groups * PARTS).reshape(groups, PARTS)
    held = held.reshape(groups, PARTS)
    tag = (np.uint64(band) << np.uint64(40)) + (np.arange(groups, dtype=np.uint64) * np.uint64(PARTS))
    out, full = [], []
    for left_out in range(PARTS):
        key = mix(tag + np.uint64(left_out))
        for p in range(PARTS):
            if p != left_out:
                key = mix(key * np.uint64(GOLDEN) + held[:, p])
        out.append(key)
        full.append(size.sum(axis=1) > size[:, left_out])
    out, full = np.array(out), np.array(full)
    risky = int((~full).any(axis=0).sum())
    return out[full] if risky < sure else out.ravel()


def signatures(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """sig, node and 0 for each signature of ``texts`` (node, text), and a row of its own for each node with the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = bands(1 << 40, percent)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            nodes = batch.column("node").to_numpy()
            for i, j in slices(offsets):
                found, owners, sizes = [], [], []
                for node, hashes in zip(nodes[i:j].tolist(), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle), strict=True):
                    own = int(np.searchsorted(ends, len(hashes)))
                    made = [mix(np.array([node], np.uint64))]
                    if len(hashes):
                        made += [band_signatures(hashes, b, int(ends[b]), percent) for b in (own, own + 1)]
                    n = sum(map(len, made))
                    found += made
                    owners.append(np.full(n, node))
                    sizes.append(np.concatenate(([len(hashes)], np.full(n - 1, -1))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (found, owners, sizes)], schema=SIGNATURE)

    return texts.select("node", "text").mapInArrow(run, "sig long, node long, n_shingles long")


def _linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def star_links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of ``pairs`` (pivot, node) those that link; a pivot with many nodes is as many tasks as it takes, and its text goes once to each."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("chunks"))
    nodes = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node", F.lit(1).alias("turn"))
    heads = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("pivot").alias("node"), F.lit(0).alias("turn"))
    rows = nodes.unionByName(heads).join(texts.select("node", "text"), "node").repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "turn")
    kept = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            pivots, nodes, turns = (batch.column(c).to_numpy() for c in ("pivot", "node", "turn"))
            a, b = [], []
            for i, j in slices(offsets):
                for k, hashes in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle), i):
                    if turns[k] == 0:
                        head = hashes
                    elif 100 * min(len(head), len(hashes)) >= percent * max(len(head), len(hashes)):
                        common = len(np.intersect1d(head, hashes, assume_unique=True))
                        if _linked(common, len(head), len(hashes), percent):
                            a.append(pivots[k])
                            b.append(nodes[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kept)

    return materialize(rows.select("pivot", "node", "turn", "text").mapInArrow(run, "a long, b long"))


def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (sig, node) of buckets that ``found`` (node, root) leaves in several components, with their component."""
    root = found.withColumnsRenamed({"node": "_node", "root": "_root"})
    placed = rows.join(root, F.col("node") == F.col("_node"), "left").select("sig", "node", F.coalesce("_root", "node").alias("part"))
    several = placed.groupBy("sig").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low < _high").select("sig")
    return materialize(placed.join(several, "sig"))


def families(rows: DataFrame) -> DataFrame:
    """The rows (sig, node, part) with the buckets of each small family, what buckets join directly or over others, put together as one.

    Sets of a family meet in many buckets, so each text then goes to a few blocks and not to those of every bucket.
    """
    star = rows.select("sig", "node").join(rows.groupBy("sig").agg(F.min("node").alias("a")), "sig").select("a", F.col("node").alias("b"))
    family = components(star)
    small = family.groupBy("root").count().where(F.col("count") <= FAMILY_ROWS).select("root")
    family = family.join(small, "root").select(F.col("node").alias("_node"), "root")
    placed = rows.join(family, F.col("node") == F.col("_node"), "left")
    return materialize(placed.select(F.when(F.col("root").isNull(), F.col("sig")).otherwise(F.xxhash64("root")).alias("sig"), "node", "part").distinct())


def counts(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, n (size of the set) and bins (its elements counted by hash, up to 255) of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sizes, bins = [], []
                for hashes in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle):
                    sizes.append(len(hashes))
                    bins.append(np.bincount((mix(hashes) % np.uint64(BINS)).astype(np.int64), minlength=BINS).clip(max=255).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary())], names=["node", "n", "bins"])

    return texts.join(nodes, "node").select("node", "text").mapInArrow(run, "node long, n long, bins binary")


def block_members(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """block, side, node, part: pairs of packs of a bucket (``rows``: sig, node, part), equal ones from whatever buckets once.

    The largest component of a bucket has packs of its own, which meet those of the others but not each other.
    """
    most = rows.groupBy("sig", "part").count().groupBy("sig").agg(F.max_by("part", F.struct("count", "part")).alias("_main"))
    dealt = rows.join(most, "sig").join(sizes, "node").withColumn("other", F.col("part") != F.col("_main"))
    needed = lambda of: F.ceil(F.greatest(F.count_if(of) / PACK_ROWS, F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / PACK_SHINGLES)).cast("int")
    packed = dealt.groupBy("sig").agg(needed(F.col("other")).alias("few"), needed(~F.col("other")).alias("main"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    dealt = dealt.join(packed, "sig").withColumn("chunk", F.when(F.col("other"), at(F.col("few"))).otherwise(F.col("few") + at(F.col("main"))))
    packs = materialize(dealt.groupBy("sig", "few", "main", "chunk").agg(F.sort_array(F.collect_list(F.struct("node", "part"))).alias("pack")))
    x = packs.where("chunk < few").select("sig", "chunk", F.col("pack").alias("x"), F.explode(F.sequence("chunk", F.col("few") + F.col("main") - 1)).alias("with"))
    y = packs.select("sig", F.explode(F.sequence(F.lit(0), F.least("chunk", F.col("few") - 1))).alias("chunk"), F.col("pack").alias("y"), F.col("chunk").alias("with"))
    blocks = materialize(x.join(y, ["sig", "chunk", "with"]).select("x", "y").distinct().withColumn("block", F.monotonically_increasing_id()))
    members = blocks.select("block", F.explode("x").alias("m"), F.lit(0).alias("side")).unionByName(blocks.where("x <> y").select("block", F.explode("y").alias("m"), F.lit(1).alias("side")))
    return members.select("block", "side", F.col("m.node").alias("node"), F.col("m.part").alias("part"))


def block_links(rows: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links a, b between sets of several components in a bucket (``rows``: sig, node, part)."""
    counted = materialize(counts(texts, rows.select("node").distinct(), shingle))
    told = block_members(rows, counted.select("node", "n")).join(counted, "node").repartition("block").sortWithinPartitions("block")
    kept = pa.schema([("block", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("part", pa.int64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "node", "part", "n", "bins")), strict=True):
                if row[0] != now:
                    yield _partnered(held, percent, kept)
                    now, held = row[0], []
                held.append(row)
        yield _partnered(held, percent, kept)

    left = materialize(told.select("block", "side", "node", "part", "n", "bins").mapInArrow(near, "block long, side int, node long, part long"))
    rows = left.join(texts.select("node", "text"), "node").repartition("block").sortWithinPartitions("block")
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            block, side, node, part = (batch.column(c).to_numpy() for c in ("block", "side", "node", "part"))
            for i, j in slices(offsets):
                for k, hashes in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle), i):
                    if block[k] != now:
                        yield _compared(held, percent, pairs)
                        now, held = block[k], ([], [])
                    held[side[k]].append((int(node[k]), int(part[k]), hashes))
        yield _compared(held, percent, pairs)

    return materialize(rows.select("block", "side", "node", "part", "text").mapInArrow(run, "a long, b long"))


def _partnered(held: list[tuple], percent: int, kept: pa.Schema) -> pa.RecordBatch:
    """The rows of a block that may link with one of another component, by their counts; a pack against itself has one side only."""
    x = [r for r in held if r[1] == 0]
    y = [r for r in held if r[1] == 1] or x
    out = set()
    if x:
        (nx, px, bx), (ny, py, by) = ((np.array([r[4] for r in s]), np.array([r[3] for r in s]), np.frombuffer(b"".join(r[5] for r in s), np.uint8).reshape(-1, BINS).astype(np.int16)) for s in (x, y))
        for i, r in enumerate(x):
            apart_ = np.abs(by - bx[i]).sum(axis=1, dtype=np.int64)
            for j in np.flatnonzero(((100 + percent) * apart_ <= (100 - percent) * (nx[i] + ny)) & (py != px[i])).tolist():
                out |= {r[:4], y[j][:4]}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sorted(out), strict=True) if out else ([], [], [], []), kept.types, strict=True)], schema=kept)


def _compared(held: tuple[list, list], percent: int, kept: pa.Schema) -> pa.RecordBatch:
    """One link for each two components that a block joins; a pack against itself has one side only."""
    x, y = held[0], held[1] or held[0]
    out: list[tuple[int, int]] = []
    if x:
        common = overlap([h for _, _, h in x], [h for _, _, h in y])
        total = np.array([len(h) for _, _, h in x])[:, None] + np.array([len(h) for _, _, h in y])[None]
        parts = np.array([p for _, p, _ in x])[:, None], np.array([p for _, p, _ in y])[None]
        root: dict[int, int] = {}

        def top(p: int) -> int:
            while (up := root.get(p, p)) != p:
                p = up
            return p

        for i, j in np.argwhere((parts[0] != parts[1]) & (100 * common >= percent * (total - common))).tolist():
            a, b = top(x[i][1]), top(y[j][1])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x[i][0], y[j][0]))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=kept)


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over links) of every row."""
    told = F.md5(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), told.alias("key"), F.col("text"))
    texts = keyed.groupBy("key").agg(F.min("text").alias("text"), F.min("doc_id").alias("least"))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()))

    bucket = Window.partitionBy("sig")
    full = signatures(texts, shingle, percent).withColumns({"size": F.count("*").over(bucket), "pivot": F.min("node").over(bucket)})
    full = materialize(full.where("size > 1 OR n_shingles >= 0").select("sig", "node", "pivot", "n_shingles"))
    sizes, rows = full.where("n_shingles >= 0").select("node", "n_shingles"), full.where("n_shingles < 0").select("sig", "node", "pivot")

    met = materialize(texts.join(rows.select("node").distinct(), "node", "left_semi"))  # later steps read the texts of sets that meet others only
    shared = rows.where("node <> pivot").groupBy("node", "pivot").count()
    nearest = shared.groupBy("node").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("pivot"))
    found = star_links(materialize(nearest), met, shingle, percent)
    left = apart(rows, components(found))
    found = found.unionByName(block_links(families(left), met, shingle, percent))

    placed = texts.select("key", "least", "node").join(components(found).withColumnsRenamed({"node": "_node"}), F.col("node") == F.col("_node"), "left")
    placed = materialize(placed.select("key", "least", "node", F.coalesce("root", "node").alias("part")).join(sizes, "node"))
    least = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    of_text = placed.join(least, "part").select(F.col("key").alias("_key"), "n_shingles", "component_id")
    return keyed.select("doc_id", "key").join(of_text, F.col("key") == F.col("_key")).select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
