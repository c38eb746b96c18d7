"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 4).

A document's fingerprint has a bit set where more than half of its word shingles' XXH64 hashes have it;
fingerprints link at ``BITS_APART`` or fewer differing bits.  Equal fingerprints are first put together,
so copies cost nothing further.

Candidates.  The 64 bits are cut in three segments, each a word of the perfect [23, 12, 7] Golay code.
The codes of a segment are the indices of the codewords to which it and its one-bit changes decode (one
or six).  Segments one bit apart: the codes of either hold the nearest code of the other.  Two bits apart:
their codes share one, that of the word between them.  Four errors in three segments leave two segments
with (0, 2), (1, 1) or fewer errors.  For the first kind, keys are one segment unchanged with the codes of
the other.  For the second, one side gives the codes of the first segment with the nearest code of the
second, the other side the reverse; the third segment then has two errors at most, so one of its three
pieces is the same on both sides and goes into the key.  No link is missed; all are verified.

Groups.  What is asked for are components, so links inside a group need not be listed.  In each bucket
all rows are first compared with two pivots only: the fingerprint with the most rows and the one with the
least hash, which buckets of a group mostly have in common.  A fingerprint's pivots of all its buckets are
put together before they are compared, so each link comes once.  The buckets that then still hold several
components are compared component by component, in packs of about ``PACK_ROWS``, with one link for each two.

Defined results: a null text is the empty text, whose fingerprint is zero and links like any other; fewer
words than a shingle are one shingle; a text of any length is hashed whole, in the task that reads it; a bit
that is set in exactly half of the hashes is 0; rows with a null doc_id take part and a component's id is its
least doc_id that is not null; repeated rows are kept; an empty table gives an empty result; other columns are
not read, and kept as they are where rows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, materialize
from .components import components

BITS_APART = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
PACK_ROWS = 256
KEYED_ROWS = 100_000  # fingerprints a task makes keys of, up to 119 each


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER.tobytes()).split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""
    kept = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps)], schema=kept)

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error of weight 3 or less of each syndrome."""

    def remainder(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    unit = [remainder(1 << i) for i in range(23)]
    tables = []
    for first, n in ((0, 12), (12, 11)):
        table = np.zeros(1 << n, np.int64)
        for i in range(n):
            table[1 << i : 2 << i] = table[: 1 << i] ^ unit[first + i]
        tables.append(table)
    errors = np.zeros(2048, np.int64)
    for i in range(23):
        errors[unit[i]] = 1 << i
        for j in range(i):
            errors[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return tables[0], tables[1], errors


SYNDROME_LOW, SYNDROME_HIGH, ERROR_OF = _golay()


def nearest_code(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ ERROR_OF[SYNDROME_LOW[words & 4095] ^ SYNDROME_HIGH[words >> 12]]) >> 11


def codes(words: np.ndarray, bits: int) -> np.ndarray:
    """Codes of each word and its one-bit changes, each once: rows of 6 with the nearest first and -1 for none."""
    near = nearest_code(words)
    near_changed = np.sort(nearest_code(words[:, None] ^ (1 << np.arange(bits))), axis=1)
    fresh = near_changed != near[:, None]
    fresh[:, 1:] &= near_changed[:, 1:] != near_changed[:, :-1]
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = near
    row, col = np.nonzero(fresh)
    out[row, np.cumsum(fresh, axis=1)[row, col]] = near_changed[row, col]
    return out


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, key and side (bits 1 and 2; a link needs both) of unsigned fingerprints."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    found = [codes(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    rows, values, sides = [], [], []

    def add(tag: int, head: np.ndarray, row: np.ndarray, side: np.ndarray) -> None:
        rows.append(row)
        values.append(tag << 36 | head)
        sides.append(side)

    for tag, (i, j) in enumerate(PAIRS):
        third = 3 - i - j
        for x, y in ((i, j), (j, i)):  # x unchanged, y up to two errors
            row, col = np.nonzero(found[y] >= 0)
            add(2 * tag + (x > y), parts[x][row] << 12 | found[y][row, col], row, np.full(len(row), 3, np.int8))
            for piece in range(3):
                same = parts[third] >> (7 * piece) & (127 if piece < 2 else 255)
                use = np.ones(len(row), bool) if x > y else col > 0  # the nearest codes of both are listed once
                r, c = row[use], col[use]
                pair = (found[i][r, 0] << 12 | found[j][r, c]) if x < y else (found[i][r, c] << 12 | found[j][r, 0])
                side = np.where(c == 0, 3, 1 if x < y else 2).astype(np.int8)
                add(6 + 3 * tag + piece, same[r] << 24 | pair, r, side)
    return np.concatenate(rows), np.concatenate(values), np.concatenate(sides)


def keyed(distinct: DataFrame) -> DataFrame:
    kept = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("side", pa.int8())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fps = batch.column("fp").slice(at, 2000).to_numpy()
                n = batch.column("n").slice(at, 2000).to_numpy()
                row, key, side = keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(n[row]), pa.array(side)], schema=kept)

    return distinct.select("fp", "n").mapInArrow(expand, "key long, fp long, n int, side byte")


def pivot_links(full: DataFrame) -> DataFrame:
    """Links a, b of fingerprints with the pivots of their buckets (``full``: fp, p1, p2), each once."""
    pivots = F.array_union(F.collect_set("p1"), F.collect_set("p2"))  # no more than two for each key of a fingerprint
    near = lambda x: (x != F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= BITS_APART)
    star = full.groupBy("fp").agg(pivots.alias("pivots")).select("fp", F.filter("pivots", near).alias("pivots"))
    return star.select(F.col("fp").alias("a"), F.explode("pivots").alias("b"))


def pack_links(full: DataFrame, first: DataFrame) -> DataFrame:
    """Links a, b of the components (``first``: node, root) that are left apart in the buckets of ``full`` (key, fp)."""
    placed = full.select("key", "fp").join(first, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("part"))
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    placed = materialize(placed.join(several, "key"))
    sizes = placed.groupBy("key", "part").agg(F.ceil(F.count("*") / PACK_ROWS).alias("chunks"))
    packs = placed.join(sizes, ["key", "part"]).groupBy("key", "part", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk")).agg(F.collect_set("fp").alias("fps"))
    packs = materialize(packs.select("key", "part", "fps"))
    other = packs.select("key", F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    linked = F.exists("fps", lambda x: F.exists("fps2", lambda y: F.bit_count(x.bitwiseXOR(y)) <= BITS_APART))
    return packs.join(other, "key").where(F.col("part") < F.col("part2")).where(linked).select(F.col("part").alias("a"), F.col("part2").alias("b")).distinct()


def groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row."""
    spark = docs.sparkSession
    marked = materialize(fingerprints(docs, shingle))
    distinct = materialize(marked.groupBy("fp").agg(F.least(F.count("*"), F.lit(1 << 30)).cast("int").alias("n"), F.min("doc_id").alias("least")))

    bucket = Window.partitionBy("key")
    spread = distinct.repartition(max(spark.sparkContext.defaultParallelism, -(-distinct.count() // KEYED_ROWS)), "fp")
    full = keyed(spread).withColumns(
        {"size": F.count("*").over(bucket), "sides": F.bit_or("side").over(bucket), "p1": F.max(F.struct("n", "fp")).over(bucket)["fp"], "p2": F.min(F.struct(F.xxhash64("fp").alias("h"), "fp")).over(bucket)["fp"]}
    )
    full = materialize(full.where("size > 1 AND sides = 3").select("key", "fp", "p1", "p2"))
    first = components(pivot_links(full))
    second = components(pack_links(full, first)).withColumnsRenamed({"node": "node2", "root": "root2"})

    part = distinct.join(first, F.col("fp") == F.col("node"), "left").withColumn("part", F.coalesce("root", "fp"))
    part = part.join(second, F.col("part") == F.col("node2"), "left").select("fp", "least", F.coalesce("root2", "part").alias("part"))
    part = materialize(part)
    ids = part.groupBy("part").agg(F.min("least").alias("component_id"))
    return marked.join(part.join(ids, "part").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component; of rows with the same doc_id that with the least text stays, and rows without one stay.

    Of rows with the same doc_id and text the one with the least hash of its other columns stays.
    """
    found = materialize(groups(docs, shingle).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct())
    one = docs.where(F.col("doc_id").isNotNull()).join(found, "doc_id", "left_semi").select(*docs.columns)
    if not one.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = one.groupBy(F.col("doc_id").alias("_doc")).agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*hashed))).alias("_row")).select("_row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
