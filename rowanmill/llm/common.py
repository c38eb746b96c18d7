"""Helpers shared by the training-data operators: shared-folder tables and columnar tokenizing.

Words are maximal runs of bytes other than space and 0x09-0x0D.  The text helpers work on
whole Arrow buffers, so a task never holds more than one slice of ``SLICE_BYTES`` at a time (or one text, if
it is longer).  A null text has no words, like an empty one.

Words are told apart by XXH64 of their bytes, stretches of words by a mix of those that uses every bit of each.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0x9E3779B97F4A7C15


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """One input table by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    name = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_own_shared_dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        name = spark._own_shared_dir = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Nothing needs the shuffle files of the steps before any longer; asking for a collection lets Spark's
    cleaner remove them now instead of at the end of the job.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number, from 0 on, in an order that leaves no ties; ranges of rows are counted, so no task sees all."""
    spread = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = spread.groupBy(F.col("_range").alias("_r")).count().select("_r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return spread.withColumn(name, inside).join(starts, F.col("_range") == F.col("_r")).withColumn(name, F.col("_before") + F.col(name) - 1).drop("_range", "_r", "_before")


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text leaves remainder 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' offsets in them; a null is an empty row."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of some rows: byte ranges ``start`` to ``end``, and ``first[i]:first[i + 1]`` are those of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.edges, n = data, offsets, len(data)
        body = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~body[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~body[1:]
        self.start = np.flatnonzero(body & (before | edge[:-1]))
        self.end = np.flatnonzero(body & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """XXH64 of each word's bytes."""
        parts = self.data.tobytes()
        if len(self.edges) > 2:  # rows follow each other without a space
            parts = b" ".join(parts[i:j] for i, j in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True))
        return np.fromiter(map(xxhash.xxh64_intdigest, parts.split()), np.uint64, len(self.start))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over 64-bit values (two multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The hash of ``size`` words from each position on, from the words' hashes; other seeds give other, independent hashes.

    Stretches of 1, 2, 4, ... words are mixed from two of half the length, the asked length from those.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    golden = np.uint64(GOLDEN)
    part, length, at = mix(words + np.uint64(seed) * golden), 1, 0
    out = np.full(n, np.uint64(size), np.uint64)
    while True:
        if size & length:
            out = mix(out * golden + part[at : at + n])
            at += length
        if at == size:
            return out
        part, length = mix(part[:-length] * golden + part[length:]), 2 * length


def with_text(rows: DataFrame, columns: list[str], packed: str = "_in") -> DataFrame:
    """The input columns out of the struct ``packed``, with the text of ``rows`` and n_chars to match."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new.get(c, F.col(f"{packed}.`{c}`")).alias(c) for c in columns])


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct beside those that operators read, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), *[c for c in ("doc_id", "text", "source") if c in docs.columns])
