"""Substring deduplication by relative Lempel-Ziv parsing (operator 7).

A window is ``WINDOW`` consecutive words of one document.  A word is removed if a window that covers it
also starts earlier: in a document with a smaller id or earlier in the same one.

Index.  Of the ``SPREAD`` grams of ``GRAM`` words in each window the one with the least hash is an anchor
(GRAM + SPREAD - 1 = WINDOW, so every window holds one, chosen by its words alone).  The reference blocks
are all documents' anchors, dealt by hash; for each anchor the index holds how often it occurs and where
first.

Parse.  A document is read left to right against the index.  A factor starts at an anchor that has an
earlier place and goes on greedily over the next anchors while they point to the same document at the
same distance; anchors are at most SPREAD <= GRAM words apart, so the words in between are equal too.  A
factor of at least WINDOW words is a duplicate span: all its windows start earlier.  The windows that no
factor holds - those over the boundaries of factors - are checked by themselves: all such windows with a
repeated anchor are compared by hash, and the first of each stays.

Words are told apart by XXH64, grams and windows of words by 96 bits of two independent mixes of those: among 10**13
windows two different ones are then taken for equal with probability 10**-3 in all, unless two of their words
collide.  Hot passages are aggregated before the shuffle and joins on them can be split.

Defined results: a null text has no words; a text of any length is read whole, in the tasks that hold it; of
equal windows in one text the first stays; a null doc_id comes before all others; rows with the same
doc_id count as one document in the order, so of two such rows with equal texts neither is the earlier;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, gram_hashes, materialize, slices, text_of

WINDOW, GRAM, SPREAD = 20, 11, 10
FIRST_ID = -(1 << 63)
GRAMS = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("id", pa.int64()), ("at", pa.int64())])
GRAMS_SQL = "h long, g int, id long, at long"
PLACE = pa.struct([("pos", pa.int32()), ("ref", pa.int64()), ("ref_text", pa.int32()), ("ref_pos", pa.int32())])


def more_bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """32 further bits of the hash of ``size`` words from each position on."""
    return (gram_hashes(hashes, size, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of each one's anchor, and the hashes of all grams."""
    grams = gram_hashes(hashes, GRAM)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    rows = words.rows()
    starts = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(grams, SPREAD)[starts].argmin(axis=1)
    return starts, starts + least, grams


def keyed(docs: DataFrame) -> DataFrame:
    """id, th and text: what the passes over the documents read.  th tells rows of one id apart by their texts; 0 if ids don't repeat."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("id")
    unique = docs.select(ident).groupBy("id").count().where("count > 1").isEmpty()
    return docs.select(ident, (F.lit(0) if unique else F.hash(text_of())).alias("th"), text_of().alias("text"))


def anchors(rows: DataFrame) -> DataFrame:
    """One row for each anchor: gram hash in two parts, id, and position and text hash packed in a long."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy().astype(np.int64) & 0xFFFFFFFF
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes = words.hashes()
                _, at, grams = window_anchors(words, hashes)
                at = np.unique(at)
                row = words.rows()[at]
                place = ((at - words.first[row]) << 32) | ths[i:j][row]
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(more_bits(hashes, GRAM)[at]), pa.array(ids[i:j][row]), pa.array(place)], schema=GRAMS)

    return rows.select("id", "th", "text").mapInArrow(find, GRAMS_SQL)


def repeated(places: DataFrame) -> DataFrame:
    """Of rows h, g, id, at those whose h and g occur more than once, with the first place of them.

    The first places are written before the join: the counts' shuffle can go, and as both sides of the join
    are then shuffled for it, Spark can split the rows of a frequent h among tasks.
    """
    first = places.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("f")).where("n > 1").select("h", "g", F.col("f.id").alias("ref"), F.col("f.at").alias("ref_at"))
    return places.join(materialize(first), ["h", "g"]).select("id", "at", "ref", "ref_at")


def text_hash(at: str):  # the low 32 bits as a signed int
    return F.shiftright(F.shiftleft(F.col(at), 32), 32).cast("int")


def position(at: str):
    return F.shiftright(F.col(at), 32).cast("int")


class Factors:
    """The parse of one document: intervals of words copied from an earlier place, and all repeated anchors."""

    def __init__(self, doc: int, refs: pa.StructScalar | list):
        pos, ref, ref_text, ref_pos = refs
        _, keep = np.unique(pos, return_index=True)  # repeated rows list each place again
        pos, ref, ref_text, ref_pos = pos[keep], ref[keep], ref_text[keep], ref_pos[keep]
        self.anchors = pos
        earlier = (ref < doc) | ((ref == doc) & (ref_pos < pos))
        pos, ref, ref_text, ref_pos = pos[earlier], ref[earlier], ref_text[earlier], ref_pos[earlier]
        goes_on = (ref[1:] == ref[:-1]) & (ref_text[1:] == ref_text[:-1]) & (np.diff(pos) == np.diff(ref_pos)) & (np.diff(pos) <= GRAM)
        if len(pos):
            cut = np.flatnonzero(~goes_on)
            self.start, self.end = pos[np.concatenate([[0], cut + 1])], pos[np.concatenate([cut, [len(pos) - 1]])] + GRAM
            self.ref, self.ref_pos = ref[np.concatenate([[0], cut + 1])], ref_pos[np.concatenate([[0], cut + 1])]
            long = self.end - self.start >= WINDOW
            self.start, self.end, self.ref, self.ref_pos = self.start[long], self.end[long], self.ref[long], self.ref_pos[long]
        else:
            self.start = self.end = self.ref = self.ref_pos = np.zeros(0, np.int64)


def ref_columns(column: pa.Array) -> Iterator[tuple]:
    """The lists of places, as four arrays for each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    names = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
    ends = np.cumsum([0, *np.nan_to_num(np.array(column.value_lengths().to_pylist(), float)).astype(int)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield tuple(x[a:b] for x in names)


def boundary_windows(rows: DataFrame) -> DataFrame:
    """Windows with a repeated anchor that no factor holds: window hash in two parts, id, position and text hash."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy().astype(np.int64) & 0xFFFFFFFF
            refs = list(ref_columns(batch.column("refs")))
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes = words.hashes()
                starts, at, _ = window_anchors(words, hashes)
                whole, more = gram_hashes(hashes, WINDOW), more_bits(hashes, WINDOW)
                n = len(words.start)
                known, inside = np.zeros(n + 1, bool), np.zeros(n + 1, np.int32)
                for k in range(i, j):
                    parse, base = Factors(int(ids[k]), refs[k]), words.first[k - i]
                    known[base + parse.anchors] = True
                    np.add.at(inside, base + parse.start, 1)
                    np.add.at(inside, base + parse.end - WINDOW + 1, -1)
                open_ = starts[known[at] & (np.cumsum(inside)[starts] == 0)]
                row = words.rows()[open_]
                place = ((open_ - words.first[row]) << 32) | ths[i:j][row]
                yield pa.RecordBatch.from_arrays([pa.array(whole[open_].view(np.int64)), pa.array(more[open_]), pa.array(ids[i:j][row]), pa.array(place)], schema=GRAMS)

    return rows.select("id", "th", "text", "refs").mapInArrow(find, GRAMS_SQL)


def parse(docs: DataFrame) -> DataFrame:
    """id, th, text with ``refs`` (places of repeated anchors) and ``alone`` (duplicate windows over factor boundaries)."""
    rows = keyed(docs)
    place = F.struct(position("at").alias("pos"), F.col("ref"), text_hash("ref_at").alias("ref_text"), position("ref_at").alias("ref_pos"))
    refs = repeated(anchors(rows)).select("id", text_hash("at").alias("th"), place.alias("place")).groupBy("id", "th").agg(F.collect_list("place").alias("refs"))
    refs = materialize(refs)
    windows = materialize(boundary_windows(rows.join(refs, ["id", "th"])))
    later = (F.col("ref") < F.col("id")) | ((F.col("ref") == F.col("id")) & (position("ref_at") < position("at")))
    alone = repeated(windows).where(later).select("id", text_hash("at").alias("th"), position("at").alias("pos")).groupBy("id", "th").agg(F.collect_list("pos").alias("alone"))
    return rows.join(materialize(refs.join(alone, ["id", "th"], "full")), ["id", "th"], "left")


def remove_duplicates(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with ``keep_text`` the kept words as ``text``) of every row."""
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] if keep_text else [])]
    kept = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, refs = batch.column("id").to_pylist(), ref_columns(batch.column("refs"))
            out = []
            for doc, text, ref, alone in zip(ids, batch.column("text"), refs, batch.column("alone"), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                n = len(words)
                if len(ref[0]) or alone.is_valid:
                    factors = Factors(doc, ref)
                    spans = np.zeros(n + 1, np.int32)
                    single = np.unique(np.array(alone.as_py() or [], np.int64))
                    np.add.at(spans, np.concatenate([factors.start, single]), 1)
                    np.add.at(spans, np.concatenate([factors.end, single + WINDOW]), -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(spans[:n]) == 0).tolist()]
                body = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(body).hexdigest(), *([body.decode("utf-8", "surrogatepass")] if keep_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(fields)], schema=kept)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    found = parse(docs).select("id", "text", "refs", "alone").mapInArrow(cut, schema)
    return found.withColumn("id", F.when(F.col("id") != FIRST_ID, F.col("id"))).withColumnRenamed("id", "doc_id")
