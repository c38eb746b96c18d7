"""Hidden Markov language model: Baum-Welch training and exact scores (operator 2).

Tokens are lower-cased words and one end token a text; words are told apart by XXH64.  Token counts come from
all training texts and stay a table.  The model's symbols are the end token, the ``SYMBOLS`` most frequent
words (of equally frequent ones those with the least hash) and, for all other words, ``CLASSES`` classes by
their last two bytes; a word of a class has its smoothed share of the class.  So the latent states' tables
have a fixed size whatever the vocabulary, and probabilities of all words, unseen ones included, sum to one.

Training: each round, every task runs the scaled forward and backward recursions over its whole texts and
sums expected counts; Spark adds the tasks' sums, the driver renormalizes (states x symbols numbers).  Only
every ``KEEP``-th forward vector is kept, the others are computed again on the way back, so a text of any
length needs little memory.  Scoring: the scaled forward recursion over the whole text.

Word counts: those of the ``HEAD`` most frequent words at most go to the tasks as one sorted array; the
words beyond are counted per text and joined with the table of counts.

Defined results: a null text is the empty text, one end token; texts of any length are scored whole; a null
doc_id is held out like the empty id; repeated rows are all used and all scored; without training texts base and model are uniform; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, buffers, held_out, materialize, mix, slices, text_of

STATES, SYMBOLS, CLASSES, HEAD, KEEP, SEED = 8, 8192, 512, 1 << 20, 256, 3
END = np.uint64(0x5DEECE66D5DEECE6)
SMOOTH, STEPS, SHARES = 0.1, 16, 1 << 20
PRIOR = 0.1, 0.1, 0.01  # added to expected counts of starts, moves and emissions
COUNTS = pa.schema([("h", pa.int64()), ("cls", pa.int32()), ("c", pa.int64())])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a slice in lower case, their hashes and classes."""
    words = Words(LOWER[data], offsets)
    last = words.data[words.end - 1].astype(np.uint64)
    before = words.data[np.maximum(words.end - 2, words.start)].astype(np.uint64)
    return words, words.hashes(), (mix(last << np.uint64(8) | before) % np.uint64(CLASSES)).astype(np.int32)


def token_counts(rows: DataFrame) -> DataFrame:
    """h, cls, c of every token of the training rows; tasks send each of their tokens once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = texts = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, cls, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            h, first, where = np.unique(h, return_index=True, return_inverse=True)
            return h, cls[first], np.bincount(where, weights=c).astype(np.int64)

        def batch_of(h: np.ndarray, cls: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls), pa.array(c)], schema=COUNTS)

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            texts += batch.num_rows
            for i, j in slices(offsets):
                _, hashes, cls = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h, first, n = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((h, cls[first], n))
                size += len(h)
                if size > 2_000_000:
                    parts, size = [merged()], 0
                    if len(parts[0][0]) > 1_500_000:
                        yield batch_of(*parts.pop())
        if parts:
            yield batch_of(*merged())
        if texts:
            yield batch_of(np.array([END]), np.zeros(1, np.int32), np.array([texts]))

    return rows.select("text").mapInArrow(count, "h long, cls int, c long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("c").alias("c"))


def frequent(counts: DataFrame, limit: int) -> Column:
    """A test for about ``limit`` of the most frequent tokens at most: whole steps of the histogram of counts, of the last one a share by hash."""
    step, found, last = F.floor(F.log2("c") * STEPS).cast("long"), 0, (1 << 40, 0)
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 64 x STEPS rows
        if found + r["n"] > limit:
            last = r["step"], (limit - found) * SHARES // r["n"]
            break
        found, last = found + r["n"], (r["step"], SHARES)
    return (step > last[0]) | ((step == last[0]) & (F.pmod("h", F.lit(SHARES)) < last[1]))


class Vocabulary:
    """Counts of frequent words, symbols, and totals of classes: about HEAD + CLASSES numbers a column."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c"), F.count("*")).first()
        self.tokens, self.distinct = int(total[0] or 0), int(total[1])
        self.in_head, end = frequent(counts, HEAD), int(END.view(np.int64))
        head = counts.where(self.in_head).select("h", "c").toArrow()
        signed, c = head["h"].to_numpy(), head["c"].to_numpy()
        ranked = np.lexsort((signed, -c))
        ranked = ranked[signed[ranked] != end][:SYMBOLS]
        # the last symbol's count and hash tell symbols from other words
        cut = (int(c[ranked[-1]]), int(signed[ranked[-1]])) if len(ranked) else (1 << 62, 0)
        order = np.argsort(signed.view(np.uint64))
        self.hashes, self.counts = signed.view(np.uint64)[order], c[order]
        is_symbol = ((self.counts > cut[0]) | ((self.counts == cut[0]) & (signed[order] <= cut[1]))) & (self.hashes != END)
        self.symbols = np.where(is_symbol, np.cumsum(is_symbol), -1).astype(np.int32)  # 0 is the end token
        self.first_class = int(is_symbol.sum()) + 1
        self.size = self.first_class + CLASSES
        symbol = self.in_head & ((F.col("c") > cut[0]) | ((F.col("c") == cut[0]) & (F.col("h") <= cut[1])))
        per_class = counts.where(~symbol & (F.col("h") != end)).groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
        self.class_rest = np.full(CLASSES, SMOOTH)
        for r in per_class:
            self.class_rest[r["cls"]] += r["c"] + SMOOTH * r["v"]
        self.rest = self.tokens + SMOOTH * (self.distinct + 1)
        self.end_count = int(counts.where(F.col("h") == end).agg(F.sum("c")).first()[0] or 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is among the frequent ones, and its place there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at


def encoded(rows: DataFrame, words: "Vocabulary") -> DataFrame:
    """Each text as symbols, with what the frequent words add to its scores; ``tail`` holds the hashes of all others."""
    test, words.in_head = words.in_head, None  # a column is no part of what tasks get
    shared = rows.sparkSession.sparkContext.broadcast(words)
    words.in_head = test
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lexical", "ids", "tail", "tail_cls"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    kept = pa.schema(list(zip(names, types, strict=True)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, task, done = shared.value, TaskContext.get().partitionId() << 36, 0
        end_base = np.log10((v.end_count + SMOOTH) / v.rest)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                w, hashes, cls = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n, row = j - i, w.rows()
                head, at = v.find(hashes)
                c = np.where(head, v.counts[at] if len(v.counts) else 0, 0)
                symbol = np.where(head, v.symbols[at] if len(v.symbols) else -1, -1)
                in_class = head & (symbol < 0)
                base = np.bincount(row[head], weights=np.log10((c[head] + SMOOTH) / v.rest), minlength=n) + end_base
                lexical = np.bincount(row[in_class], weights=np.log10((c[in_class] + SMOOTH) / v.class_rest[cls[in_class]]), minlength=n)
                known = np.bincount(row[head], minlength=n) + (v.end_count > 0)
                ids = np.where(symbol < 0, v.first_class + cls, symbol).astype(np.uint16)
                tail_at = np.searchsorted(row[~head], np.arange(n + 1))
                tail, tail_cls = hashes[~head], cls[~head].astype(np.uint16)
                lists = [ids[w.first[k] : w.first[k + 1]].tobytes() + b"\0\0" for k in range(n)], [tail[tail_at[k] : tail_at[k + 1]].tobytes() for k in range(n)], [tail_cls[tail_at[k] : tail_at[k + 1]].tobytes() for k in range(n)]
                columns = [np.arange(n) + done + task, batch.column("doc_id")[i:j].cast(pa.int64()), batch.column("held_out")[i:j], w.counts + 1, known, base, lexical, *lists]
                done += n
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], schema=kept)

    return rows.mapInArrow(encode, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lexical double, ids binary, tail binary, tail_cls binary")


def tail_sums(texts: DataFrame, counts: DataFrame, words: "Vocabulary") -> DataFrame:
    """rid with what the words outside the sorted array add to n_known, base and lexical."""
    kept = pa.schema([("rid", pa.int64()), ("h", pa.int64()), ("rest", pa.float64()), ("n", pa.int64())])
    class_rest = words.class_rest

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [np.frombuffer(t.as_py(), np.int64) for t in batch.column("tail")]
            rest = class_rest[np.frombuffer(b"".join(t.as_py() for t in batch.column("tail_cls")), np.uint16)]
            h, rid = np.concatenate(tails), np.repeat(batch.column("rid").to_numpy(), [len(t) for t in tails])
            for at in range(0, len(h), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(rid[part]), pa.array(h[part]), pa.array(rest[part]), pa.array(np.ones(len(h[part]), np.int64))], schema=kept)

    rare = counts.where(~words.in_head).select("h", "c")
    tail = texts.where(F.length("tail") > 0).select("rid", "tail", "tail_cls").mapInArrow(expand, "rid long, h long, rest double, n long").join(rare, "h", "left")
    c = F.coalesce("c", F.lit(0))
    return tail.groupBy("rid").agg(F.sum((c > 0).cast("long")).alias("known2"), F.sum(F.log10((c + SMOOTH) / F.lit(words.rest))).alias("base2"), F.sum(F.log10((c + SMOOTH) / F.col("rest"))).alias("lexical2"))


class States:
    """The latent states: start distribution, transitions and emissions."""

    def __init__(self, size: int, states: int = STATES):
        rng = np.random.default_rng(SEED)
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1))
        self.emit = rng.uniform(0.2, 1.8, (size, states))
        self.emit /= self.emit.sum(0)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start = (start + PRIOR[0]) / (start + PRIOR[0]).sum()
        self.move = (move + PRIOR[1]) / (move + PRIOR[1]).sum(1, keepdims=True)
        self.emit = (emit + PRIOR[2]) / (emit + PRIOR[2]).sum(0)


def expected(model: States, parts: list[np.ndarray], out: tuple[np.ndarray, ...]) -> float:
    """Add the expected counts of whole sequences to start, move and emit; the natural log of their likelihood."""
    start, move, emit = out
    length = np.array([len(p) for p in parts])
    order = np.argsort(-length, kind="stable")
    ids, at, size = np.concatenate(parts), (np.cumsum(length) - length)[order], length[order]
    a32, b32, t_max, k = model.move.astype(np.float32), model.emit.astype(np.float32), int(size[0]), len(model.move)
    active = np.searchsorted(-size, -np.arange(t_max + 1), side="left")  # sequences longer than t

    def ahead(x: np.ndarray | None, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scaled forward vectors of place t from those before, what the states give its symbols, and the scales."""
        n = active[t]
        b = b32[ids[at[:n] + t]]
        x = (np.broadcast_to(model.start.astype(np.float32), (n, k)) if x is None else x[:n] @ a32) * b
        c = x.sum(1)
        return x / c[:, None], b, c

    kept, x, total = [], None, 0.0
    for t in range(t_max):
        if t % KEEP == 0:
            kept.append(x)
        x, _, c = ahead(x, t)
        total += float(np.log(c).sum())
    both, beta, later = np.zeros((k, k)), np.ones((0, k), np.float32), None
    for low in range((t_max - 1) // KEEP * KEEP, -1, -KEEP):
        x, steps = kept.pop(), []
        for t in range(low, min(low + KEEP, t_max)):
            steps.append(ahead(x, t))
            x = steps[-1][0]
        gamma: list[np.ndarray] = []
        for x, b, c in reversed(steps):
            if later is not None:  # later: what beta, symbols and scales of the next place make
                m = len(later)
                both += x[:m].T @ later
                beta = np.concatenate([later @ a32.T, np.ones((len(x) - m, k), np.float32)])
            else:
                beta = np.ones((len(x), k), np.float32)
            gamma.append(x * beta)
            later = b * beta / c[:, None]
        where = np.concatenate([at[: active[t]] + t for t in range(low + len(steps) - 1, low - 1, -1)])
        weights, symbols = np.concatenate(gamma), ids[where]
        for s in range(k):
            emit[:, s] += np.bincount(symbols, weights=weights[:, s], minlength=len(emit))
    start += gamma[-1].sum(0)
    move += both * model.move
    return total


def baum_welch(texts: DataFrame, size: int, rounds: int, states: int = STATES) -> States:
    """Train on the symbols of all rows of ``texts``; ``history`` of the result has the log likelihood before each round."""
    model = States(size, states)
    model.history = []
    kept = pa.schema([("cell", pa.int64()), ("v", pa.float64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        total = 0.0
        for batch in batches:
            parts = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("ids")]
            parts.sort(key=len)
            for i in range(0, len(parts), 2048):
                total += expected(model, parts[i : i + 2048], out)
        flat = np.concatenate([*(x.ravel() for x in out), [total]])
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], schema=kept)

    for _ in range(rounds):
        sums = texts.select("ids").mapInArrow(counts, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()  # states x (symbols + states + 1) + 1 rows
        flat = np.zeros(states + states * states + size * states + 1)
        flat[sums["cell"].to_numpy()] = sums["v"].to_numpy()
        start, move, emit, total = np.split(flat, np.cumsum([states, states * states, size * states]))
        model.history.append(float(total[0]))
        model.update(start, move.reshape(states, states), emit.reshape(size, states))
    return model


def likelihoods(model: States, parts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    length = np.array([len(p) for p in parts])
    order = np.argsort(-length, kind="stable")
    ids, first = np.concatenate(parts), (np.cumsum(length) - length)[order]
    size = length[order]
    active = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")
    total, x = np.zeros(len(parts)), None
    for t in range(size[0]):
        n = active[t]
        x = (np.repeat(model.start[None], n, axis=0) if x is None else x[:n] @ model.move) * model.emit[ids[first[:n] + t]]
        c = x.sum(1)
        x /= c[:, None]
        total[:n] += np.log10(c)
    out = np.empty(len(parts))
    out[order] = total
    return out


def score(docs: DataFrame, rounds: int = 6, states: int = STATES, folds: int = 10) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select("doc_id", text_of().alias("text"), held_out(F.col("doc_id"), folds).alias("held_out"))
    counts = materialize(token_counts(rows.where("NOT held_out")))
    words = Vocabulary(counts)
    texts = materialize(encoded(rows, words))
    model = baum_welch(texts.where("NOT held_out"), words.size, rounds, states)
    tails = tail_sums(texts, counts, words)
    kept = pa.schema([("rid", pa.int64()), ("latent", pa.float64())])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                latent = likelihoods(model, [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("ids")])
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(latent)], schema=kept)

    latent = texts.select("rid", "ids").mapInArrow(forward, "rid long, latent double")
    joined = texts.drop("ids", "tail", "tail_cls").join(latent, "rid").join(tails, "rid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return joined.select("doc_id", "held_out", "n_tokens", add("n_known", "known2").cast("long").alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), add("base", "base2").alias("base_score"), (add("lexical", "lexical2") + F.col("latent")).alias("score"))
