"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration (operator 10).

Every text becomes ``len(STATISTICS)`` numbers.  Cosines of random projections of the standardized numbers
approximate a Gaussian kernel.  Each task sums its part of the normal equations, per fold; Spark adds the
parts and the driver solves one small system.  Systems that leave a fold out score that fold's rows, and
isotonic regression on a grid of those scores turns scores into probabilities.  Sizes on the driver depend
on the number of features and grid cells alone.

Learning uses every labelled row outside the held-out rows.  Labels, lang, source and doc_id are no inputs.

Defined results: a null text is the empty text, which has statistics and a score like any other; a text of any
length is measured whole, in one task; texts with equal statistics have equal scores; labels
that are null or for unknown documents are not used, and several labels of a document all count; rows with
a null doc_id are scored; with no labels at all every score is the middle, 0.5; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, held_out, materialize, mix, slices, text_of

FEATURES, FOLDS, RIDGE, GRID, SEED = 192, 4, 1e-3, 2000, 11
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "longest_word", "upper", "digit", "stop", "comma", "bang", "symbol", "bracket", "pipe", "other_punct",
    "non_ascii", "blank", "line", "distinct_words", "top_word", "repeat_pairs", "repeat_triples", "short_words", "upper_words", "digit_words", "symbol_words", "entropy",
)
#: Byte classes in the order of the shares above.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"#*$%&<>@^~", b"()[]{}", b"|", b"\"'`-_=+/\\", bytes(range(128, 256)), b" \t\n\v\f\r", b"\n")


def _class_table() -> np.ndarray:
    table = np.zeros((len(CLASSES), 256), bool)
    for k, members in enumerate(CLASSES):
        table[k, list(members)] = True
    return table


IN_CLASS = _class_table()


def _repeats(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the share of its keys that occurred before in it, and the share of its most frequent key."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    total = np.maximum(np.bincount(r, minlength=n), 1)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[at], runs)
    return 1 - np.bincount(r[at], minlength=n) / total, most / total


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of the rows of a slice, one row each."""
    n, size = len(offsets) - 1, np.diff(offsets)
    words = Words(data, offsets)
    count, row = words.counts, words.rows()
    length = words.end - words.start
    some, per_byte = np.maximum(count, 1), np.maximum(size, 1)

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=n)

    def in_words(member: np.ndarray) -> np.ndarray:
        return sums(member)[words.end] > sums(member)[words.start]

    def sums(member: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.int32)
        np.cumsum(member[data], out=out[1:])
        return out

    totals = [sums(member) for member in IN_CLASS]
    shares = [np.diff(t[offsets]) / per_byte for t in totals]
    inside = lambda t: by_row(t[words.end] > t[words.start]) / some
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    mean = by_row(length) / some
    spread = np.sqrt(np.maximum(by_row(length * length) / some - mean * mean, 0))
    hashes = words.hashes()
    again, top = _repeats(hashes, row, n)
    grams = []
    for k in (2, 3):
        m = max(len(hashes) - k + 1, 0)
        key = hashes[:m].copy()
        for step in range(1, k):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[step : m + step])
        same = row[:m] == row[k - 1 :] if m else np.zeros(0, bool)
        grams.append(_repeats(key[same], row[:m][same], n)[0])
    counts = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256)
    p = counts / per_byte[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    columns = [np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), np.log1p(longest), *shares, 1 - again, top, *grams, by_row(length <= 3) / some, inside(totals[0]), inside(totals[1]), inside(totals[5]), entropy]
    return np.stack(columns, axis=1).astype(np.float32)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, held (the row is held out) and stats of every row."""
    kept = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("stats", pa.list_(pa.float32()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, held = batch.column("doc_id").cast(pa.int64()), batch.column("held")
            for i, j in slices(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                stats = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([ids[i:j], held[i:j], stats], schema=kept)

    return docs.select("doc_id", text_of().alias("text"), held_out(F.col("doc_id"), 5).alias("held")).mapInArrow(describe, "doc_id long, held boolean, stats array<float>")


class Model:
    """Standardization, projections, weights and calibration; a few hundred kilobytes."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.project = rng.normal(0, 1 / np.sqrt(2 * len(mean)), (len(mean), FEATURES))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros((FOLDS + 1, FEATURES + 1))
        self.grid, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.concatenate([np.cos(z @ self.project + self.shift), np.ones((len(z), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights[FOLDS]
        # a small part of the raw score keeps the order within level stretches
        return np.clip(0.998 * np.interp(raw, self.grid, self.levels) + 0.002 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, len(STATISTICS)))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and level of each block, in order of x."""
    blocks: list[list[float]] = []  # sums of weight, x and y
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([wi, xi * wi, yi * wi])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    w, bx, by = np.array(blocks).T
    return bx / w, by / w


def fit(rows: DataFrame) -> Model | None:
    """A model from rows of doc_id, stats and label (0 or 1); None without rows."""
    moments = rows.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()  # one row a statistic
    if not moments:
        return None
    model = Model(np.array([r["m"] for r in moments]), np.array([max(r["s"], 1e-6) for r in moments]))
    upper = np.triu_indices(FEATURES + 2)
    split = rows.select("stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id", "stats"), F.lit(FOLDS)).cast("int").alias("fold"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        for batch in batches:
            if len(batch):
                x = np.concatenate([model.features(_stack(batch["stats"])), batch[["label"]].to_numpy()], axis=1)
                for f in range(FOLDS):
                    part = x[batch["fold"].to_numpy() == f]
                    total[f] += part.T @ part
        for f in range(FOLDS):
            yield pd.DataFrame({"cell": np.arange(len(upper[0])) + f * len(upper[0]), "v": total[f][upper]})

    parts = split.mapInPandas(sums, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()  # FOLDS x FEATURES^2 / 2 rows
    cells = np.zeros(FOLDS * len(upper[0]))
    cells[parts["cell"].to_numpy()] = parts["v"].to_numpy()
    by_fold = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    for f, values in enumerate(cells.reshape(FOLDS, -1)):
        by_fold[f][upper] = values
        by_fold[f] += np.triu(by_fold[f], 1).T
    whole = by_fold.sum(0)
    for f in range(FOLDS + 1):
        m = whole - by_fold[f] if f < FOLDS else whole
        a, n = m[:-1, :-1], max(m[-2, -2], 1)
        model.weights[f] = np.linalg.solve(a + RIDGE * n * np.eye(len(a)) * (np.arange(len(a)) < FEATURES)[:, None] + 1e-9 * np.eye(len(a)), m[:-1, -1])

    def out_of_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = (model.features(_stack(batch["stats"])) * model.weights[batch["fold"].to_numpy()]).sum(1)
                cell = np.round((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * GRID).astype(np.int64)
                yield pd.DataFrame({"cell": cell, "label": batch["label"].to_numpy()})

    grid = split.mapInPandas(out_of_fold, "cell long, label double").groupBy("cell").agg(F.count("*").alias("n"), F.avg("label").alias("y")).orderBy("cell").toPandas()  # GRID + 1 rows at most
    model.grid, model.levels = isotonic(grid["cell"].to_numpy() / GRID * 2 - 0.5, grid["y"].to_numpy(), grid["n"].to_numpy())
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    stats = materialize(described(docs))
    mine = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    model = fit(materialize(stats.where("NOT held").join(mine, "doc_id")))

    kept = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            scores = model.score(x) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], schema=kept)

    return stats.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
