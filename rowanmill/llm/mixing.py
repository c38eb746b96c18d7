"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 1).

Every source is one stream of words: its documents in hashed order, one after another.  The stream is cut
into blocks of ``block_words`` words (the last is shorter).  A source's target gives its exact quota: whole
passes over all its blocks and, for the rest, the first blocks of a permutation, the last one trimmed to
the word.  Output shards of equal numbers of blocks are drawn by a splitting tree: the root holds the
quotas of all groups of sources, and each node deals its blocks to its two halves by one multivariate
hypergeometric draw, down to single shards.  A node's draw depends on the seed and the node alone, so a
task that lists some shards walks from the root to them and reruns agree.  A shard then owns an interval
of each group's permuted blocks; intervals are disjoint.  Rows of a shard are ordered by a hash.

Sources are put in at most ``GROUPS`` groups by their rank; a group's blocks are permuted together, which
leaves the shards' joint distribution over sources as it is.  So what the driver holds does not grow.  The draws
are exact up to 10**9 blocks; a mix of more than ``MAX_BLOCKS`` blocks of ``block_words`` gets longer blocks, one of more
than ``MAX_SHARDS`` shards gets larger shards.

Defined results: a null text has no words, takes no part and is returned with 0 taken; a text of any length
is cut at the words where blocks end; a null source is a source of its own, after all others; repeated rows are
separate rows, those that are equal in every column can't be told apart; if there are no words at all every target
is 0; an empty table gives an empty result; other columns are not read, or kept as they are where texts are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, packed, text_of, with_text

GROUPS = 256
MAX_BLOCKS, MAX_SHARDS = 1 << 28, 1 << 16
ROWS_PER_CELL = 1000
ROUNDS = 32  # of the permutation


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def mark(seed: int) -> Column:
    """The hash of a document that places it in its source's stream."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def partner(key: Column, x: Column, size: Column) -> Column:
    """The number that ``key`` pairs with ``x`` among 0..size-1; the remainder comes first, so no key overflows."""
    return F.pmod(F.pmod(key, size) - x, size)


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A bijection of 0..size-1 chosen by ``key``, a long: a swap-or-not shuffle.

    In each round a key of the round pairs every number with another one, and a hash of the pair says whether
    the two change places.
    """

    def round_(x: Column, r: Column) -> Column:
        other = partner(F.xxhash64(key, r), x, size)
        return F.when(F.xxhash64(r, key, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), round_)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """One row per source with its size and target: weighted shares of ``share`` times all words, none above ``most`` times its own.

    What is above a limit is shared again by weight among the other sources until none is above, a round a pass
    over the table of sources; only sums reach the driver.
    """
    sums = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = numbered(sums, [F.col("source").isNull().asc(), F.col("source").asc()], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight, limit = F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")), F.col("source_size") * F.lit(float(most))
    ranked = materialize(ranked.withColumns({"weight": weight, "limit": limit}))
    total, full, level = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share, -1, 0.0
    while True:
        over = F.col("limit") < F.col("weight") * level
        r = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("limit")).otherwise(0.0)).alias("given"), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if r["n"] == full or not r["open"]:
            break
        full, level = r["n"], (total - r["given"]) / r["open"]
    target = F.least(F.col("limit"), F.col("weight") * level) if r["open"] else F.col("limit")
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def node_split(seed: int, node: int, counts: np.ndarray, left: int) -> np.ndarray:
    """How many blocks of each group go to the left half, which takes ``left`` in all."""
    if left <= 0:
        return np.zeros_like(counts)
    return np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, left, method="marginals")


def shard_intervals(totals: list[int], shards: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards first to last: the shard, and of each group the start and number of its permuted blocks."""
    blocks = sum(totals)
    bounds = lambda s: blocks * s // shards

    def walk(node: int, low: int, high: int, start: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, start, counts
            return
        mid = (low + high) // 2
        left = node_split(seed, node, counts, bounds(mid) - bounds(low))
        yield from walk(2 * node, low, mid, start, left)
        yield from walk(2 * node + 1, mid, high, start + left, counts - left)

    yield from walk(1, 0, shards, np.zeros(len(totals), np.int64), np.array(totals, np.int64))


class Mix:
    """The plan of one mix: ``docs``, one row per document with its place in its source's stream, and ``pieces``."""

    def __init__(self, docs: DataFrame, seed: int = 7, block_words: int = 2048, shard_blocks: int = 64):
        spark = docs.sparkSession
        sized = materialize(docs.select("doc_id", "source", word_count().alias("size"), mark(seed).alias("mixed")))
        cells = max(16, -(-sized.count() // ROWS_PER_CELL))
        sized = sized.withColumn("cell", F.pmod("mixed", F.lit(cells)))
        sums = materialize(sized.groupBy("source", "cell").agg(F.sum("size").alias("size")))
        targets = source_targets(sums)  # a row a source
        total = sums.agg(F.sum("size")).first()[0] or 0
        self.block_words = block = max(block_words, -(-2 * total // MAX_BLOCKS))
        b = F.lit(block)
        # the quota: whole passes, then the first `part` permuted blocks, the last of them without its final `cut` words
        plan = targets.withColumns({"quota": F.round("target").cast("long"), "blocks": F.ceil(F.col("source_size") / b).cast("long")})
        plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
        plan = plan.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size")).withColumn("key", F.xxhash64(F.lit(seed), "source", "rank"))
        short = F.col("blocks") * b - F.col("source_size")
        short_at = permuted(F.col("blocks") - 1, F.greatest("blocks", F.lit(1)), F.col("key"))
        words = lambda n: n * b - F.when(short_at < n, short).otherwise(0)
        plan = plan.withColumn("part", F.ceil(F.col("rest") / b).cast("long"))
        plan = plan.withColumn("part", F.when(words(F.col("part")) < F.col("rest"), F.col("part") + 1).otherwise(F.col("part")))
        plan = plan.withColumn("cut", words(F.col("part")) - F.col("rest"))
        plan = plan.withColumns({"drawn": F.col("passes") * F.col("blocks") + F.col("part"), "grp": F.col("rank") % GROUPS})
        before = Window.partitionBy("grp").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        plan = plan.withColumn("offset", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
        self.plan = plan = materialize(plan)
        totals = {r["grp"]: r["n"] for r in plan.groupBy("grp").agg(F.sum("drawn").alias("n")).collect()}  # at most GROUPS rows
        self.totals = [totals.get(g, 0) for g in range(GROUPS)]
        self.shards = max(1, -(-sum(self.totals) // max(shard_blocks, sum(self.totals) // MAX_SHARDS)))
        self.seed = seed
        # places in the streams: sums of whole cells, then of the rows of a cell
        ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cell_start = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))
        row = Window.partitionBy("source", "cell").orderBy("mixed", "doc_id", "size")
        placed = sized.withColumns({"at": F.coalesce(F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "row": F.row_number().over(row)})
        placed = placed.join(cell_start.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        mine = plan.select(F.col("source").alias("p"), "source_size", "target", "passes", "part", "cut", "blocks", "key", "offset", "grp")
        self.docs = placed.join(mine, F.col("source").eqNullSafe(F.col("p"))).withColumn("start", F.col("base") + F.col("at")).drop("s", "c", "p", "base", "at")
        self.spark = spark

    def pieces(self) -> DataFrame:
        """What is taken: one row for each document, pass and block, with word range and shard; a row of nulls where nothing is."""
        b = F.lit(self.block_words)
        ids = ["doc_id", "source", "mixed", "cell", "row", "size", "source_size", "target"]
        d = self.docs
        span = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {self.block_words}"), F.expr(f"(start + size - 1) div {self.block_words}"))).otherwise(F.array().cast("array<bigint>"))
        d = d.select(*ids, "start", "passes", "part", "cut", "blocks", "key", "offset", "grp", F.explode_outer(span).alias("block"))
        rank = permuted(F.col("block"), F.greatest("blocks", F.lit(1)), F.col("key"))
        full = F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda e: F.struct(e.alias("pass"), (F.col("offset") + e * F.col("blocks") + rank).alias("drawn"), F.lit(0).cast("long").alias("cut")))
        full = F.when((F.col("passes") > 0) & F.col("block").isNotNull(), full).otherwise(F.array().cast("array<struct<pass:bigint,drawn:bigint,cut:bigint>>"))
        some = F.struct(F.col("passes").alias("pass"), (F.col("offset") + F.col("passes") * F.col("blocks") + rank).alias("drawn"), F.when(rank == F.col("part") - 1, F.col("cut")).otherwise(0).alias("cut"))
        chosen = F.when(F.coalesce(rank < F.col("part"), F.lit(False)), F.concat(full, F.array(some))).otherwise(full)
        d = d.select("*", F.explode_outer(chosen).alias("take"))
        low = F.greatest(F.col("start"), F.col("block") * b)
        block_end = F.least((F.col("block") + 1) * b, F.col("source_size")) - F.col("take.cut")
        high = F.greatest(F.least(F.col("start") + F.col("size"), block_end), low)
        d = d.withColumns({"first": low - F.col("start"), "n": F.when(F.col("take").isNotNull(), high - low).otherwise(0).cast("long"), "pass": F.col("take.pass")})
        totals = F.array(*[F.lit(max(t, 1)) for t in self.totals]).cast("array<bigint>")
        group_size = F.element_at(totals, (F.col("grp") + 1).cast("int"))
        d = d.withColumn("place", permuted(F.col("take.drawn"), group_size, F.xxhash64(F.lit(self.seed + 1), "grp"))).drop("take")
        d = d.withColumn("slot", F.floor(F.col("place") / F.ceil(group_size / self.shards)).cast("long"))
        dealt = self.dealt().hint("merge")  # grows with the mix
        out = d.join(dealt, (d["grp"] == dealt["g"]) & (d["slot"] == dealt["s"]) & (d["place"] >= dealt["low"]) & (d["place"] < dealt["high"]), "left")
        return out.select(*ids, "pass", "block", "first", "n", "shard", F.xxhash64(F.lit(self.seed), "grp", "place").alias("order"))

    def dealt(self) -> DataFrame:
        """Each shard's interval of each group's permuted blocks, once for every slot of equal width that it touches."""
        totals, shards, seed, chunk = self.totals, self.shards, self.seed, 256

        def list_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            widths = np.maximum(1, -(-np.array(totals) // shards))
            for batch in batches:
                for c in batch["id"].tolist():
                    rows = []
                    for shard, start, count in shard_intervals(totals, shards, seed, c * chunk, min((c + 1) * chunk, shards)):
                        for g in np.flatnonzero(count).tolist():
                            low, high, w = int(start[g]), int(start[g] + count[g]), int(widths[g])
                            rows += [(g, s, shard, low, high) for s in range(low // w, (high - 1) // w + 1)]
                    yield pd.DataFrame(rows, columns=["g", "s", "shard", "low", "high"])

        return self.spark.range(-(-shards // chunk)).mapInPandas(list_shards, "g long, s long, shard long, low long, high long")

    def taken(self) -> DataFrame:
        """Per document: what the mix takes of it, and from how many pieces and shards."""
        ids = ["source", "cell", "row", "doc_id", "size", "source_size", "target"]
        n_shards = F.count(F.when(F.col("n") > 0, F.col("shard")))
        return self.pieces().groupBy(*ids).agg(F.sum("n").cast("long").alias("taken"), n_shards.alias("n_pieces"), F.min("shard").alias("first_shard")).drop("source", "cell", "row")


def mixed_texts(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: ``docs`` cut to the word ranges taken, once for each pass.

    Rows come in the shards' partitions, shuffled within each.  A whole document keeps its text as it is;
    n_chars, if there is one, is set anew.
    """
    taken = Mix(docs, seed).pieces().where("n > 0")
    rows = packed(docs).withColumn("_mixed", mark(seed))
    nth, nth_taken = F.lit(1), F.lit(1)
    if not docs.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        # rows with the same id, text and source are told apart by a number, in the order of the hash of what else they have
        others = [F.col(f"_in.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        nth = F.row_number().over(Window.partitionBy("doc_id", "_mixed", "source").orderBy(F.xxhash64(*others)))
        nth_taken = F.dense_rank().over(Window.partitionBy("doc_id", "mixed", "source").orderBy("row"))
    rows = rows.withColumn("_nth", nth)
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("mixed").alias("_m"), F.col("source").alias("_s"), nth_taken.alias("_n"), "first", "n", "size", "shard", "order")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_mixed") == F.col("_m")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_nth") == F.col("_n"))
    rows = rows.join(taken, same)
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.regexp_replace(F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("n").cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    rows = rows.withColumn("text", F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(part))
    return with_text(rows.repartition("shard").sortWithinPartitions("shard", "order"), docs.columns)
