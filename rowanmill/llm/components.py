"""Connected components of a table of links, in Spark.

Defined results: links with a null side and links of a node with itself say nothing; repeated links count once; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one batch replaced by one link from each node to the smallest node that the batch joins it to."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up] if up in parent else up
            return x

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        rows = [(x, root(x)) for x in parent]
        yield pd.DataFrame([(x, r) for x, r in rows if x != r], columns=["a", "b"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (long columns a, b): the smallest node reachable.

    Each round links every node to the smallest of its neighbours and itself and those neighbours to it as
    well, which shortens paths by a power; rounds end when no link changes.  Only sums and counts reach the
    driver.  Links are first thinned within batches.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(links.select("a", "b").where("a <> b").mapInPandas(_forest, "a long, b long").distinct())
    state = None
    while True:
        # larger neighbours go to the smallest of the neighbourhood
        least = both(edges).groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both(edges).where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # each node and its smaller neighbours go to the smallest of them
        small = large.where("a <> b").distinct()
        lower = small.groupBy("a").agg(F.min("b").alias("m"))
        edges = materialize(small.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
