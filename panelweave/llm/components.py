"""Connected components of a link table, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(node, root) for every node that ``links`` (a, b) tie to another; root is the smallest node reachable.

    Distributed union-find: every round hangs each node's larger neighbours, then each node's smaller
    ones, on its smallest neighbour (large-star and small-star). Both are a grouped minimum, which
    combines before the shuffle, and a join that adaptive execution may split at a hot node. Rounds are
    written, so lost executors cost one round, and end when no link changes: every node then hangs on its
    root. Self links and null ends are dropped; an empty table gives none.
    """
    now = stages.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        # large star: neighbours above u go to the smallest of u and its neighbours
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stages.table(around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = stages.table(small.distinct(), "small-star")
        stages.drop(now, large)
        now = new
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (state.n, state.h):
            break
        seen = (state.n, state.h)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
