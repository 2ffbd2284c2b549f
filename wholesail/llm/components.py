"""Connected components of an edge list by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond").

Every step is a grouped minimum (partial aggregation before the shuffle) and one equi-join whose
hot side adaptive execution may split; nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


EDGES_PER_TASK = 50_000


def _large(e: DataFrame) -> DataFrame:
    sym = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = sym.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` → ``(node, component)`` for every node that has an edge to another node;
    component = smallest node reachable.  Self loops, repeats and null ends are ignored; no edges give
    no rows.  Raises if ``max_rounds`` does not suffice (rounds grow with the log of the nodes)."""
    e = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    now = mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        # few edges need few tasks and files, whatever the number of shuffle partitions is set to
        tasks = max(1, -(-now[0] // EDGES_PER_TASK))
        e = checkpointed(_small(_large(e.coalesce(tasks)).coalesce(tasks)).coalesce(tasks))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
