"""Chains and groups over references between rows: causal completeness of the log, customers behind one phone or device.

Both walk references that may be long and go through hubs.  Every step is a grouped aggregate (combined before the
shuffle) or an equi-join with one row per id on one side, which adaptive execution may split on the other; rounds are
written tables, those of the causal chains without the events that an earlier round has settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

MOST_ROUNDS = 60


def causal_chains(events: DataFrame) -> DataFrame:
    """``event_id, root_id, depth, missing_id, cyclic`` of every id in ``events(event_id, causation_id, ..)``.

    The root is the first event of the chain that is there, depth the number of steps to it; ``missing_id`` is what the
    root names as its cause without its being in the log (null: complete).  Events on a cycle, or caused by one, have no
    root and depth and are ``cyclic``.  Rows without an id cannot be named and are left out; of repeated ids the smallest
    cause counts.

    Pointer doubling: an event knows an ancestor 2^n steps up; asking that ancestor for its own doubles the reach, so rounds
    grow with the logarithm of the longest chain."""
    checkpoint_dir(events.sparkSession)
    own = events.filter("event_id is not null").groupBy("event_id").agg(F.min("causation_id").alias("up"))
    there = own.select(F.col("event_id").alias("up"), F.lit(True).alias("there"))
    s = own.join(there, "up", "left")
    open_ = F.col("up").isNotNull() & F.col("there").isNotNull()
    s = s.select(
        "event_id", F.when(open_, F.col("up")).alias("jump"), F.when(open_, 1).otherwise(0).cast("long").alias("depth"),
        F.when(~open_, F.col("event_id")).alias("root_id"), F.when(~open_, F.col("up")).alias("missing_id"),
    ).checkpoint(eager=True)
    settled, s = s.filter("jump is null"), s.filter("jump is not null")  # an event that has found its root is not written again
    left = s.count()
    while left:
        far = settled.unionByName(s).select(F.col("event_id").alias("jump"), F.struct(F.col("jump"), "depth", "root_id", "missing_id").alias("f"))
        moved = s.join(far, "jump").select(
            "event_id", F.col("f.jump").alias("jump"), (F.col("depth") + F.col("f.depth")).alias("depth"), "f.root_id", "f.missing_id").checkpoint(eager=True)
        settled, s = settled.unionByName(moved.filter("jump is null")), moved.filter("jump is not null")
        now = s.count()
        if now == left:  # whoever is nearest to a root gets there in every round: the rest have none
            break
        left = now
    s = settled.unionByName(s)
    cyclic = F.col("jump").isNotNull()
    return s.select("event_id", F.when(~cyclic, F.col("root_id")).alias("root_id"), F.when(~cyclic, F.col("depth")).alias("depth"),
                    F.when(~cyclic, F.col("missing_id")).alias("missing_id"), cyclic.alias("cyclic"))


def shared_groups(links: DataFrame, most_members: int | None = None) -> DataFrame:
    """``customer_id, group_id, members``: customers joined through the values they share, ``links(customer_id, value)``;
    group_id is the smallest customer reachable.  A value of more than ``most_members`` customers (a switchboard, a shop's
    terminal) joins nobody.  Customers that share nothing are groups of their own; null values join nobody, rows without
    a customer are left out.

    Customers and values form a bipartite graph, so a value of n customers costs n links, not n²; labels travel both ways
    until none changes, taking the label of the label on the way, which keeps rounds near the logarithm of the widest group."""
    checkpoint_dir(links.sparkSession)
    rows = links.filter("customer_id is not null").select("customer_id", "value").distinct()
    if most_members is not None:
        sizes = rows.groupBy("value").agg(F.count("*").alias("_n"))
        rows = rows.join(sizes, "value", "left").withColumn("value", F.when(F.col("_n") <= most_members, F.col("value"))).drop("_n").distinct()
    rows = rows.checkpoint(eager=True)
    edges = rows.filter("value is not null")
    label = rows.select("customer_id").distinct().withColumn("group_id", F.col("customer_id")).checkpoint(eager=True)
    for _ in range(MOST_ROUNDS):
        lowest = edges.join(label, "customer_id").groupBy("value").agg(F.min("group_id").alias("low"))
        seen = edges.join(lowest, "value").groupBy("customer_id").agg(F.min("low").alias("low"))
        step = label.join(seen, "customer_id", "left").select("customer_id", F.least("group_id", "low").alias("next"), "group_id")
        # what a label's owner has learnt reaches all who carry the label, also those it shares nothing with
        best = step.groupBy("group_id").agg(F.min("next").alias("best"))
        step = step.join(best, "group_id").select("customer_id", "group_id", F.least("next", "best").alias("next"))
        short = step.select(F.col("customer_id").alias("next"), F.col("next").alias("further"))
        step = step.join(short, "next", "left").select("customer_id", F.coalesce("further", "next").alias("next"), "group_id").checkpoint(eager=True)
        changed = step.filter("next <> group_id").limit(1).count()
        label = step.select("customer_id", F.col("next").alias("group_id"))
        if not changed:
            sizes = label.groupBy("group_id").agg(F.count("*").alias("members"))
            return label.join(sizes, "group_id").select("customer_id", "group_id", "members")
    raise RuntimeError(f"groups did not settle in {MOST_ROUNDS} rounds")


def shared_risk(groups: DataFrame, customers: DataFrame, weight: float = 0.5) -> DataFrame:
    """``customer_id, group_id, members, risk, group_risk, spread_risk``: a customer's own risk raised by ``weight`` of what the riskiest
    of the group has above it, ``risk + weight * (max - risk)``; missing risks are 0."""
    c = customers.select("customer_id", F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)).alias("risk"))
    j = groups.join(c, "customer_id", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    top = j.groupBy("group_id").agg(F.max("risk").alias("group_risk"))
    return j.join(top, "group_id").select("customer_id", "group_id", "members", "risk", "group_risk",
                                          (F.col("risk") + F.lit(weight) * (F.col("group_risk") - F.col("risk"))).alias("spread_risk"))
