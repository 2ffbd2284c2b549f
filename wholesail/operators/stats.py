"""Exact distributed quantiles (E5/E6) and quantile binning.

``percentile()`` is exact but funnels every distinct value into one aggregation buffer;
``approx_percentile`` scales but is approximate.  ``exact_quantiles`` is exact and scales:

1. reduce to distinct values with counts (partial aggregation, skew-proof);
2. cut the distinct values into ~B ranges with ``approx_percentile`` (only used for balance);
3. rank inside each range with a window (one range per task) and offset every range by
   the counts of the ranges before it (≤ B rows);
4. keep the few rows that hold the wanted order statistics and interpolate linearly
   (``lo + (hi - lo) * frac`` at position ``(n - 1) * p``, like ``quantile_cont``).

The result is a one-row frame, so attaching it to a fact table is a broadcast of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], out: str = "breaks", ranges: int = 128) -> DataFrame:
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    cut_probs = [i / ranges for i in range(1, ranges)]
    cuts = counts.agg(F.percentile_approx("v", cut_probs, 10000).alias("cuts"))
    n_df = counts.agg(F.sum("c").alias("n"))
    b = counts.crossJoin(F.broadcast(cuts)).withColumn("b", F.size(F.filter("cuts", lambda x: x < F.col("v"))))
    b = b.drop("cuts")
    per_range = b.groupBy("b").agg(F.sum("c").alias("bc"))
    # at most `ranges` rows: a single-partition window here is bounded by construction
    offsets = per_range.withColumn(
        "off", F.coalesce(F.sum("bc").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("b", "off")
    w = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        b.join(F.broadcast(offsets), "b")
        .withColumn("cum_end", F.col("off") + F.sum("c").over(w))
        .withColumn("cum_start", F.col("cum_end") - F.col("c"))
    )
    # wanted 0-based ranks: floor and ceil of (n-1)*p for every p
    targets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                (F.floor((F.col("n") - 1) * F.lit(p)) + F.lit(j)).cast("long").alias("r"),
            )
            for i, p in enumerate(probs)
            for j in (0, 1)
        ]
    )
    hits = (
        ranked.crossJoin(F.broadcast(n_df.withColumn("t", targets)))
        .select("v", "n", F.explode(F.filter("t", lambda t: (t["r"] >= F.col("cum_start")) & (t["r"] < F.col("cum_end")))).alias("t"))
    )
    # rank floor+1 may run past the end when (n-1)*p is integral: fall back to the floor value
    per = hits.groupBy(F.col("t.i").alias("i")).agg(
        F.max(F.when(F.col("t.j") == 0, F.col("v"))).alias("lo"),
        F.max(F.when(F.col("t.j") == 1, F.col("v"))).alias("hi"),
        F.first("n").alias("n"),
    )
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    pos = (F.col("n") - 1) * prob
    frac = pos - F.floor(pos)
    q = F.col("lo") + (F.coalesce(F.col("hi"), F.col("lo")) - F.col("lo")) * frac
    return per.select(F.col("i"), q.alias("q")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias(out)
    )


def bin_by_breaks(value: Column, breaks: Column, labels: Sequence[str]) -> Column:
    """T4: label index = number of breaks strictly below the value (right-closed bins)."""
    idx = sum((F.when(F.get(breaks, F.lit(i)) < value, 1).otherwise(0) for i in range(len(labels) - 1)), F.lit(0))
    return F.when(breaks.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in labels]), idx + 1))


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float], ranges: int = 128) -> DataFrame:
    """``exact_quantiles`` for several columns in ONE set of jobs: the columns are stacked into
    (metric, value) rows and every step is grouped by metric.  Returns one row with a
    ``<col>_breaks`` array per column."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")
    ).select("s.m", "s.v").filter(F.col("v").isNotNull())
    counts = stacked.groupBy("m", "v").agg(F.count(F.lit(1)).alias("c"))
    cut_probs = [i / ranges for i in range(1, ranges)]
    per_metric = counts.groupBy("m").agg(
        F.percentile_approx("v", cut_probs, 10000).alias("cuts"), F.sum("c").alias("n"))  # one row per column
    b = counts.join(F.broadcast(per_metric), "m").withColumn(
        "b", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    per_range = b.groupBy("m", "b").agg(F.sum("c").alias("bc"))  # ≤ ranges rows per column
    offsets = per_range.withColumn("off", F.coalesce(F.sum("bc").over(
        Window.partitionBy("m").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(
        "m", "b", "off")
    w = Window.partitionBy("m", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (b.join(F.broadcast(offsets), ["m", "b"])
              .withColumn("cum_end", F.col("off") + F.sum("c").over(w))
              .withColumn("cum_start", F.col("cum_end") - F.col("c")))
    targets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                 (F.floor((F.col("n") - 1) * F.lit(p)) + F.lit(j)).cast("long").alias("r"))
        for i, p in enumerate(probs) for j in (0, 1)])
    hits = ranked.select("m", "v", "n", "cum_start", "cum_end", F.explode(F.filter(
        targets, lambda t: (t["r"] >= F.col("cum_start")) & (t["r"] < F.col("cum_end")))).alias("t"))
    per = hits.groupBy("m", F.col("t.i").alias("i")).agg(
        F.max(F.when(F.col("t.j") == 0, F.col("v"))).alias("lo"),
        F.max(F.when(F.col("t.j") == 1, F.col("v"))).alias("hi"),
        F.first("n").alias("n"))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    pos = (F.col("n") - 1) * prob
    q = F.col("lo") + (F.coalesce(F.col("hi"), F.col("lo")) - F.col("lo")) * (pos - F.floor(pos))
    arrays = per.select("m", "i", q.alias("q")).groupBy("m").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("breaks"))
    return arrays.agg(*[F.max(F.when(F.col("m") == c, F.col("breaks"))).alias(f"{c}_breaks") for c in cols])
