"""Skew-aware window building blocks.

A plain ``Window.partitionBy(key)`` puts every row of one key into one task; a customer that
holds a third of all rows would then be sorted by a single executor.  The helpers here split
each key by a time bucket, solve the problem inside bucket-sized partitions, and stitch the
buckets together with per-bucket aggregates (one row per key and bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join


BINS = 4096
HOT = 1000  # a bin with more than this part of the rows is hot


def _bin(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BINS)).cast("int")


def in_buckets(df: DataFrame, key: str, bucket: Column) -> tuple[DataFrame, bool]:
    """``df`` with ``_hot``, whether the row's key may be a hot one, and ``_bkt``, its ``bucket`` if so, else null; and whether
    any key is hot.

    Rows are counted per bin of keys.  A key of more than 1/1000 of the rows lies in a hot bin, of which there are fewer
    than 1000; all others are one group each, which needs no stitching.  The choice decides only how the work is spread."""
    per = df.groupBy(_bin(key).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    bins = per.agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_bin", "_n")).alias("_bins"))  # at most BINS counts
    hot = bins.select(F.transform(F.filter("_bins", lambda x: x["_n"] * HOT > F.col("_all")), lambda x: x["_bin"])).first()[0]
    d = df.withColumn("_hot", _bin(key).isin(hot) if hot else F.lit(False))
    return d.withColumn("_bkt", F.when(F.col("_hot"), bucket)), bool(hot)


def running_sum(
    df: DataFrame,
    key: str,
    order_cols: Sequence[str],
    value: str,
    out: str = "running_sum",
    bucket: Column | None = None,
) -> DataFrame:
    """cumulative ``sum(value)`` per ``key`` in ``order_cols`` order (rows up to the current one).

    Equal to ``sum(value).over(partitionBy(key).orderBy(order_cols).rowsBetween(unbounded, 0))``,
    but keys that may be hot are sorted per (key, bucket); the default bucket is the calendar day of the first
    order column.  ``bucket`` must be monotone in the ordering.
    """
    return running_sums(df, key, order_cols, {out: value}, bucket)


def latest_by(df: DataFrame, key: str | Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """The value of the latest row per key, ties broken by the later order columns.

    ``max_by`` is an aggregate: partial aggregation runs map-side, so a hot key is reduced
    before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(out))


def global_rank(df: DataFrame, value: str, tiebreak: str, descending: bool = True, out: str = "rank",
                ranges: int = 128) -> DataFrame:
    """1-based position of every row in a total order over the whole frame, without a
    single-partition window.

    Rows are cut into ~``ranges`` value ranges by ``approx_percentile`` (used only for balance),
    numbered inside each range by a window partitioned by range, and offset by the row counts
    of all earlier ranges (one row per range).  Equal values always share a range, so the
    ``tiebreak`` column orders them exactly.
    """
    key = F.col(value).cast("double")
    key = -key if descending else key
    d = df.withColumn("_k", key)
    cut_probs = [i / ranges for i in range(1, ranges)]
    cuts = d.agg(F.percentile_approx("_k", cut_probs, 10000).alias("_cuts"))
    d = d.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_k")))).drop("_cuts")
    per = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_bc"))
    offs = per.withColumn(
        "_off", F.coalesce(F.sum("_bc").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_b", "_off")  # ≤ ranges rows
    w = Window.partitionBy("_b").orderBy(F.col("_k").asc_nulls_last(), F.col(tiebreak).asc())
    return (
        d.join(F.broadcast(offs), "_b")
        .withColumn(out, F.col("_off") + F.row_number().over(w))
        .drop("_k", "_b", "_off")
    )


def cumulative_at(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    event_ts: str,
    probe_at: Column,
    probe_id: str,
    value: Column | None = None,
    bucket_us: int = 86_400_000_000,
) -> DataFrame:
    """For every probe row: count (and sum of ``value``) of the key's events with time ≤ ``probe_at``.

    ``probe_at`` is a micros column on ``probes``.  Trailing windows are differences of two such
    lookups (``C(t) − C(t − W)``), so a range window never needs one task per key: events and
    probes are unioned, counted inside (key, time-bucket) partitions with a RANGE frame, and
    offset by prefix totals over the key's buckets (one row per touched bucket).
    ``probe_id`` may be of any type (a struct keeps compound ids apart); a null key is a key of its own.
    Returns ``probe_id, _cnt, _sum``.
    """
    v = value if value is not None else F.lit(0)
    id_type = probes.schema[probe_id].dataType
    ev = events.select(
        F.col(key), F.unix_micros(F.col(event_ts)).alias("_t"), F.lit(1).alias("_isev"),
        v.cast("decimal(38,2)").alias("_v"), F.lit(None).cast(id_type).alias("_pid"),
    )
    pr = probes.select(
        F.col(key), probe_at.cast("long").alias("_t"), F.lit(0).alias("_isev"),
        F.lit(None).cast("decimal(38,2)").alias("_v"), F.col(probe_id).alias("_pid"),
    )
    base, hot = in_buckets(ev.unionByName(pr), key, F.floor(F.col("_t") / F.lit(bucket_us)))
    w = Window.partitionBy(key, "_bkt").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cnt, total = F.coalesce(F.sum("_isev").over(w), F.lit(0)), F.coalesce(F.sum("_v").over(w), F.lit(0))
    if hot:  # what came before a bucket is one more row at its start
        tot = base.filter("_hot").groupBy(key, "_bkt").agg(F.sum("_isev").alias("_bc"), F.sum("_v").alias("_bs"))
        prior = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        base = base.unionByName(tot.select(
            key, "_bkt", F.lit(True).alias("_hot"), (F.col("_bkt") * bucket_us).alias("_t"),
            F.sum("_bc").over(prior).alias("_oc"), F.sum("_bs").over(prior).alias("_os")), allowMissingColumns=True)
        cnt, total = F.coalesce(F.max("_oc").over(w), F.lit(0)) + cnt, F.coalesce(F.max("_os").over(w), F.lit(0)) + total
    res = base.withColumns({"_cnt": cnt.cast("long"), "_sum": total}).filter(F.col("_isev") == 0)
    return res.select(F.col("_pid").alias(probe_id), "_cnt", "_sum")


def running_sums(df: DataFrame, key: str, order_cols: Sequence[str], values: dict[str, str],
                 bucket: Column | None = None) -> DataFrame:
    """Several running sums in one pass ({output: value column}), as ``running_sum``: one shuffle of the rows.  What came
    before the bucket of a hot key is one more row at its start (one per key and bucket), not a join with all rows."""
    d, hot = in_buckets(df, key, bucket if bucket is not None else F.date_trunc("day", F.col(order_cols[0])))
    within = Window.partitionBy(key, "_bkt").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    if not hot:
        return d.withColumns({out: F.sum(v).over(within) for out, v in values.items()}).drop("_bkt", "_hot")
    totals = d.filter("_hot").groupBy(key, "_bkt").agg(*[F.sum(v).alias(f"_t_{out}") for out, v in values.items()])
    prior = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_bkt", F.lit(0).alias("_row"), *[F.sum(f"_t_{out}").over(prior).alias(f"_o_{out}") for out in values])
    u = d.withColumn("_row", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    within = Window.partitionBy(key, "_bkt").orderBy("_row", *order_cols).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({**{f"_w_{out}": F.sum(v).over(within) for out, v in values.items()},
                       **{f"_p_{out}": F.max(f"_o_{out}").over(within) for out in values}}).filter("_row = 1")
    for out in values:
        w_, p_ = F.col(f"_w_{out}"), F.col(f"_p_{out}")
        u = u.withColumn(out, F.when(w_.isNull() & p_.isNull(), F.lit(None)).otherwise(
            F.coalesce(p_, F.lit(0)) + F.coalesce(w_, F.lit(0))))
    return u.drop("_bkt", "_hot", "_row", *[f"_{x}_{o}" for x in "wpo" for o in values])


def running_extreme(df: DataFrame, key: str, order_cols: Sequence[str], value: str, out: str, bucket: Column | None = None,
                    smallest: bool = False, before: bool = False) -> DataFrame:
    """Running maximum (or minimum) of ``value`` per ``key`` in ``order_cols`` order, nulls passed over; with ``before`` the
    current row does not count.  Sorted per (key, bucket), stitched with one extreme per bucket, as ``running_sum``."""
    agg, join = (F.min, F.least) if smallest else (F.max, F.greatest)
    d = df.withColumn("_bkt", bucket if bucket is not None else F.date_trunc("day", F.col(order_cols[0])))
    frame = (Window.unboundedPreceding, -1 if before else 0)
    d = d.withColumn("_within", agg(value).over(Window.partitionBy(key, "_bkt").orderBy(*order_cols).rowsBetween(*frame)))
    prior = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(key, "_bkt").agg(agg(value).alias("_x")).select(key, "_bkt", agg("_x").over(prior).alias("_off"))
    res = null_safe_join(d, offsets, [key, "_bkt"], "left")
    return res.withColumn(out, join("_off", "_within")).drop("_bkt", "_within", "_off")


def carried(df: DataFrame, key: str, order_cols: Sequence[str], values: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Every column of ``values`` replaced by its last value that is not null up to the row, per ``key`` in ``order_cols``
    order: an as-of join that also reaches over buckets in which the key has no such row."""
    d = df.withColumn("_bkt", bucket if bucket is not None else F.date_trunc("day", F.col(order_cols[0])))
    within = Window.partitionBy(key, "_bkt").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(key, "_bkt").agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*order_cols))).alias(f"_x_{v}") for v in values])
    offsets = ends.select(key, "_bkt", *[F.last(f"_x_{v}", ignorenulls=True).over(prior).alias(f"_o_{v}") for v in values])
    res = null_safe_join(d.withColumns({f"_w_{v}": F.last(v, ignorenulls=True).over(within) for v in values}), offsets, [key, "_bkt"], "left")
    res = res.withColumns({v: F.coalesce(f"_w_{v}", f"_o_{v}") for v in values})
    return res.drop("_bkt", *[f"_w_{v}" for v in values], *[f"_o_{v}" for v in values])
