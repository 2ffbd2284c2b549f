"""Multi-table stratified sampling that keeps foreign keys.

Randomness is a hash: the order key of a row is ``md5(seed ‖ '|' ‖ key)``, so a sample is
reproducible, independent of partitioning, and expressible in SQL.  Ranks (for the 50/50
split and for exact-n caps) are computed per (group, hash bucket): the first two hex digits of
the hash cut every group into 256 near-equal buckets, bucket offsets come from one row per
bucket, so even a stratum holding a third of the data is ranked by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import write_table
from .joins import null_safe_join

TIMESTAMP_PRIORITY = ["timestamp", "created_at", "month", "last_order_date"]  # T21


# --- config (A15) ---------------------------------------------------------------------------
@dataclass
class JoinSpec:
    parent: str
    key: str


@dataclass
class TableSpec:
    name: str
    filter: str | None = None          # "date_window" or None
    join: JoinSpec | None = None
    static: bool = False
    split_anchor: bool = False
    key: str | None = None             # unique row key for hash ordering (default: first column)


@dataclass
class SampleSpec:
    name: str
    split: str                          # "even" | "odd"


@dataclass
class SamplerConfig:
    tables: list[TableSpec]
    samples: list[SampleSpec] = field(default_factory=lambda: [SampleSpec("sample_a", "even"),
                                                                SampleSpec("sample_b", "odd")])
    random_seed: int = 42
    anchor: str = "latest"
    days: int = 90
    stratify_by: list[str] = field(default_factory=lambda: ["month", "channel", "status"])
    total_records_per_sample: int | None = None
    target_rows: int | None = None
    tolerance: float = 0.1

    def validate(self) -> "SamplerConfig":
        anchors = [t for t in self.tables if t.split_anchor]
        if len(anchors) != 1:
            raise ValueError(f"exactly one split_anchor table is required, got {len(anchors)}")
        seen: set[str] = set()
        for t in self.tables:
            if t.static and t.join is not None:
                raise ValueError(f"table '{t.name}' is static, copied whole: it takes no join")
            if t.static and t.split_anchor:
                raise ValueError(f"table '{t.name}' is static, copied whole: it cannot be the one that is split")
            if t.join is not None and not t.static and t.join.parent not in seen:
                raise ValueError(f"parent '{t.join.parent}' of '{t.name}' must be listed before it")
            if not t.static:
                seen.add(t.name)
        for s in self.samples:
            if s.split not in ("even", "odd"):
                raise ValueError(f"sample split must be even or odd, got {s.split}")
        return self


def load_config(spark: SparkSession, path: str) -> SamplerConfig:
    """A validated configuration from a JSON file (or YAML, where a parser is installed) on any path Spark reads."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if text.lstrip().startswith("{"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    tables = [TableSpec(**{**t, "join": JoinSpec(**t["join"]) if t.get("join") else None}) for t in raw["tables"]]
    window = raw.get("date_window", {})
    known = {k: raw[k] for k in ("random_seed", "stratify_by", "total_records_per_sample", "target_rows", "tolerance") if k in raw}
    samples = {"samples": [SampleSpec(**s) for s in raw["samples"]]} if "samples" in raw else {}
    window = {k: window[k] for k in ("anchor", "days") if k in window}
    return SamplerConfig(tables=tables, **samples, **window, **known).validate()


HASH_PREFIX = 3  # hex digits: 4096 parts of each group
EXACT_PREFIX = 4


# --- hash order and distributed ranks -------------------------------------------------------
def hash_key(key: Column, seed: int) -> Column:
    """md5 of ``seed|key`` (hex) — the same string in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def ranked(df: DataFrame, key: str, seed: int, groups: Sequence[str] = (), out: str = "_rank") -> DataFrame:
    """1-based rank of each row by (md5(seed|key), key) within ``groups`` — skew-safe: each group is ranked in
    ``16 ** HASH_PREFIX`` parts.  Null groups are groups, null keys come first."""
    g = list(groups)
    d = df.withColumn("_h", F.coalesce(hash_key(F.col(key), seed), F.lit(""))).withColumn("_hb", F.substring("_h", 1, HASH_PREFIX))
    per = d.groupBy(*g, "_hb").agg(F.count(F.lit(1)).alias("_bc"))
    w_off = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("_hb").rowsBetween(
        Window.unboundedPreceding, -1)
    offs = per.withColumn("_off", F.coalesce(F.sum("_bc").over(w_off), F.lit(0))).drop("_bc")  # one row per group and prefix
    w = Window.partitionBy(*g, "_hb").orderBy("_h", key)
    return null_safe_join(d, offs, [*g, "_hb"]).withColumn(out, F.col("_off") + F.row_number().over(w)).drop("_h", "_hb", "_off")


def exact_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly ``min(n, len)`` rows, chosen by hash order (no ``sample()``, no ``rand``).

    Rows are counted per hash prefix; prefixes that fit whole are kept by a filter, and only the one prefix in
    which the n-th row falls is sorted."""
    d = df.withColumn("_h", F.coalesce(hash_key(F.col(key), seed), F.lit(""))).withColumn("_hb", F.substring("_h", 1, EXACT_PREFIX))
    upto = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)  # one row per prefix
    cut = d.groupBy("_hb").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
    edge = cut.filter(F.col("_upto") - F.col("_c") < n).agg(
        F.max("_hb").alias("_edge"), F.max_by(F.lit(n) - F.col("_upto") + F.col("_c"), "_hb").alias("_room"))
    d = d.crossJoin(F.broadcast(edge)).filter(F.col("_hb") <= F.col("_edge"))  # a one-row bound
    last = d.filter(F.col("_hb") == F.col("_edge")).withColumn("_r", F.row_number().over(Window.partitionBy("_hb").orderBy("_h", key)))
    kept = d.filter(F.col("_hb") < F.col("_edge")).unionByName(last.filter(F.col("_r") <= F.col("_room")).drop("_r"))
    return kept.drop("_h", "_hb", "_edge", "_room")


def hash_bounds(df: DataFrame, key: str, wanted: dict[int, int]) -> dict[int, tuple[str, str] | None]:
    """For every ``{seed: n}`` the hash and key of the n-th distinct key in hash order, so that a row tells by itself whether
    it is among the first n (null: none are; all are, if there are fewer).  A null key is first and counts as one.

    Only keys whose hash lies in a share slightly above n of all rows are made distinct; where keys repeat so often that
    it holds fewer than n, the share is widened until it does."""
    bounds: dict[int, tuple[str, str] | None] = {s: None for s in wanted}
    todo = {s: n for s, n in wanted.items() if n > 0}
    if not todo:
        return bounds
    rows, parts = df.count(), 16 ** EXACT_PREFIX
    share = {s: (n + 5 * n ** 0.5 + 20) / max(rows, 1) for s, n in todo.items()}

    def small(is_in: dict[int, Callable[[Column], Column]]) -> DataFrame:
        """Distinct ``(_seed, _h, _key)`` whose hash is in.  Rows without such a hash are dropped first, at one md5 a seed."""
        on = {s: of(F.coalesce(hash_key(F.col("_key"), s), F.lit(""))) for s, of in is_in.items()}
        d = df.select(F.col(key).alias("_key")).filter(reduce(lambda x, y: x | y, on.values()))
        each = F.array(*[F.when(c, F.lit(s)) for s, c in on.items()])
        d = d.select("_key", F.explode(F.array_compact(each)).alias("_seed")).distinct()
        return d.withColumn("_h", F.coalesce(F.md5(F.concat(F.col("_seed").cast("string"), F.lit("|"), F.col("_key").cast("string"))), F.lit("")))

    edges: dict[int, tuple[str, int]] = {}
    while todo:
        hi = {s: f"{min(int(share[s] * parts), parts - 1):0{EXACT_PREFIX}x}" for s in todo}
        n = F.create_map(*[F.lit(x) for kv in todo.items() for x in kv])[F.col("_seed")]
        upto = Window.partitionBy("_seed").orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)  # one row per prefix
        per = small({s: (lambda h, x=x: h < x + "g") for s, x in hi.items()}).groupBy("_seed", F.substring("_h", 1, EXACT_PREFIX).alias("_hb")).agg(F.count(F.lit(1)).alias("_c"))
        per = per.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", n)
        before = F.when(F.col("_upto") - F.col("_c") < F.col("_n"), F.col("_hb"))
        found = {r["_seed"]: r for r in per.groupBy("_seed").agg(
            F.max("_upto").alias("all"), F.max(before).alias("edge"), F.max_by(F.col("_n") - F.col("_upto") + F.col("_c"), before).alias("room")).collect()}
        for s in list(todo):
            if s in found and found[s]["all"] >= todo[s]:
                edges[s] = (found[s]["edge"], int(found[s]["room"]))
            elif share[s] >= 1:
                bounds[s] = ("g", "")  # after every hash
            else:
                share[s] *= 4
                continue
            del todo[s]
    if edges:
        at = {s: (lambda h, x=x: F.substring(h, 1, EXACT_PREFIX) == x) for s, (x, _) in edges.items()}
        room = F.create_map(*[F.lit(x) for s, (_, r) in edges.items() for x in (s, r)])[F.col("_seed")]
        nth = small(at).withColumn("_r", F.row_number().over(Window.partitionBy("_seed").orderBy("_h", "_key"))).filter(F.col("_r") == room)
        bounds.update({r["_seed"]: (r["_h"], r["_key"]) for r in nth.collect()})
    return bounds


# --- phases -----------------------------------------------------------------------------------
def resolve_anchor(df: DataFrame, anchor: str) -> DataFrame:
    """G1: one-row frame with ``anchor_dt``: 'latest' = max(created_at or timestamp), else an ISO date."""
    if anchor == "latest":
        for c in ("created_at", "timestamp"):
            if c in df.columns:
                return df.agg(F.max(c).alias("anchor_dt"))
        raise ValueError("the anchor 'latest' needs a column created_at or timestamp")
    return df.sparkSession.range(1).select(F.to_timestamp(F.lit(anchor)).alias("anchor_dt"))


def timestamp_column(df: DataFrame) -> str:
    for c in TIMESTAMP_PRIORITY:
        if c in df.columns:
            return c
    raise ValueError(f"a window of days needs one of {', '.join(TIMESTAMP_PRIORITY)}; the table has {', '.join(df.columns)}")


def date_window(df: DataFrame, anchor: DataFrame, days: int) -> DataFrame:
    """``col ≥ anchor − days`` on the first known time column (lower bound only)."""
    c = timestamp_column(df)
    cut = anchor.select((F.col("anchor_dt") - F.make_dt_interval(F.lit(days))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).filter(F.col(c) >= F.col("_cut")).drop("_cut")  # one-row bound


def strata_columns(df: DataFrame, stratify_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``month`` is derived as %Y-%m of created_at; other columns must exist."""
    cols = []
    for c in stratify_by:
        if c == "month":
            df = df.withColumn("_strat_month", F.date_format("created_at", "yyyy-MM"))
            cols.append("_strat_month")
        elif c in df.columns:
            cols.append(c)
        else:
            raise ValueError(f"cannot form strata by {c!r}: the anchor table has {', '.join(df.columns)}, and 'month' for created_at")
    return df, cols


def stratified_split(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """Rank by hash within each stratum; ``_split`` = rank % 2 (odd sample gets the extra row)."""
    d, cols = strata_columns(df, strata)
    r = ranked(d, key, seed, cols)
    return r.withColumn("_split", (F.col("_rank") % 2).cast("int")).drop("_rank", *[c for c in cols if c.startswith("_strat_")])


def cap_sizes(counts: dict[str, int], total_records: int) -> dict[str, int]:
    """G7 arithmetic: ratio = cap/total; n = max(1, int(len·ratio)) for tables above n."""
    total = sum(counts.values())
    if total <= total_records:
        return dict(counts)
    ratio = total_records / total
    return {t: (max(1, int(c * ratio)) if c > max(1, int(c * ratio)) else c) for t, c in counts.items()}


def size_budget_sample(df: DataFrame, budget_bytes: int, key: str, seed: int, probe_rows: int = 1000) -> DataFrame:
    """Estimate bytes/row from a written probe (≤1000 hash-ordered rows), take that many rows,
    then one correction: if the written result is over budget, trim proportionally."""
    from ..session import checkpoint_dir
    import uuid

    spark = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/wholesail-probe-{uuid.uuid4().hex[:8]}"

    def written_bytes(frame: DataFrame, path: str) -> int:
        frame.write.mode("overwrite").option("compression", "snappy").parquet(path)
        jp = spark._jvm.org.apache.hadoop.fs.Path(path)
        return int(jp.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jp).getLength())

    probe = exact_n(df, probe_rows, key, seed)
    n_probe = probe.count()
    if n_probe == 0:
        return df
    per_row = written_bytes(probe, base + "-p") / n_probe
    est = max(1, int(budget_bytes / per_row))
    out = exact_n(df, est, key, seed)
    size = written_bytes(out, base + "-r")
    if size > budget_bytes:
        n = out.count()
        out = exact_n(out, max(1, int(n * budget_bytes / size)), key, seed)
    return out


class OnDemand(Mapping):
    """Named frames, each made when it is first asked for: a table of a run that nobody reads is not opened (a stored
    projection would be built for it)."""

    def __init__(self, names: Sequence[str], make: Callable[[str], DataFrame]):
        self._names, self._make, self._made = list(names), make, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


# --- the run (G11) --------------------------------------------------------------------------------
@dataclass
class SampleRun:
    samples: Mapping[str, Mapping[str, DataFrame]]
    reference: Mapping[str, DataFrame]
    tagged: Mapping[str, DataFrame] | None = None  # table -> rows with their ``_sample``
    sample_names: list[str] | None = None


def run_sampler(tables: dict[str, DataFrame], cfg: SamplerConfig, preserve_keys: bool = False,
                apply_total_cap: bool = True) -> SampleRun:
    """Six phases: anchor window, stratified split, per-sample anchor, dependency-ordered semi
    joins (G6/D7), proportional cap (G7; ``preserve_keys`` trims only the anchor and re-derives
    the children so foreign keys survive — T11), and the static reference copies (G10).

    All samples are derived in one pass: rows carry a ``_sample`` tag, a child table is joined
    once with its parent's distinct (key, sample) pairs (= one semi join per sample, null keys
    never match), and counts, caps and ranks are grouped by the tag."""
    cfg.validate()
    names = [x.name for x in cfg.samples]
    anchor_spec = next(t for t in cfg.tables if t.split_anchor)
    anchor_df = tables[anchor_spec.name]
    anchor_dt = resolve_anchor(anchor_df, cfg.anchor)
    a = date_window(anchor_df, anchor_dt, cfg.days)
    akey = anchor_spec.key or a.columns[0]
    a = stratified_split(a, cfg.stratify_by, akey, cfg.random_seed)
    by_split = {0: [x.name for x in cfg.samples if x.split == "even"],
                1: [x.name for x in cfg.samples if x.split == "odd"]}
    arr = {k: F.array(*[F.lit(n) for n in v]).cast("array<string>") for k, v in by_split.items()}
    a = a.withColumn("_sample", F.explode(F.when(F.col("_split") == 0, arr[0]).otherwise(arr[1]))).drop("_split")
    # every child table re-reads the split: materialise it once (reliable checkpoint in the
    # shared folder, so a lost executor does not recompute the whole chain)
    from ..session import checkpoint_dir

    checkpoint_dir(a.sparkSession)
    a = a.checkpoint(eager=True)
    seed = cfg.random_seed

    def trim(df: DataFrame, key: str, n_by_sample: dict[str, int]) -> DataFrame:
        n = F.create_map(*[x for s_, v in n_by_sample.items() for x in (F.lit(s_), F.lit(int(v)))])
        return ranked(df, key, seed, ["_sample"]).filter(F.col("_rank") <= n[F.col("_sample")]).drop("_rank")

    if cfg.total_records_per_sample is None and cfg.target_rows is not None:
        lo, hi = int(cfg.target_rows * (1 - cfg.tolerance)), int(cfg.target_rows * (1 + cfg.tolerance))
        got = {r["_sample"]: int(r["n"]) for r in a.groupBy("_sample").agg(F.count(F.lit(1)).alias("n")).collect()}
        for n_ in names:
            if got.get(n_, 0) < lo:
                raise ValueError(f"sample {n_!r} would hold {got.get(n_, 0)} anchor rows, and the run asks for {lo} to {hi}: "
                                 "take more days, loosen the tolerance or ask for fewer rows")
        a = trim(a, akey, {n_: (cfg.target_rows if got[n_] > hi else got[n_]) for n_ in names})

    every = F.array(*[F.lit(n_) for n_ in names])
    specs = {t.name: t for t in cfg.tables if not t.static}

    def derive(anchor: DataFrame) -> OnDemand:
        def make(name: str) -> DataFrame:
            t = specs[name]
            if t.split_anchor:
                return anchor
            df = tables[name]
            cols = df.columns
            if t.filter == "date_window":
                df = date_window(df, anchor_dt, cfg.days)
            if t.join is None:
                return df.withColumn("_sample", F.explode(every))
            keys = resolved[t.join.parent].select(t.join.key, "_sample").distinct()
            return df.join(keys, t.join.key).select(*cols, "_sample")

        resolved = OnDemand(list(specs), make)
        return resolved

    tagged = derive(a)
    if apply_total_cap and cfg.total_records_per_sample:
        counts = tagged_counts(tagged, names)
        sizes = {n_: cap_sizes(counts[n_], cfg.total_records_per_sample) for n_ in names}
        if preserve_keys:
            tagged = derive(trim(tagged[anchor_spec.name], akey, {n_: sizes[n_][anchor_spec.name] for n_ in names}))
        else:
            whole = tagged

            def capped(name: str) -> DataFrame:
                if all(sizes[n_][name] >= counts[n_][name] for n_ in names):
                    return whole[name]
                return trim(whole[name], specs[name].key or whole[name].columns[0], {n_: sizes[n_][name] for n_ in names})

            tagged = OnDemand(list(specs), capped)
    of = lambda n_: OnDemand(list(specs), lambda t: tagged[t].filter(F.col("_sample") == n_).drop("_sample"))
    return SampleRun({n_: of(n_) for n_ in names}, OnDemand([t.name for t in cfg.tables if t.static], lambda t: tables[t]), tagged, names)


def tagged_counts(tagged: Mapping[str, DataFrame], names: list[str]) -> dict[str, dict[str, int]]:
    """Rows per (sample, table) in ONE job: one conditional-count aggregate per table, unioned and
    collected (samples × tables small rows)."""
    parts = [df.agg(*[F.count_if(F.col("_sample") == n_).alias(f"n{i}") for i, n_ in enumerate(names)])
             .select(F.lit(t).alias("t"), *[f"n{i}" for i in range(len(names))]) for t, df in tagged.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    out: dict[str, dict[str, int]] = {n_: {} for n_ in names}
    for r in u.collect():
        for i, n_ in enumerate(names):
            out[n_][r["t"]] = int(r[f"n{i}"])
    return {n_: {t: out[n_][t] for t in tagged} for n_ in names}


def manifest(run: SampleRun) -> DataFrame:
    """(sample, table, rows) for every frame of the run — counted from the data (one
    conditional aggregate per table, so a sample with no rows still reports 0)."""
    parts = []
    if run.tagged is not None:
        names = run.sample_names or list(run.samples)
        for t, df in run.tagged.items():
            wide = df.agg(*[F.count_if(F.col("_sample") == n_).alias(f"n{i}") for i, n_ in enumerate(names)])
            stack = ", ".join(f"'{n_}', n{i}" for i, n_ in enumerate(names))
            parts.append(wide.selectExpr(f"stack({len(names)}, {stack}) AS (sample, rows)").select(
                "sample", F.lit(t).alias("table"), "rows"))
    else:
        for sample, tabs in run.samples.items():
            for t, df in tabs.items():
                parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(sample).alias("sample"), F.lit(t).alias("table"), "rows"))
    for t, df in run.reference.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit("reference").alias("sample"), F.lit(t).alias("table"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_run(run: SampleRun, output_dir: str) -> DataFrame:
    """Write every sample table (and the reference copies once) and return the manifest: (sample, table, rows,
    size_mb), with one row per sample whose table is null for its totals."""
    rows = []
    for sample, tabs in list(run.samples.items()) + [("reference", run.reference)]:
        for t, df in tabs.items():
            path = f"{output_dir.rstrip('/')}/{sample}/{t}.parquet"
            n = write_table(df, path)
            size = sum(length for _, length, _ in files.files(df.sparkSession, path))
            rows.append((sample, t, n, size / 1_048_576))
    spark = SparkSession.active()
    m = spark.createDataFrame(rows, "sample string, table string, rows long, size_mb double")
    totals = m.groupBy("sample").agg(F.lit(None).cast("string").alias("table"), F.sum("rows").alias("rows"), F.sum("size_mb").alias("size_mb"))
    return m.unionByName(totals).withColumn("size_mb", F.round("size_mb", 3))


def tag_samples(frames: dict[str, DataFrame]) -> DataFrame:
    """union of samples with a ``sample`` column."""
    parts = [df.withColumn("sample", F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_kpis(a: DataFrame, b: DataFrame) -> DataFrame:
    """K6: orders, GMV, AOV, customers and high-fraud orders for A and B, with % delta (null when A is 0)."""
    from .cookbook import kpi_tile

    ka = kpi_tile(a).selectExpr("stack(5, 'orders', CAST(orders AS DOUBLE), 'gmv', gmv, 'aov', aov, "
                                "'customers', CAST(customers AS DOUBLE), 'high_fraud_orders', "
                                "CAST(high_fraud_orders AS DOUBLE)) AS (metric, a)")
    kb = kpi_tile(b).selectExpr("stack(5, 'orders', CAST(orders AS DOUBLE), 'gmv', gmv, 'aov', aov, "
                                "'customers', CAST(customers AS DOUBLE), 'high_fraud_orders', "
                                "CAST(high_fraud_orders AS DOUBLE)) AS (metric, b)")
    j = ka.join(kb, "metric")
    return j.select("metric", "a", "b",
                    F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100).alias("delta_pct"))
