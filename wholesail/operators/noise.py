"""Perturb a log the way real pipelines see it — out-of-order and late timestamps,
corrupted numeric payload fields — and count what was done.

Selection is exact-n by hash order: no ``rand``, no driver-side id list.  The n smallest hashes are those up to the n-th
(``sampling.hash_bounds``), so each row tells by itself whether it is picked, and its timestamp or payload is changed
in place: the log is not shuffled and the row count never changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.eventlog import ENVELOPE_COLS, REGISTRY
from .sampling import hash_bounds, hash_key

NUMERIC = (T.DoubleType, T.LongType, T.IntegerType, T.FloatType)


@dataclass
class NoiseConfig:
    # Default noise rates of the simulation config
    out_of_order_rate: float = 0.001
    corruption_rate: float = 0.0001
    late_arrival_rate: float = 0.020
    late_arrival_days: int = 2
    out_of_order_hours: int = 1
    since: str | None = None            # only events at/after this time are shifted
    seed: int = 42


def numeric_fields(event_type: str) -> list[str]:
    """Top-level numeric payload fields of a type (T22: booleans are not numbers here)."""
    return [f.name for f in REGISTRY.get(event_type, T.StructType()).fields if isinstance(f.dataType, NUMERIC)]


def _number(key: str, seed: int, use: str):
    """A whole number from the md5 of seed, key and use, so that any engine can draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.lit(use)).cast("binary")), 1, 8), 16, 10).cast("long")


def corrupt_payload(payload: str, event_type: str, key: str, seed: int):
    """I4 as a column: pick one present top-level numeric field by hash; half the time null it,
    else make it −|v|.  Top-level field names never collide with nested line fields."""
    fields = {et: numeric_fields(et) for et in REGISTRY}
    m = F.create_map(*[x for et, fs in fields.items() if fs
                       for x in (F.lit(et), F.array(*[F.lit(f) for f in fs]))])
    cands = F.coalesce(m[F.col(event_type)], F.array().cast("array<string>"))
    present = F.filter(cands, lambda f: F.regexp_like(F.col(payload), F.concat(F.lit('"'), f, F.lit('":-?[0-9]'))))
    h = _number(key, seed, "field")
    field = F.element_at(present, (h % F.greatest(F.size(present), F.lit(1))).cast("int") + 1)
    to_null = _number(key, seed, "mode") % 2 == 0
    pattern = F.concat(F.lit('"'), field, F.lit('":-?([0-9][0-9.eE+-]*)'))
    repl = F.when(to_null, F.concat(F.lit('"'), field, F.lit('":null'))).otherwise(
        F.concat(F.lit('"'), field, F.lit('":-$1')))
    out = F.regexp_replace(F.col(payload), pattern, repl)
    return F.when(F.size(present) > 0, out).otherwise(F.col(payload))


def inject_noise(log: DataFrame, cfg: NoiseConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (noisy log, counts per kind).  Counts: out_of_order, corrupt, late, rows."""
    cfg = cfg or NoiseConfig()
    total = log.count()
    eligible = log if cfg.since is None else log.filter(F.col("timestamp") >= F.to_timestamp(F.lit(cfg.since)))
    n_oor = int(total * cfg.out_of_order_rate)
    n_cor = max(1, int(total * cfg.corruption_rate))
    n_late = int(total * cfg.late_arrival_rate)
    seeds = {"_oor": cfg.seed * 3 + 1, "_cor": cfg.seed * 3 + 2, "_late": cfg.seed * 3 + 3}
    shifts = {seeds["_oor"]: n_oor, seeds["_late"]: n_late}
    if cfg.since is None:
        bounds = hash_bounds(log, "event_id", {**shifts, seeds["_cor"]: n_cor})
    else:
        bounds = {**hash_bounds(eligible, "event_id", shifts), **hash_bounds(log, "event_id", {seeds["_cor"]: n_cor})}

    def picked(kind: str):
        if bounds[seeds[kind]] is None:
            return F.lit(False)
        own, last = F.struct(hash_key(F.col("event_id"), seeds[kind]), F.col("event_id")), bounds[seeds[kind]]
        return F.col("event_id").isNotNull() & (own <= F.struct(*[F.lit(x).cast("string") for x in last]))  # without an id: never

    j = log
    if cfg.since is not None:  # a late row of an id that also came before: only rows of small hashes look for their id
        shifted = picked("_oor") | picked("_late")
        ids = eligible.filter(shifted).select("event_id").distinct().withColumn("_in", F.lit(True))
        j = log.filter(~shifted).withColumn("_in", F.lit(None).cast("boolean")).unionByName(log.filter(shifted).join(ids, "event_id", "left"))
    inside = F.lit(True) if cfg.since is None else F.coalesce("_in", F.lit(False))
    j = j.withColumns({k: F.when(picked(k) if k == "_cor" else picked(k) & inside, True) for k in seeds})
    ts = F.col("timestamp")
    ts = F.when(F.col("_oor"), ts - F.make_dt_interval(F.lit(0), F.lit(cfg.out_of_order_hours))).otherwise(ts)
    ts = F.when(F.col("_late"), ts - F.make_dt_interval(F.lit(cfg.late_arrival_days))).otherwise(ts)
    payload = F.when(F.col("_cor"), corrupt_payload("payload", "event_type", "event_id", cfg.seed)).otherwise(
        F.col("payload"))
    noisy = j.withColumn("timestamp", ts).withColumn("payload", payload)
    counts = j.agg(
        F.count_if(F.col("_oor").isNotNull()).alias("out_of_order"),
        F.count_if(F.col("_cor").isNotNull()).alias("corrupt"),
        F.count_if(F.col("_late").isNotNull()).alias("late"),
        F.count(F.lit(1)).alias("rows"),
    )
    return noisy.select(*ENVELOPE_COLS), counts
