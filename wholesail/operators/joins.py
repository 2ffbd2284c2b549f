"""D1–D11 join helpers: size-checked broadcast, semi/anti membership, dependency chains.

Broadcast is never assumed: ``broadcast_if_small`` reads the optimizer's size estimate of the plan and only hints a
broadcast under the limit; otherwise the join stays a shuffle join and AQE may still convert it at runtime from
exact shuffle statistics.  For parquet the estimate is the files' compressed size, in memory it may be several
times that, so the limit is far below what an executor could hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def plan_size_bytes(df: DataFrame) -> int | None:
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001  (Spark Connect or unknown stats)
        return None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    size = plan_size_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df


def dim_join(fact: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "left",
             limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Fact ⟕ dimension; the dimension is broadcast only if its estimated size is under ``limit``."""
    return fact.join(broadcast_if_small(dim, limit), on, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null (``using`` joins lose such rows)."""
    own = {k: f"_right_{k}" for k in keys}
    r = right.select(*[F.col(c).alias(own.get(c, c)) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(own[k])) for k in keys])
    return left.join(r, on, how).drop(*own.values())
