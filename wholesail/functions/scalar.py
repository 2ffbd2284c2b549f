"""Scalar column helpers: value maps, time arithmetic, deterministic ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_HOUR = 3_600_000_000


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(index: Column, values: Sequence[str]) -> Column:
    """``values[index]`` for a 0-based integer column (a literal array lookup, no UDF)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def rec(**fields) -> Column:
    """A struct literal/expression with every field named (for candidate arrays)."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def map_values(c: str | Column, mapping: dict[str, str], default: str | Column | None = None) -> Column:
    """Literal map lookup with a default for unmapped keys (replaces a per-row lambda)."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    out = m[col_(c)]
    if default is None:
        return out
    return F.coalesce(out, default if isinstance(default, Column) else F.lit(default))


def plus_micros(ts: str | Column, micros: Column | int) -> Column:
    m = micros if isinstance(micros, Column) else F.lit(micros)
    return F.timestamp_micros(F.unix_micros(col_(ts)) + m.cast("long"))


def plus_days(ts: str | Column, days: Column | int) -> Column:
    d = days if isinstance(days, Column) else F.lit(days)
    return plus_micros(ts, d.cast("long") * MICROS_PER_DAY)


def plus_hours(ts: str | Column, hours: int) -> Column:
    return plus_micros(ts, hours * MICROS_PER_HOUR)


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole days between two timestamps, truncated toward zero (micros ``div``)."""
    diff = (F.unix_micros(col_(later)) - F.unix_micros(col_(earlier))).cast("long")
    return F.call_function("div", diff, F.lit(MICROS_PER_DAY))


def month_end_midnight(ts: str | Column) -> Column:
    """Last day of the month at 00:00."""
    return F.to_timestamp(F.last_day(col_(ts)))


def uuid5_dns(name: str | Column) -> Column:
    """RFC 4122 UUIDv5 in the DNS namespace, built from ``sha1`` — equals Python's ``uuid5``."""
    ns = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(ns, F.encode(col_(name).cast("string"), "UTF-8")))
    # version nibble (5) at hex position 12, variant bits (10xx) at position 16
    v = F.substring(h, 1, 12)
    ver = F.concat(F.lit("5"), F.substring(h, 14, 3))
    var_nib = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    var = F.concat(var_nib, F.substring(h, 18, 3))
    tail = F.substring(h, 21, 12)
    return F.concat_ws(
        "-", F.substring(v, 1, 8), F.substring(v, 9, 4), ver, var, tail
    )
