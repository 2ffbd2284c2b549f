"""Table I/O: driver tables, projected-table read/write, directory loading."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from . import files

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def to_utc(df: DataFrame) -> DataFrame:
    """Driver timestamps are TIMESTAMP_NTZ; watermarks and epoch math need TIMESTAMP (UTC session)."""
    cols = [
        F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def to_output(df: DataFrame) -> DataFrame:
    """Final projection for results: timestamps as naive UTC wall clock (what DuckDB returns)."""
    cols = [
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return to_utc(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


class Tables:
    """Lazy accessor for the driver tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = load_table(self.spark, self.sf_dir, name)
        return self._cache[name]


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = (), compression: str = "snappy") -> int:
    """Overwrite one parquet table and report its row count (read back from the written files)."""
    w = df.write.mode("overwrite").option("compression", compression)
    parts = list(partition_by)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return df.sparkSession.read.parquet(path).count()


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a projected table; an absent table is an empty frame with the contract schema."""
    if files.exists(spark, path):
        return to_utc(spark.read.parquet(path))
    if schema is None:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def load_dir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every ``<name>.parquet`` (file or folder) under ``path`` → {name: DataFrame}."""
    out = {}
    for entry in files.names(spark, path):
        if entry.endswith(".parquet"):
            out[entry[: -len(".parquet")]] = to_utc(spark.read.parquet(os.path.join(path, entry)))
    return out


def best_source(spark: SparkSession, name: str, full_dir: str, sample_dir: str) -> str:
    """Prefer the full table, else the sample."""
    full = os.path.join(full_dir, f"{name}.parquet")
    return full if files.exists(spark, full) else os.path.join(sample_dir, f"{name}.parquet")


def bulk_keyed_load(df: DataFrame, path: str, key: str, order: str | Sequence[str], limit: int | None = None) -> int:
    """Load items keyed by ``key``: of several puts of a key the last by ``order`` stays (rows equal in it: the one whose
    other columns come last), optionally only the first ``limit`` keys in key order.  Rows without a key are not loaded."""
    cols = [F.col(c) for c in df.columns]
    by = [F.col(c) for c in ([order] if isinstance(order, str) else order)]
    last = F.max_by(F.struct(*cols), F.struct(*by, *[c.cast("string") for c in cols]))
    d = df.filter(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_r")).select("_r.*")
    if limit is not None:
        d = d.orderBy(key).limit(limit)
    return write_table(d, path)
