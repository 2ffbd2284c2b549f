"""Helpers shared by the operators: reading tables, stored intermediates, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Any path Spark can read: nothing here opens the folder itself."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back: cuts the lineage, and
    a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``max_bytes`` of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n.astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # workers are reused: later tasks need not carry this one's buffers


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; only the last, maybe unfinished group is
    carried over, so memory is one batch plus one group."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = t.column(key)
        last = keys[t.num_rows - 1]
        lo, hi = 0, t.num_rows - 1  # first row of the last group, by bisection (the keys are sorted)
        while lo < hi:
            mid = (lo + hi) // 2
            if keys[mid].as_py() == last.as_py():
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield t.slice(0, lo)
        rest = t.slice(lo)
    if rest is not None and rest.num_rows:
        yield rest
    pa.default_memory_pool().release_unused()
