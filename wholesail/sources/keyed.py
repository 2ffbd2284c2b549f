"""A keyed target that is looked back at without being read whole.

Rows lie in ``bucket=<hash of the key>/batch=<writer's batch>``.  Beside them ``_keys`` holds a Bloom filter of the keys of
every such folder.  Before a batch is written, the filters say which folders may hold one of its keys, and only the key
column of those is read.  Spark reads the target as a plain parquet folder (names that begin with ``_``
are no data).

A batch owns its partitions: looking back passes over them and writing replaces them, so a batch repeated after a
failure at any point ends with the same rows.  ``batch`` must therefore name one stream's batch and no other.

``compact`` merges the files of buckets that hold many.  It notes what it does first; ``claim`` and ``compact`` finish
or undo what an earlier run left half done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from . import files

BUCKETS = 16
BITS = 1 << 15  # of one bitmap (Spark's bitmap functions)
BITS_PER_KEY = 12
PROBES = 4
FILTER = "bucket int, segments long, segment long, block binary, batch string"
MOST_BATCHES = 16  # in a bucket before compaction


class Scratch:
    """Intermediate results in the shared checkpoint folder, removed when the work that needs them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    s = Scratch(spark)
    try:
        yield s
    finally:
        files.delete(spark, s.path)


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _hashed(key: str, segments: Column) -> list[Column]:
    """A key's place in a filter of ``segments`` bitmaps: one bitmap, and the numbers its probes' bits are drawn from."""
    k = F.col(key).cast("string")
    at = F.xxhash64(F.lit(1), k)
    odd = F.xxhash64(F.lit(2), k).bitwiseAND(F.lit((1 << 40) - 1)).bitwiseOR(F.lit(1))
    return [F.pmod(F.xxhash64(F.lit(3), k), segments).alias("segment"), at.bitwiseAND(F.lit((1 << 40) - 1)).alias("h1"), odd.alias("h2")]


def _bit(probe: int) -> Column:
    """Bit of the key's bitmap that probe ``probe`` looks at."""
    return F.pmod(F.col("h1") + F.lit(probe) * F.col("h2"), F.lit(BITS))


def filters(rows: DataFrame, key: str) -> DataFrame:
    """``bucket, segments, segment, block``: a Bloom filter of the keys of each bucket of ``rows(bucket, key)``, in bitmaps of ``BITS``.
    All probes of a key lie in one bitmap, so that a look-up meets one row."""
    sizes = rows.groupBy("bucket").agg((F.floor(F.count("*") * BITS_PER_KEY / BITS) + 1).cast("long").alias("segments"))
    own = rows.select("bucket", key).join(F.broadcast(sizes), "bucket")  # one row per bucket
    at = own.select("bucket", "segments", *_hashed(key, F.col("segments"))).select(
        "bucket", "segments", "segment", F.explode(F.array(*[_bit(i) for i in range(PROBES)])).alias("at"))
    # bitmap_bit_position numbers from 1 on
    return at.groupBy("bucket", "segments", "segment").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("block"))


def candidates(keys: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``bucket, batch`` of those ``known(bucket, batch, segments, segment, block)`` that may hold one of ``keys(bucket, key)``."""
    sizes = known.select("bucket", "batch", "segments").distinct()  # one row per folder
    met = keys.select("bucket", key).join(F.broadcast(sizes), "bucket").select("bucket", "batch", *_hashed(key, F.col("segments")))
    hit = met.join(known.select("bucket", "batch", "segment", "block"), ["bucket", "batch", "segment"])

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("block", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    for i in range(PROBES):
        hit = hit.filter(is_set(_bit(i)))
    # filters written before there were blocks may hold any key
    older = known.filter(F.col("block").isNull()).select("bucket", "batch")
    return hit.select("bucket", "batch").union(older).distinct()


def _listed(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The batches in every bucket folder, by the folders' names."""
    if not files.exists(spark, path):
        return {}
    buckets = [n for n in files.names(spark, path) if n.startswith("bucket=")]
    return {b: [n for n in files.names(spark, f"{path}/{b}") if n.startswith("batch=")] for b in buckets}


def _write(spark: SparkSession, rows: DataFrame, path: str, key: str, batch: str) -> None:
    """Replace the batch's partitions by ``rows(bucket, ..)`` and its filters by theirs."""
    named = rows.withColumn("batch", F.lit(batch))
    named.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    filters(rows, key).coalesce(1).write.mode("overwrite").parquet(f"{path}/_keys/batch={batch}")


def claim(spark: SparkSession, rows: DataFrame, path: str, key: str, batch: str, buckets: int = BUCKETS) -> DataFrame:
    """Write those of ``rows`` (one per key, no null keys) whose key no other batch has written, and return them.  ``batch``
    may hold what a file name may."""
    path, batch = path.rstrip("/"), f"b-{batch}"  # never read as a number
    _recover(spark, path)
    with scratch(spark) as s:
        new = s.keep(rows.withColumn("bucket", bucket_of(key, buckets)))
        found = _look_back(spark, new, path, key, batch)
        if found:
            seen = spark.read.option("basePath", path).parquet(*found).select(key)
            new = s.keep(new.join(seen, key, "left_anti"))
        _write(spark, new, path, key, batch)
    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).parquet(path).filter(F.col("batch") == batch).select(*rows.columns)


def _look_back(spark: SparkSession, new: DataFrame, path: str, key: str, batch: str) -> list[str]:
    """Folders of other batches that may hold a key of ``new``; one without a filter may hold any."""
    there = {(b, n) for b, ns in _listed(spark, path).items() for n in ns if n != f"batch={batch}"}
    if not there:
        return []
    keys = f"{path}/_keys"
    filtered = set(files.names(spark, keys)) - {f"batch={batch}"} if files.exists(spark, keys) else set()
    filtered = {n for n in filtered if n.startswith("batch=")}
    hits = set()
    if filtered:
        known = spark.read.schema(FILTER).option("basePath", keys).parquet(*[f"{keys}/{n}" for n in sorted(filtered)])
        hits = {(f"bucket={r['bucket']}", f"batch={r['batch']}") for r in candidates(new, known, key).collect()}
    return sorted(f"{path}/{b}/{n}" for b, n in there if n not in filtered or (b, n) in hits)


def compact(spark: SparkSession, path: str, key: str, most_batches: int = MOST_BATCHES) -> int:
    """Merge the batches of every bucket that holds more than ``most_batches``; returns the number of such buckets.  No
    writer may be at work meanwhile."""
    path = path.rstrip("/")
    _recover(spark, path)
    full = {b: ns for b, ns in _listed(spark, path).items() if len(ns) > most_batches}
    if not full:
        return 0
    batch = f"compact-{uuid.uuid4().hex}"
    old = sorted(f"{path}/{b}/{n}" for b, ns in full.items() for n in ns)
    files.write_text(spark, f"{path}/_compaction.json", json.dumps({"batch": batch, "old": old, "buckets": sorted(full)}))
    with scratch(spark) as s:
        rows = s.keep(spark.read.option("basePath", path).parquet(*old).drop("batch"))
        _write(spark, rows, path, key, batch)
    files.write_text(spark, f"{path}/_compaction.done", batch)
    _recover(spark, path)
    return len(full)


def _recover(spark: SparkSession, path: str) -> None:
    """Finish a compaction whose files are complete, undo one whose files are not."""
    note, done = f"{path}/_compaction.json", f"{path}/_compaction.done"
    if not files.exists(spark, note):
        files.delete(spark, done)
        return
    plan = json.loads(files.read_text(spark, note))
    if files.exists(spark, done):
        for f in plan["old"]:
            files.delete(spark, f)
    else:
        for b in plan["buckets"]:
            files.delete(spark, f"{path}/{b}/batch={plan['batch']}")
        files.delete(spark, f"{path}/_keys/batch={plan['batch']}")
    files.delete(spark, note)
    files.delete(spark, done)
