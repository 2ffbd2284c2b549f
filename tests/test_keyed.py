"""Keyed targets: the look-back reads few files, batches may be repeated, compaction survives being cut short."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wholesail.sources import files, keyed


def folder():
    return tempfile.mkdtemp(prefix="wholesail-test-keyed-", dir="/tmp") + "/t"


def batch(spark, lo, hi, tag="x"):
    return spark.range(lo, hi).selectExpr("concat('k', id) key", f"concat('{tag}', id) value")


def rows(spark, path):
    return sorted((r["key"], r["value"]) for r in spark.read.parquet(path).collect())


def test_first_write_wins_and_batches_repeat(spark):
    path = folder()
    assert keyed.claim(spark, batch(spark, 0, 50), path, "key", "0").count() == 50
    for _ in range(2):  # the second batch and its replay
        got = keyed.claim(spark, batch(spark, 40, 70, "y"), path, "key", "1")
        assert sorted(r["key"] for r in got.collect()) == sorted(f"k{i}" for i in range(50, 70)) and got.columns == ["key", "value"]
    assert keyed.claim(spark, batch(spark, 0, 50), path, "key", "0").count() == 50  # a replay of the first
    assert rows(spark, path) == sorted([(f"k{i}", f"x{i}") for i in range(50)] + [(f"k{i}", f"y{i}") for i in range(50, 70)])
    assert keyed.claim(spark, batch(spark, 0, 0), path, "key", "2").count() == 0
    assert keyed.claim(spark, batch(spark, 0, 0), folder(), "key", "0").count() == 0


def test_look_back_reads_only_files_that_may_hold_a_key(spark):
    path = folder()
    for b in range(6):
        keyed.claim(spark, batch(spark, 1000 * b, 1000 * b + 400), path, "key", str(b))
    names = lambda new, name: keyed._look_back(spark, new.withColumn("bucket", keyed.bucket_of("key")), path, "key", name)
    assert sum(map(len, keyed._listed(spark, path).values())) > 90
    assert len(names(batch(spark, 50_000, 50_040), "b-9")) <= 4  # unknown keys: false hits only
    one = names(batch(spark, 2005, 2006), "b-9")
    assert 1 <= len(one) <= 2 and any(f.endswith("/batch=b-2") for f in one)
    assert names(batch(spark, 2005, 2006), "b-2") == []  # a batch does not look at itself
    files.delete(spark, f"{path}/_keys/batch=b-2")  # written, but its filters were not
    assert keyed.claim(spark, batch(spark, 2005, 2010), path, "key", "9").count() == 0


def test_filters_have_no_false_negatives(spark):
    some = batch(spark, 0, 9000).selectExpr("key", "1 bucket")
    f = keyed.filters(some, "key").selectExpr("*", "'f' batch").cache()
    assert f.select("segment").distinct().count() == f.first()["segments"] == 1 + 9000 * keyed.BITS_PER_KEY // keyed.BITS
    for lo in (0, 4000, 8990):
        assert keyed.candidates(batch(spark, lo, lo + 1).selectExpr("key", "1 bucket"), f, "key").count() == 1
    missed = sum(keyed.candidates(batch(spark, 20_000 + i, 20_001 + i).selectExpr("key", "1 bucket"), f, "key").count() for i in range(12))
    assert missed <= 2


def test_compaction(spark, monkeypatch):
    path = folder()
    for b in range(5):
        keyed.claim(spark, batch(spark, 100 * b, 100 * b + 90), path, "key", str(b), buckets=2)
    before = rows(spark, path)
    delete = files.delete
    monkeypatch.setattr(keyed, "_write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        keyed.compact(spark, path, "key", most_batches=3)
    monkeypatch.undo()
    assert rows(spark, path) == before and os.path.exists(f"{path}/_compaction.json")
    calls = []

    def dies(spark, p):
        if "/bucket=" in p and calls.append(p) is None and len(calls) > 3:
            raise OSError("lost")
        delete(spark, p)

    monkeypatch.setattr(files, "delete", dies)
    with pytest.raises(OSError):
        keyed.compact(spark, path, "key", most_batches=3)
    monkeypatch.undo()
    assert keyed.compact(spark, path, "key", most_batches=3) == 0  # only finishes the one before
    assert rows(spark, path) == before and sum(map(len, keyed._listed(spark, path).values())) == 2
    assert keyed.claim(spark, batch(spark, 0, 500, "z"), path, "key", "9", buckets=2).count() == 50


def test_scratch_is_removed(spark):
    with keyed.scratch(spark) as s:
        assert s.keep(spark.range(3)).count() == 3 and files.exists(spark, s.path)
    assert not files.exists(spark, s.path)


def test_a_look_up_meets_one_bitmap_row_per_key(spark):
    """All probes of a key lie in one bitmap; a filter without blocks (an older layout) may hold any key."""
    some = batch(spark, 0, 9000).selectExpr("key", "1 bucket")
    f = keyed.filters(some, "key").selectExpr("*", "'f' batch").cache()
    in_block = some.join(f.select("bucket", "segments").distinct(), "bucket").select(*keyed._hashed("key", F.col("segments")))
    per = {r["segment"]: r["n"] for r in f.selectExpr("segment", "bitmap_count(block) n").collect()}
    for seg, n in in_block.groupBy("segment").count().collect():
        assert per[seg] <= keyed.PROBES * n
    assert keyed.candidates(some, f, "key").count() == 1
    older = f.selectExpr("bucket", "segments", "segment", "cast(null as binary) block", "batch")
    assert keyed.candidates(batch(spark, 90_000, 90_001).selectExpr("key", "1 bucket"), older, "key").count() == 1
