"""The stored log is built from numbers, written without a sort by type, and leaves no scratch behind."""

import glob
import os
import tempfile

import pyarrow.parquet as pq

from wholesail.operators import projections
from wholesail.session import checkpoint_dir
from wholesail.sources import adapter, logstore
from wholesail.sources.eventlog import LIFECYCLE_TYPES, ORDER_STATUS_TYPES, read_events
from wholesail.sources.tables import Tables

SF_TINY = "/root/testdata/sf0.001"


def test_lines_are_joined_as_numbers(spark):
    texts = [f.name for f in adapter.joined_lines(Tables(spark, SF_TINY)).schema.fields if f.dataType.simpleString() == "string"]
    assert texts == ["l_linestatus", "orderstatus"]


def test_log_is_written_compact_and_without_leftovers(spark):
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", 0)
    path = tempfile.mkdtemp(prefix="wholesail-test-log-", dir="/tmp") + "/log"
    kept = []

    def keep(df):
        kept.append(df.columns)
        return df

    log = adapter.event_log(Tables(spark, SF_TINY), keep)
    logstore.write_log(log, path)
    assert len(kept) == 1 and "order_id" not in kept[0]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    parts = glob.glob(f"{path}/event_type=OrderCreated/*.parquet")
    assert parts and {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in parts} == {"ZSTD"}
    assert spark.read.parquet(path).count() == log.count()
    before = set(os.listdir(checkpoint_dir(spark)))
    logstore.stored_log(spark, SF_TINY)
    assert not [n for n in set(os.listdir(checkpoint_dir(spark))) - before if not n.startswith("wholesail-log-")]


def small_source(tmp_path):
    """The tables under another name: a source whose log is not stored yet."""
    d = tmp_path / "src"
    d.mkdir()
    for t in logstore.SOURCE_TABLES:
        os.symlink(f"{SF_TINY}/{t}.parquet", d / f"{t}.parquet")
    return str(d)


def stored_types(spark, d):
    return {os.path.basename(p).removeprefix("event_type=") for p in glob.glob(f"{logstore.log_path(spark, d)}/parts=*/event_type=*")}


def test_a_table_stores_only_the_events_it_reads(spark, tmp_path):
    d = small_source(tmp_path)
    tables = projections.stored_projections(spark, d)
    assert tables["customers"].count() == 150
    assert stored_types(spark, d) <= set(LIFECYCLE_TYPES)
    assert tables["orders"].count() == 1500
    assert stored_types(spark, d) <= {*LIFECYCLE_TYPES, *ORDER_STATUS_TYPES, "OrderCreated"}
    # the whole log adds what is missing and holds every event once
    whole, derived = logstore.stored_log(spark, d), adapter.build_log(spark, d)
    assert len(glob.glob(f"{logstore.log_path(spark, d)}/parts=*")) == 3
    assert whole.exceptAll(derived).isEmpty() and derived.exceptAll(whole).isEmpty()
    assert logstore.stored_log(spark, d, ["CustomerSegmentChanged"]).count() == 0
    assert [r[0] for r in logstore.stored_log(spark, d, ["AppError"]).select("event_type").distinct().collect()] == ["AppError"]


def test_half_written_parts_are_written_again(spark, tmp_path):
    d = small_source(tmp_path)
    n = logstore.stored_log(spark, d, ["OrderCreated"]).count()
    (folder,) = glob.glob(f"{logstore.log_path(spark, d)}/parts=*")
    os.remove(f"{folder}/_SUCCESS")
    assert n == 1500 and logstore.stored_log(spark, d, ["OrderCreated"]).count() == n
    assert os.path.exists(f"{folder}/_SUCCESS")


def test_parts_hold_every_type_of_the_log(spark):
    log = adapter.build_log(spark, SF_TINY)
    for name, (_, _, types) in adapter.PARTS.items():
        assert {r[0] for r in adapter.event_log(Tables(spark, SF_TINY), None, [name]).select("event_type").distinct().collect()} <= set(types)
    known = [t for _, _, types in adapter.PARTS.values() for t in types]
    assert len(known) == len(set(known)) and log.filter(~log.event_type.isin(known)).isEmpty()


def test_projections_name_all_events_they_read(spark):
    log = logstore.stored_log(spark, SF_TINY)
    assert list(projections.READS) == list(projections.PROJECTIONS)
    for name, make in projections.PROJECTIONS.items():
        a, b = (sorted(map(str, make(x).collect())) for x in (log, read_events(log, *projections.READS[name])))
        assert a and a == b, name


def test_orders_group_their_lines_where_the_join_left_them(spark):
    """Shuffles of the lines: one by part (none where it is broadcast) and one by order, which the grouping uses too."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = adapter.order_created(Tables(spark, SF_TINY))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == 5  # lines by part and by order, the part, the orders twice
