"""Orders are stored with their fields as columns for readers that take single fields; their text is made from those."""

import glob

from pyspark.sql import functions as F

from test_logstore import small_source
from wholesail.operators import projections
from wholesail.operators.stats import bin_by_breaks
from wholesail.sources import adapter, logstore
from wholesail.sources.eventlog import typed

FIELDS = ["customer_id", "order_id", "total_value", "channel", "rep_id", "promotion_id", "fraud_score", "lines"]


def rows(df):
    return sorted(map(str, df.collect()))


def odd_source(spark, tmp_path):
    """Orders that come twice, have no lines or no customer, and lines of unknown parts and without numbers."""
    d = tmp_path / "odd"
    d.mkdir()
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    lines = [(1, 7, 1, 1, 3.0, 10.5, 0.05, 0.0, "N", "F", None), (1, 5, 1, 2, 46.0, 1 / 3, 0.0, 0.0, "N", "O", None), (1, 7, 1, 1, 3.0, 10.5, 0.05, 0.0, "N", "F", None),
             (2, 99, 1, 1, 2.0, float("nan"), None, 0.0, "N", "F", None), (3, None, 1, 1, None, 4e300, 0.07, 0.0, None, None, None), (8, 5, 1, 1, 1.0, 1.0, 0.1, 0.0, "N", "F", None)]
    spark.createDataFrame(lines, line).write.parquet(f"{d}/lineitem.parquet")
    orders = [(1, 4, "F", 21.0, "1-URGENT"), (2, 4, "O", 1e-7, "2-HIGH"), (2, 4, "O", 1e-7, "2-HIGH"), (3, None, "P", None, None), (4, 6, "F", float("inf"), "1-URGENT")]
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    o.withColumn("o_orderdate", F.expr("timestamp_ntz '1996-02-03 00:00:00'")).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(5, "a", "b", "c", 3), (7, "a", "b", "c", 40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    return str(d)


def test_tables_of_orders_store_no_text_of_their_lines(spark, tmp_path):
    d = small_source(tmp_path)
    tables = projections.stored_projections(spark, d)
    assert tables["rfm_scores"].count() and tables["order_lines"].count() and tables["orders"].count() == 1500
    assert tables["credit_ledger"].count() > 1500
    assert not glob.glob(f"{logstore.log_path(spark, d)}/parts=*/event_type=OrderCreated")
    assert len(glob.glob(f"{logstore.log_path(spark, d)}/fields=OrderCreated/_SUCCESS")) == 1
    log = adapter.build_log(spark, d)
    for name in ("rfm_scores", "order_lines", "orders", "credit_ledger"):
        assert rows(tables[name]) == rows(projections.PROJECTIONS[name](log)), name
    # a reader of the text: all lines of all orders are in it
    assert rows(logstore.stored_log(spark, d, ["OrderCreated"])) == rows(log.filter("event_type = 'OrderCreated'"))


def test_fields_are_what_their_text_says(spark, tmp_path):
    d = odd_source(spark, tmp_path)
    log = logstore.stored_log(spark, d, ["OrderCreated"], decoded=True)
    assert "OrderCreated" in log.columns and log.count() == 5
    own, text = typed(log, "OrderCreated", FIELDS), typed(log.drop("OrderCreated"), "OrderCreated", FIELDS)
    assert rows(own) == rows(text)
    got = {r["event_id"]: len(r["lines"]) for r in own.collect()}
    assert got == {"OC-1": 3, "OC-2": 2, "OC-3": 1, "OC-4": 0}  # an order that comes twice lists its lines twice
    skus = [[x["sku_id"] for x in r["lines"]] for r in own.filter("event_id = 'OC-1'").collect()]
    assert skus == [["SKU-5", "SKU-7", "SKU-7"]]
    # stored as text from the fields, it is the same log
    assert rows(logstore.stored_log(spark, d, ["OrderCreated"])) == rows(log.drop("OrderCreated"))


def test_bins_of_values_at_and_beside_breaks(spark):
    df = spark.createDataFrame([(None, [1.0, 1.0, 2.0]), (1.0, [1.0, 1.0, 2.0]), (1.5, [1.0, None, 2.0]), (float("nan"), [1.0, 1.0, 2.0]), (3.0, []), (3.0, None)], "v double, b array<double>")
    assert [r[0] for r in df.select(bin_by_breaks(F.col("v"), F.col("b"), ["a", "b", "c", "d"])).collect()] == ["a", "a", "b", "d", "a", None]
