"""Golden rows for the re-aimed engines, quintile binning and sampler arithmetic."""

import pytest
from pyspark.sql import functions as F

from wholesail.operators import features as L
from wholesail.operators import inventory as INV
from wholesail.operators.sampling import cap_sizes, stratified_split, SamplerConfig, TableSpec, JoinSpec
from wholesail.operators.stats import bin_by_breaks, exact_quantiles


@pytest.mark.parametrize("risk,count,value,avg,expected", [
    (0.5, 10, 1000.0, 5000.0, 0.515),
    (0.5, 1, 1000.0, 5000.0, 0.015),
    (0.8, 5, 50000.0, 10000.0, 0.324),
])
def test_fraud_score(spark, risk, count, value, avg, expected):
    df = spark.createDataFrame([(risk, count, value, avg)], "risk double, c long, v double, a double")
    got = df.select(L.fraud_score(F.col("c"), F.col("v"), F.col("a"), F.col("risk"))).first()[0]
    assert got == pytest.approx(expected)


def test_inventory_engine(spark):
    df = spark.createDataFrame([(1000.0,), (0.0,)], "d double")
    assert [r[0] for r in df.select(INV.eoq(F.col("d"))).collect()] == [200, 50]
    q = spark.range(1).select(INV.order_quantity(F.lit(200), F.lit(100.0), F.lit(50.0), F.lit(0.0), F.lit(30.0)))
    assert q.first()[0] == 200
    q = spark.range(1).select(INV.order_quantity(F.lit(100), F.lit(200.0), F.lit(50.0), F.lit(0.0), F.lit(30.0)))
    assert q.first()[0] == 180


@pytest.mark.parametrize("base,pct,cls,expected", [
    (100, 0.20, "B", 88), (1, 999.0, "C", 1), (100, 0.30, "A", 91), (100, 0.30, "C", 64), (100, 0.20, "?", 88),
])
def test_elasticity(spark, base, pct, cls, expected):
    df = spark.createDataFrame([(base, pct, cls)], "b long, p double, c string")
    assert df.select(INV.elastic_quantity(F.col("b"), F.col("p"), F.col("c"))).first()[0] == expected


def test_quintiles_golden(spark):
    df = spark.createDataFrame([(v,) for v in [0, 0, 0, 1, 5]], "x long")
    br = exact_quantiles(df, "x", [0.2, 0.4, 0.6, 0.8]).first()["breaks"]
    assert br == pytest.approx([0.0, 0.0, 0.4, 1.8])
    labels = df.crossJoin(exact_quantiles(df, "x", [0.2, 0.4, 0.6, 0.8])).select(
        bin_by_breaks(F.col("x").cast("double"), F.col("breaks"), ["5", "4", "3", "2", "1"])).collect()
    assert [r[0] for r in labels] == ["5", "5", "5", "2", "1"]


def test_cap_arithmetic():
    assert cap_sizes({"a": 12, "b": 6, "c": 2}, 10) == {"a": 6, "b": 3, "c": 1}
    assert cap_sizes({"a": 12, "b": 0}, 10) == {"a": 10, "b": 0}
    assert cap_sizes({"a": 3}, 10) == {"a": 3}


def test_split_parity(spark):
    df = spark.createDataFrame([(f"k{i}", "s") for i in range(5)], "k string, stratum string")
    out = stratified_split(df, ["stratum"], "k", 42).groupBy("_split").count().collect()
    assert {r["_split"]: r["count"] for r in out} == {1: 3, 0: 2}


def test_config_validation():
    T, J = TableSpec, JoinSpec
    with pytest.raises(ValueError):
        SamplerConfig(tables=[T("a"), T("b")]).validate()
    with pytest.raises(ValueError):
        SamplerConfig(tables=[T("a", split_anchor=True), T("s", static=True, join=J("a", "k"))]).validate()
    with pytest.raises(ValueError):
        SamplerConfig(tables=[T("a", split_anchor=True), T("c", join=J("b", "k")), T("b", join=J("a", "k"))]).validate()
    SamplerConfig(tables=[T("a", split_anchor=True), T("b", join=J("a", "k"))]).validate()
