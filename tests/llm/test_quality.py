import zlib

import numpy as np

from wholesail.llm import quality_pu as Q
from wholesail.llm.common import table

from . import data


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = Q.score(docs, Q.train(docs, labels, max_rows=3000)).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(held) > 500
    assert (held.predicted == held.quality).mean() > 0.98
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.99


def test_non_negative_risk_needs_no_negatives():
    rng = np.random.default_rng(1)
    good = rng.normal(0, 1, (3000, Q.N_FEATURES))
    bad = rng.normal(0, 1, (3000, Q.N_FEATURES))
    bad[:, :5] += 3
    model = Q.fit(good[:1500], np.concatenate([good[1500:], bad[:750]]), prior=2 / 3)
    assert (model.score(good) >= 0.5).mean() > 0.9 and (model.score(bad[750:]) >= 0.5).mean() < 0.1


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels").toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in labels.doc_id])
    turned = labels.copy()
    turned.loc[fold, "quality"] = 1 - turned.loc[fold, "quality"]
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    a = Q.score(docs, Q.train(docs, spark.createDataFrame(labels)))
    b = Q.score(other, Q.train(other, spark.createDataFrame(turned)))
    assert data.rows_of(a) == data.rows_of(b)
    assert {r["doc_id"]: r["held_out"] for r in a.collect()} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs.collect()}


def test_edge_rows(spark):
    docs = data.docs(spark, clash=True)
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (3, 0, 0), (None, 1, 0), (5, None, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    out = Q.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    kept = Q.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in out)
    nothing = data.docs(spark, [])
    assert Q.score(nothing, Q.train(nothing, labels.limit(0))).count() == 0
    assert 0 < Q.train(docs, labels.limit(0)).prior < 1
