import inspect
import random

import numpy as np

from wholesail.llm import toxicity_chain as C
from wholesail.llm.common import table

from . import data


def test_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    chain = C.train(docs, labels, max_rows=2500)
    out = C.score(docs, chain).join(labels.withColumnRenamed("toxic", "truth"), "doc_id")
    held = out.filter(C.held_out(out["doc_id"])).toPandas()
    assert held.toxic[held.truth == 1].mean() > 0.8 and held.toxic[held.truth == 0].mean() < 0.02
    plain = docs.toPandas().set_index("doc_id").text
    found = C.Tokens()
    want = chain.predict([found.of(plain[i]) for i in held.doc_id])
    assert np.allclose(held[[f"p_{n}" for n in chain.names]].to_numpy(), want)


def sets(n, seed):
    rng = random.Random(seed)
    first = [rng.random() < 0.3 for _ in range(n)]
    # the second category follows the first, which shows, and has no token of its own
    features = [{rng.randrange(1000, 1200) for _ in range(20)} | ({7} if a and rng.random() < 0.9 else set()) for a in first]
    y = np.array([[int(a), int(a if rng.random() < 0.95 else not a)] for a in first])
    return features, [np.array(sorted(f), dtype=np.int32) for f in features], y


def test_later_models_use_earlier_probabilities():
    _, f, y = sets(1500, 1)
    chain = C.fit(f, y, ("a", "b"), np.arange(1500) % C.FOLDS)
    assert chain.weights[1, len(chain.columns)] > 0.3  # the first category's probability counts in the second
    g, _, z = sets(600, 2)
    p = chain.predict(g)
    assert ((p[:, 1] >= 0.5) == z[:, 1]).mean() > 0.85


def test_thousands_of_significant_features_are_kept():
    bad, good = np.arange(3000, dtype=np.int32), np.arange(3000, 6000, 60, dtype=np.int32)
    y = np.array([[1], [0]] * 40)
    assert len(C.fit([bad, good] * 40, y, ("a",), np.arange(80) % C.FOLDS).columns) == 3050
    assert inspect.signature(C.train).parameters["max_rows"].default == 8_000


def test_one_class_or_nothing_gives_base_rates():
    s, f, y = sets(50, 3)
    assert (C.fit(f, y * 0, ("a", "b"), np.arange(50) % C.FOLDS).predict(s) < 0.01).all()
    assert C.fit([], np.zeros((0, 2), dtype=int), ("a", "b"), np.zeros(0, dtype=int)).predict([set()]).shape == (1, 2)


def test_edge_rows(spark):
    docs = data.docs(spark, clash=True)
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (5, 1, None), (None, 0, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    out = C.score(docs, C.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(r["toxic"] == (r["p_toxic"] >= C.THRESHOLD) for r in out)
    nothing = data.docs(spark, [])
    assert C.score(nothing, C.train(nothing, labels.limit(0))).count() == 0
