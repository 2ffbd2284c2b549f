import numpy as np
import pytest

from wholesail.llm import near_cross_polytope as N
from wholesail.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    ok = {r[0]: r for r in ok}
    ids = sorted(ok)
    n, parent = {i: 0 for i in ids}, {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        x = np.array(ok[i][1], dtype=float)
        for j in ids[k + 1 :]:
            y = np.array(ok[j][1], dtype=float)
            if ok[i][2] == ok[j][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in ids}


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        centre = rng.normal(size=64)
        for _ in range(12):  # cosines to each other from about 0.85 to 0.99
            rows.append(centre + rng.normal(size=64) * rng.choice([0.05, 0.15, 0.3]))
    rows += [rng.normal(size=64) for _ in range(200)]
    out = [(i, np.float32(x).tolist(), i % 2) for i, x in enumerate(rows)]
    same = np.float32(rng.normal(size=64)).tolist()
    out += [(1000 + i, same, 0) for i in range(30)] + [(1100 + i, same, 1) for i in range(5)]
    out += [(2000, [0.0] * 64, 0), (2001, None, 0), (2002, same, None), (2003, [float("nan")] + same[1:], 0), (2004, [None] + same[1:], 0),
            (2005, [float("inf")] + same[1:], 0), (2006, [], 0), (2007, [-x for x in same], 0), (2008, [2 * x for x in same], 0), (2009, same[:3], 0), (2010, same[:3], 0)]
    return out


@pytest.mark.parametrize("block", [2048, 4])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = vectors()
    want = brute(rows)
    out = N.links(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert got == {r[0]: want.get(r[0], (0, r[0])) for r in rows}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    p, q = N.buckets(a), N.buckets(b)
    met = (q == p[:, :, :1]).any(2) | (p == q[:, :, :1]).any(2)
    assert met.any(1).mean() > 0.999


def test_repeated_rows_null_ids_extra_columns(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(1, same, 0), (1, same, 0), (2, same, 0), (None, same, 0), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' k1", "'b' code", "'c' id", "'d' t")
    out = sorted((tuple(r) for r in N.links(df).collect()), key=repr)
    assert out == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (None, 0, None, True)], key=repr)
    assert N.links(df.limit(0)).count() == 0


def test_test_data(spark):
    from pyspark.sql import functions as F

    v = table(spark, "/root/testdata/sf0.001", "embeddings")
    near = v.select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(1.5).cast("float")).alias("embedding"), "label")
    out = N.links(v.unionAll(near)).collect()
    assert all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] % 10_000 for r in out)
