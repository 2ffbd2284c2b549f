import numpy as np
import pytest

from wholesail.llm import exact_dual_tree as N

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    ok = {r[0]: np.floor(np.array(r[1], dtype=np.float32).astype(float) * 256) for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])}
    out = []
    for q in ok:
        if q % every == 0:
            best = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def clustered(seed=1, n=1200, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = [(i, (centres[i % 8] + rng.normal(size=d) * 0.05).tolist()) for i in range(n)]
    return rows + [(n + i, rng.normal(size=d).tolist()) for i in range(200)]


@pytest.mark.parametrize("block", [4096, 60])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = clustered()
    got = sorted(map(tuple, N.search(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))
    assert got == brute(rows)


def test_ties_copies_and_rows_without_part(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(0, 140)] + [(200, [0.0, 0.0, 0.0]), (250, None), (300, [float("nan")] * 3), (350, [None, 1.0, 1.0]), (None, same), (400, [1.0]), (450, [])]
    rows += [(0, same)]  # a repeated row
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' q", "'b' block", "'c' cell", "'d' score")
    got = sorted(map(tuple, N.search(df).collect()))
    assert got == brute(rows) and [r for r in got if r[0] == 50][0][2] == 0
    assert N.search(df.limit(0)).count() == 0


def quantised(rows):
    return np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64)


def spread(noise, n=4000, d=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    return np.floor((centres[rng.integers(0, 40, n)] + rng.normal(size=(n, d)) * noise) * 256).astype(np.int64)


def count(node):
    return 1 + sum(count(c) for c in node.children)


def evaluated(x, queries):
    """Share of all (query, vector) pairs whose product is computed, and the best scores."""
    tree, q = N.CoverTree(x), N.CoverTree(x[:queries])
    seen, best = [], N.Best(queries, 5)
    offer = best.offer
    best.offer = lambda at, s, ids: (seen.append(s.size), offer(at, s, ids))
    N.dual_search(q, q.order, tree, tree.order, best)
    full = q.x @ tree.x.T
    full[q.order[:, None] == tree.order[None, :]] = N.NONE
    assert (best.score == np.sort(full, axis=1)[:, :-6:-1]).all()
    return sum(seen) / (queries * len(x))


@pytest.mark.parametrize("x", [quantised(clustered(n=4000)), spread(0.3), spread(5.0), np.repeat(spread(0.3, 40), 50, axis=0)])
def test_tree_invariants(x):
    tree = N.CoverTree(x)
    leaves = []

    def walk(node, depth):
        own = tree.f[node.lo : node.hi]
        centre = x[node.row].astype(float)
        assert N._gaps(own, centre).max() <= node.radius + 1e-6 and N._gaps(own, node.mid).max() <= node.reach + 1e-6  # covering
        assert (own == centre).all(1).any()
        if node.children:
            assert [c.lo for c in node.children] == [node.lo] + [c.hi for c in node.children[:-1]] and node.children[-1].hi == node.hi
            centres = np.stack([x[c.row] for c in node.children]).astype(float)
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e12
            assert gaps.min() >= max(c.radius for c in node.children) - 1e-6  # separation
            assert node.children[0].row == node.row and 2 <= len(node.children) <= N.MOST_FAN  # nesting
            for c in node.children:
                walk(c, depth + 1)
        else:
            assert node.hi - node.lo <= N.LEAF or node.radius == 0
            leaves.append(depth)

    walk(tree.root, 0)
    assert len(leaves) >= 16 and max(leaves) >= 2


def test_pruning_follows_the_clusters():
    assert evaluated(quantised(clustered(n=4000)), 200) < 0.35
    assert evaluated(spread(0.3), 200) < 0.25
    assert evaluated(spread(0.05), 200) < 0.15


def test_stored_tree_is_the_tree():
    tree = N.CoverTree(quantised(clustered(n=2000)))
    again = N.CoverTree.stored(tree.x, tree.arrays())
    flat = lambda n: [(n.lo, n.hi, n.radius, n.reach, n.mid.tolist()), *(y for c in n.children for y in flat(c))]
    got, want = flat(again.root), flat(tree.root)
    assert len(want) > 30 and [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**31), 2**31, (20, 64))
    b = rng.integers(-300, 300, (30, 64))
    b[3] = rng.integers(-(2**28), 2**28, 64)
    a[5] = rng.integers(-90, 90, 64)
    a[6] = np.iinfo(np.int64).max
    a[7] = np.iinfo(np.int64).min
    true = a.astype(object) @ b.T.astype(object)
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    assert (N.products(a, b) == np.clip(true, low, high).astype(np.int64)).all()
    assert N.products(a[:0], b).shape == (0, 30)


def test_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(1000 + i, (rng.normal(size=6) * 1e6).tolist()) for i in range(10)] + [(1050, [1e30] + [0.0] * 5), (1100, [-1e30] * 6)]
    got = sorted(map(tuple, N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    q = {i: [max(-(2**63), min(2**63 - 1, int(np.floor(np.float64(x) * 256)))) for x in v] for i, v in rows}
    want = []
    for i in q:
        if i % 50 == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(q[i], q[j], strict=True)))), j) for j in q if j != i)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
    assert got == sorted(want)


@pytest.mark.parametrize("block", [30, 200])
def test_cells_are_parted_by_distance(spark, monkeypatch, block):
    monkeypatch.setattr(N, "MOST_PIVOTS", 4)
    rows = clustered(n=600) + [(5000 + i, [1.0] * 16) for i in range(90)] + [(6000 + i, [0.5, float(i)]) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = N._with_cells(N.quantised(df), block).cache()
    got = cells.collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["cell"], set()).add(tuple(r["q"]))
        assert r["path"][-1] == r["cell"] and len(set(r["path"])) == len(r["path"])
    n = {c: sum(r["cell"] == c for r in got) for c in sizes}
    assert len(got) == len(rows) and all(n[c] <= block or len(v) == 1 for c, v in sizes.items())  # only equal vectors stay together
    assert max(len(r["path"]) for r in got) >= 3
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, N.search(df).collect())) == brute(rows)
