"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are quantised to integers.  A cover-tree node has a centre (one of its points) and a covering radius.  Its
children's centres, the node's own first, are taken farthest first, so that they lie at least as far apart as any point
lies from its nearest one; every point goes to its nearest.  A node takes ``FAN`` children, more only while one of
them would keep nearly all its points, down to leaves of ``LEAF`` points.  For bounds each node also has a ball around
the mean of its points.

The same division, on samples, cuts the table: cells of more than ``BLOCK`` vectors are split by pivots of their own until
none is left, each block of a cell gets its cover tree, and the balls of cells and blocks are the upper levels.

Search goes over pairs (query node, data node).  For balls (c, r) and (e, s) no inner product exceeds
``c.e + r|e| + s|c| + r s``; a pair below the worst k-th score of the query node's queries is pruned.
A first pass looks in a block of each query block's own cell, which gives thresholds; the second goes down the cells
level by level with each query block and meets the data blocks that no bound excludes.  Ties go to the
smaller id, so a bound equal to the threshold is not pruned.  The result is exact at any data; pruning depends on how
clustered the data are.

Of identical vectors only the k + 1 smallest ids can be among a query's k best (one may be the query), so the others
are set aside first: a hot vector does not make a hot block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_groups

SCALE = 256
K = 5
EVERY = 50
BLOCK = 4096
QUERY_BLOCK = 512
SAMPLE = 1024  # vectors of a cell that its pivots are taken from
MOST_PIVOTS = 64
MOST_LEVELS = 12
FAN = 8
MOST_FAN = 64
LEAF = 64
NONE = np.iinfo(np.int64).min  # no score


# -- trees in memory ---------------------------------------------------------------------------
@dataclass
class Node:
    lo: int
    hi: int
    row: int  # of the centre
    radius: float  # covering radius around it
    mid: np.ndarray  # the mean, with the ball around it
    reach: float
    length: float
    children: list[Node] = field(default_factory=list)


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def farthest_first(x: np.ndarray, first: int, fan: int, most: int, share: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres (rows of ``x``, ``first`` the first), the number of each row's nearest centre, and its distance.  ``fan`` of them, up to
    ``most`` while one centre has more than ``share`` of the rows; fewer if all rows are centres."""
    centres = [first]
    near, who = _gaps(x, x[first]), np.zeros(len(x), dtype=np.int64)
    while near.max() > 0 and len(centres) < most and (len(centres) < fan or np.bincount(who).max() > share * len(x)):
        far = int(near.argmax())
        d = _gaps(x, x[far])
        closer = d < near
        near, who = np.where(closer, d, near), np.where(closer, len(centres), who)
        centres.append(far)
    return centres, who, near


class CoverTree:
    """Cover tree over the rows of ``x`` (integers).  ``order`` lists the rows so that every node is a range of them; ``x`` and
    ``f`` (as doubles, for distances and bounds) are kept in that order."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.leaf = leaf
        f = x.astype(np.float64)
        self.root = self._build(f, 0, len(x), int(_gaps(f, f.mean(0)).argmax()))
        self.x, self.f = x[self.order], f[self.order]

    def _build(self, f: np.ndarray, lo: int, hi: int, row: int) -> Node:
        rows = self.order[lo:hi].copy()
        own = f[rows]
        mid = own.mean(0)
        dist = _gaps(own, f[row])
        node = Node(lo, hi, row, float(dist.max()), mid, float(_gaps(own, mid).max()), float(np.sqrt(mid @ mid)))
        if hi - lo <= self.leaf or node.radius == 0:
            return node
        centres, who, _ = farthest_first(own, int(np.flatnonzero(rows == row)[0]), FAN, MOST_FAN, 0.9)
        by = np.argsort(who, kind="stable")
        self.order[lo:hi] = rows[by]
        cuts = np.searchsorted(who[by], np.arange(len(centres) + 1)).tolist()
        node.children = [self._build(f, lo + i, lo + j, int(rows[c])) for c, i, j in zip(centres, cuts[:-1], cuts[1:], strict=True) if j > i]
        return node

    def arrays(self) -> dict[str, list]:
        """The nodes in preorder; ``after`` is the place behind a node's subtree, ``row`` counts in tree order."""
        out: dict[str, list] = {k: [] for k in ("lo", "hi", "row", "radius", "reach", "after")}
        place = np.argsort(self.order)

        def put(n: Node) -> None:
            at = len(out["lo"])
            for k, v in (("lo", n.lo), ("hi", n.hi), ("row", int(place[n.row])), ("radius", n.radius), ("reach", n.reach), ("after", 0)):
                out[k].append(v)
            for c in n.children:
                put(c)
            out["after"][at] = len(out["lo"])

        put(self.root)
        return out

    @classmethod
    def stored(cls, x: np.ndarray, nodes: dict[str, list]) -> CoverTree:
        """The tree whose rows ``x`` stand in tree order and whose nodes were ``arrays()``."""
        tree = cls.__new__(cls)
        tree.x, tree.f, tree.order = x, x.astype(np.float64), np.arange(len(x))

        def get(at: int) -> Node:
            lo, hi = nodes["lo"][at], nodes["hi"][at]
            mid = tree.f[lo:hi].mean(0)
            n = Node(lo, hi, nodes["row"][at], nodes["radius"][at], mid, nodes["reach"][at], float(np.sqrt(mid @ mid)))
            k = at + 1
            while k < nodes["after"][at]:
                n.children.append(get(k))
                k = nodes["after"][k]
            return n

        tree.root = get(0)
        return tree


def bound(a: Node, b: Node) -> float:
    """No inner product of a point under ``a`` and one under ``b`` is above this (with room for rounding)."""
    top = float(a.mid @ b.mid) + a.reach * b.length + b.reach * a.length + a.reach * b.reach
    return top + 1e-9 * (a.length + a.reach) * (b.length + b.reach) + 1e-6


def _long_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of any 64-bit integers: their digits' products are exact in doubles, the sums are Python's integers.
    What passes 64 bits becomes the largest (smallest) that fits."""
    width = (50 - max(1, (4 * a.shape[1] - 1).bit_length())) // 2
    parts = range(-(-64 // width))

    def digits(x: np.ndarray) -> list[np.ndarray]:
        low = [((x >> np.int64(width * i)) & np.int64((1 << width) - 1)) for i in parts[:-1]]
        return [d.astype(np.float64) for d in (*low, x >> np.int64(width * parts[-1]))]

    da, db = digits(a), digits(b)
    total = np.zeros((len(a), len(b)), dtype=object)
    for k in range(2 * len(parts) - 1):
        t = sum(da[i] @ db[k - i].T for i in parts if 0 <= k - i < len(parts))
        total = total + t.astype(np.int64).astype(object) * (1 << (width * k))
    return np.clip(total, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``.  Doubles hold integers below 2^53 exactly; rows with larger
    components go another way."""
    limit = np.sqrt(2.0**53 / max(1, a.shape[1]))
    fa, fb = a.astype(np.float64), b.astype(np.float64)
    big_a, big_b = (np.abs(f).max(1, initial=0) >= limit for f in (fa, fb))
    if not (big_a.any() or big_b.any()):
        return (fa @ fb.T).astype(np.int64)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    out[np.ix_(~big_a, ~big_b)] = (fa[~big_a] @ fb[~big_b].T).astype(np.int64)
    out[big_a] = _long_products(a[big_a], b)
    out[:, big_b] = _long_products(a, b[big_b])
    return out


class Best:
    """The k best ``(score, id)`` of each query so far: higher score first, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, lo: int, hi: int) -> float:
        low = int(self.score[lo:hi, -1].min())
        return -np.inf if low == NONE else float(low)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score[len(at), m]`` of the data ``ids`` for the queries ``at``; ``NONE`` is no score."""
        if score.shape[1] > 4 * self.k:  # only what reaches the k-th best of these can count
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            floor = np.maximum(kth, self.score[at, -1])
            hit = (score >= floor[:, None]).any(0)
            score, ids = score[:, hit], ids[hit]
            if not score.shape[1]:
                return
        s = np.concatenate([self.score[at], score], axis=1)
        i = np.concatenate([self.id[at], np.broadcast_to(ids, score.shape)], axis=1)
        i = np.where(s == NONE, np.iinfo(np.int64).max, i)
        by = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.score[at] = np.take_along_axis(s, by, 1)
        self.id[at] = np.take_along_axis(i, by, 1)


def dual_search(queries: CoverTree, qid: np.ndarray, data: CoverTree, did: np.ndarray, best: Best) -> None:
    """Improve ``best`` (rows in the queries' tree order) by the data; ids are in tree order too."""
    stack = [(queries.root, data.root)]
    far = np.sqrt((queries.f * queries.f).sum(1))
    while stack:
        q, p = stack.pop()
        if bound(q, p) < best.worst(q.lo, q.hi):
            continue
        if q.children and (not p.children or q.reach >= p.reach):
            stack += [(c, p) for c in q.children]
            continue
        at = np.arange(q.lo, q.hi)
        if not q.children:  # a leaf's queries are balls of no width: each by its own k-th score
            top = queries.f[q.lo : q.hi] @ p.mid + p.reach * far[q.lo : q.hi]
            low = best.score[q.lo : q.hi, -1]
            at = at[(low == NONE) | (top + 1e-9 * far[q.lo : q.hi] * (p.length + p.reach) + 1e-6 >= low)]
            if not len(at):
                continue
        if p.children:  # the most promising is looked at first
            stack += [(q, c) for c in sorted(p.children, key=lambda c: bound(q, c))]
            continue
        for lo in range(p.lo, p.hi, 1024):
            hi = min(lo + 1024, p.hi)
            for a in range(0, len(at), 512):
                own = at[a : a + 512]
                s = products(queries.x[own], data.x[lo:hi])
                s[qid[own][:, None] == did[lo:hi][None, :]] = NONE
                best.offer(own, s, did[lo:hi])


# -- on tables ---------------------------------------------------------------------------------
def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, q`` (integers floor(scale * x)) of the rows with an id and a vector that is not null, not empty and
    all finite; repeated rows become one."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(good).select("vec_id", q.alias("q")).dropDuplicates()


def _flat(column, count: int) -> tuple[np.ndarray, np.ndarray]:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    return arr.flatten().to_numpy(zero_copy_only=False), np.diff(arr.offsets.to_numpy())


def _pivots_of(t: pa.Table) -> pa.Table:
    """Pivots of one cell from its sample, farthest first."""
    flat, dims = _flat(t.column("q"), t.num_rows)
    x = np.unique(flat.reshape(len(dims), -1), axis=0).astype(np.float64)
    fan = int(t.column("fan")[0].as_py())
    rows, _, _ = farthest_first(x, int(_gaps(x, x.mean(0)).argmax()), fan, fan, 0.0)
    return pa.table({"cell": t.column("cell").slice(0, 1), "pivots": pa.array([x[rows].ravel()], pa.list_(pa.float64())), "k": pa.array([len(rows)], pa.int32())})


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells behind their cell's pivots (side 0): the number of the nearest pivot."""
    cell, pivots = None, None
    for b in batches:
        side, cells = b.column("side").to_numpy(), b.column("cell").to_numpy()
        edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (side[1:] != side[:-1]) | (side[1:] == 0)])
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(side)], strict=True):
            if side[lo] == 0:
                cell, pivots = cells[lo], b.column("pivots")[lo].values.to_numpy().reshape(b.column("k")[lo].as_py(), -1)
                continue
            assert cells[lo] == cell
            part = b.slice(lo, hi - lo)
            for at in range(0, part.num_rows, 4096):
                piece = part.slice(at, 4096)
                x = _flat(piece.column("q"), piece.num_rows)[0].reshape(piece.num_rows, -1).astype(np.float64)
                near = ((pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1).astype(np.int32)
                kept = [piece.column(c) for c in ("vec_id", "q", "cell", "path")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(near), pa.array(np.full(len(near), len(pivots) == 1))], ["vec_id", "q", "cell", "path", "near", "done"])


def _with_cells(v: DataFrame, size: int) -> DataFrame:
    """``vec_id, q, cell, path``: rows parted by distance until no cell holds more than ``size``; ``path`` lists the cells from the
    one of all vectors of a length down to ``cell``.  A cell of equal vectors is not parted."""
    rows = v.withColumn("cell", F.xxhash64(F.size("q"))).withColumn("path", F.array("cell")).withColumn("done", F.lit(False))
    for level in range(MOST_LEVELS):
        big = rows.filter("not done").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > size)
        big = stored(big.withColumn("fan", F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") * 2 / size)).cast("int")), "dual-tree-large")
        if big.isEmpty():
            break
        open_rows = rows.filter("not done").join(big, "cell")
        few = F.pmod(F.xxhash64(F.lit(level), "vec_id"), F.col("n")) < SAMPLE
        pivots = open_rows.filter(few).select("cell", "q", "fan").groupBy("cell").applyInArrow(_pivots_of, "cell long, pivots array<double>, k int")
        salts = F.ceil(F.col("n") / (4 * size)).cast("int")
        heads = pivots.join(big, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        heads = heads.select("cell", "salt", F.lit(0).alias("side"), "pivots", "k")
        data = open_rows.select("vec_id", "q", "cell", "path", F.pmod(F.xxhash64(F.lit(-1), "vec_id"), salts).cast("int").alias("salt"), F.lit(1).alias("side"))
        met = data.unionByName(heads, allowMissingColumns=True).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "side")
        near = met.mapInArrow(_nearest, "vec_id long, q array<long>, cell long, path array<long>, near int, done boolean")
        near = near.withColumn("cell", F.xxhash64("cell", "near")).withColumn("path", F.array_append("path", F.col("cell"))).drop("near")
        rest = rows.join(big.select("cell"), "cell", "left_anti")
        rows = stored(rest.select("vec_id", "q", "cell", "path", "done").unionByName(near), "dual-tree-cells")
    return rows.drop("done")


NODES = "struct<lo:array<int>,hi:array<int>,row:array<int>,radius:array<double>,reach:array<double>,after:array<int>>"
BLOCKS = f"block long, cell long, path array<long>, ids array<long>, flat array<long>, nodes {NODES}, centre array<double>, radius double, length double"
_NODES = pa.struct([(k, pa.list_(pa.float64() if k in ("radius", "reach") else pa.int32())) for k in ("lo", "hi", "row", "radius", "reach", "after")])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of up to about ``size`` vectors of a cell of ``rows(vec_id, q, cell, path)``: its vectors in the order of its
    cover tree, the tree's nodes, and the root's ball.  Only cells that could not be parted by distance are cut by id."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("rows"))
    part = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.ceil(F.col("rows") / size)).cast("int")
    cut = rows.join(sizes, "cell").select("vec_id", "q", "cell", "path", F.xxhash64("cell", part).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            block = t.column("block").to_numpy()
            edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for lo, hi in zip(edge.tolist(), np.r_[edge[1:], len(block)].tolist(), strict=True):
                g = t.slice(lo, hi - lo)
                flat, _ = _flat(g.column("q"), g.num_rows)
                tree = CoverTree(flat.reshape(g.num_rows, -1))
                root = tree.root
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(block[lo])]), g.column("cell").slice(0, 1).combine_chunks(),
                        pa.array([g.column("path")[0].as_py()], pa.list_(pa.int64())),
                        pa.array([g.column("vec_id").to_numpy()[tree.order]], pa.list_(pa.int64())),
                        pa.array([tree.x.ravel()], pa.list_(pa.int64())), pa.array([tree.arrays()], _NODES),
                        pa.array([root.mid], pa.list_(pa.float64())), pa.array([root.reach]), pa.array([root.length]),
                    ],
                    ["block", "cell", "path", "ids", "flat", "nodes", "centre", "radius", "length"],
                )

    return cut.repartition("block").sortWithinPartitions("block").mapInArrow(run, BLOCKS)


def _query_cells(rows: DataFrame, size: int) -> DataFrame:
    """Each query's cell: the first on its path that holds at most ``size`` queries (else the last)."""
    steps = rows.select("vec_id", F.posexplode("path").alias("at", "step"))
    few = steps.groupBy("step").agg(F.count("*").alias("n")).filter(F.col("n") <= size).select("step")
    first = steps.join(few, "step").groupBy("vec_id").agg(F.min("at").alias("at"))
    met = rows.join(first, "vec_id", "left")
    upto = F.coalesce(F.col("at") + 1, F.size("path"))
    return met.select("vec_id", "q", F.element_at("path", upto).alias("cell"), F.slice("path", F.lit(1), upto).alias("path"))


FOUND = "qblock long, query_id long, vec_id long, score long"


def _searched(pairs: DataFrame, qblocks: DataFrame, blocks: DataFrame, known: DataFrame | None, k: int) -> DataFrame:
    """The k best of each query over the block pairs.  The rows of a task are, per query block and group of data
    blocks, the query block first (with what is known of its queries), then the data blocks one by one."""
    spread = F.pmod("block", F.lit(8)).cast("int")  # a query block's data blocks go to several tasks
    pairs = pairs.select("qblock", "block", spread.alias("part"))
    data = pairs.join(blocks.select("block", "ids", "flat", "nodes"), "block").select(
        "qblock", "part", F.lit(1).alias("side"), "ids", "flat", "nodes", F.lit(None).cast("array<bigint>").alias("floor")
    )
    heads = pairs.select("qblock", "part").distinct().join(qblocks.select(F.col("block").alias("qblock"), "ids", "flat", "nodes"), "qblock")
    if known is None:
        heads = heads.withColumn("floor", F.lit(None).cast("array<bigint>"))
    else:
        floors = known.groupBy("qblock").agg(F.collect_list(F.struct("query_id", "score", "n")).alias("f"))
        heads = heads.join(floors, "qblock", "left")
        low = F.transform("ids", lambda i: F.element_at(F.col("m"), i))
        m = F.map_from_entries(F.transform(F.coalesce("f", F.array().cast("array<struct<query_id:bigint,score:bigint,n:bigint>>")), lambda x: F.struct(x.query_id, F.when(x.n >= k, x.score))))
        heads = heads.withColumn("m", m).withColumn("floor", low)
    rows = heads.select("qblock", "part", F.lit(0).alias("side"), "ids", "flat", "nodes", "floor").unionAll(data)
    rows = rows.repartition("qblock", "part").sortWithinPartitions("qblock", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, qid, best = None, None, None, None

        def result() -> pa.RecordBatch:
            ok = best.id < np.iinfo(np.int64).max
            n = ok.sum(1)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(n.sum()), key[0])), pa.array(np.repeat(qid, n)), pa.array(best.id[ok]), pa.array(best.score[ok])],
                ["qblock", "query_id", "vec_id", "score"],
            )

        for batch in batches:
            for r in range(batch.num_rows):
                at = (batch.column("qblock")[r].as_py(), batch.column("part")[r].as_py())
                ids = batch.column("ids")[r].values.to_numpy()
                x = batch.column("flat")[r].values.to_numpy().reshape(len(ids), -1)
                here = CoverTree.stored(x, batch.column("nodes")[r].as_py())
                if batch.column("side")[r].as_py() == 0:
                    if best is not None:
                        yield result()
                    key, tree = at, here
                    qid, best = ids, Best(len(ids), k)
                    floor = batch.column("floor")[r]
                    if floor.is_valid:  # a score that k known neighbours reach: lower ones cannot count
                        low = np.array([NONE if f is None else max(NONE, f - 1) for f in floor.as_py()], dtype=np.int64)
                        best.score[:, :] = low[:, None]
                elif at == key:
                    dual_search(tree, qid, here, ids, best)
        if best is not None:
            yield result()

    return rows.mapInArrow(run, FOUND)


def _gap(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _below(blocks: DataFrame) -> DataFrame:
    """``parent, node, whole, centre, radius, length``: the children of every cell, cells and (``whole``) blocks, with balls.  A
    cell's ball is centred like that of one of its blocks and covers the balls of all."""
    b = blocks.select("block", "path", "cell", "centre", "radius", "length")
    on = b.select(F.posexplode("path").alias("at", "node"), "path", "block", F.col("centre").alias("own"), F.col("radius").alias("own_radius"))
    on = on.filter("at > 0").withColumn("parent", F.expr("path[at - 1]"))
    first = on.groupBy("parent", "node").agg(F.min_by("own", "block").alias("centre"))
    cells = on.join(first, ["parent", "node"]).groupBy("parent", "node", "centre").agg(F.max(_gap("own", "centre") + F.col("own_radius")).alias("radius"))
    length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    cells = cells.select("parent", "node", F.lit(False).alias("whole"), "centre", "radius", length.alias("length"))
    leaves = b.select(F.col("cell").alias("parent"), F.col("block").alias("node"), F.lit(True).alias("whole"), "centre", "radius", "length")
    return cells.unionByName(leaves)


def _reached(qblocks: DataFrame, blocks: DataFrame, floors: DataFrame) -> DataFrame:
    """``qblock, block``: the pairs whose balls may hold a score that counts, found from the top cells down."""
    below = stored(_below(blocks), "dual-tree-balls")
    q = qblocks.select(F.col("block").alias("qblock"), F.element_at("path", 1).alias("at"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.col("length").alias("ql"))
    q = q.join(floors, "qblock", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    balls = stored(q, "dual-tree-query-balls")
    deepest = blocks.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    dot = F.aggregate(F.zip_with("qc", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    most = dot + F.col("qr") * F.col("length") + F.col("radius") * F.col("ql") + F.col("qr") * F.col("radius")
    room = F.lit(1e-9) * (F.col("ql") + F.col("qr")) * (F.col("length") + F.col("radius")) + 1e-6
    open_, found = balls.select("qblock", "at"), []
    for _ in range(deepest):
        met = open_.join(below.withColumnRenamed("parent", "at"), "at").join(balls.drop("at"), "qblock")
        met = stored(met.filter(most + room >= F.col("floor")).select("qblock", "node", "whole"), "dual-tree-pairs")
        found.append(met.filter("whole").select("qblock", F.col("node").alias("block")))
        open_ = met.filter("not whole").select("qblock", F.col("node").alias("at"))
    out = found[0] if found else balls.select("qblock", F.col("at").alias("block")).limit(0)
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding, ..)`` whose vec_id is divisible by ``every``: its ``k`` best other rows
    by integer inner product of ``floor(scale * x)``: ``query_id, rank, vec_id, score``; ties to the smaller vec_id,
    all if there are fewer.

    Vectors that are null, empty or hold null or non-finite components and rows without an id take no part;
    vectors of another length are not compared.  Integers and scores that pass 64 bits become the largest (or smallest)
    that fits.  Repeated rows count once.  Other columns are ignored; an empty
    table gives none."""
    v = stored(quantised(vectors, scale), "dual-tree-vectors")
    cells = stored(_with_cells(v, BLOCK), "dual-tree-parted")
    same = Window.partitionBy(F.xxhash64("q"), F.xxhash64(F.lit(5), "q")).orderBy("vec_id")
    data = cells.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy")
    blocks = stored(_blocks(data, BLOCK), "dual-tree-data")
    qblocks = stored(_blocks(_query_cells(cells.filter(F.pmod("vec_id", F.lit(every)) == 0), QUERY_BLOCK), QUERY_BLOCK), "dual-tree-queries")
    inside = blocks.select("block", F.explode("path").alias("cell")).groupBy("cell").agg(F.min("block").alias("block"))
    own = qblocks.select(F.col("block").alias("qblock"), "cell").join(inside, "cell").select("qblock", "block")
    first = stored(_searched(own, qblocks, blocks, None, k), "dual-tree-first")
    known = _top(first, k).groupBy("qblock", "query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    # a query block's bound is that of its worst query; one whose queries did not all meet k others has none
    met = known.groupBy("qblock").agg(F.min(F.when(F.col("n") >= k, F.col("score"))).alias("low"), F.min("n").alias("least"), F.count("*").alias("queries"))
    met = met.join(qblocks.select(F.col("block").alias("qblock"), F.size("ids").alias("all")), "qblock")
    floors = met.filter((F.col("least") >= k) & (F.col("queries") == F.col("all"))).select("qblock", F.col("low").cast("double").alias("floor"))
    rest = _reached(qblocks, blocks, floors).join(own, ["qblock", "block"], "left_anti")
    second = _searched(rest, qblocks, blocks, known, k)
    best = _top(first.unionAll(second), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)
  where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""
