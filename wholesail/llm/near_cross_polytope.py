"""Near-duplicate embeddings by cross-polytope hashing with fast Hadamard rotations and multiprobe.

A hash rotates a unit vector by three rounds of random signs and a Walsh-Hadamard transform and takes the
nearest signed axis; ``HASHES`` of them are one table's bucket.  A vector lives in one bucket of each of
``TABLES`` tables and also visits the ``PROBES - 1`` buckets of the next nearest axes.  Two vectors meet where
one lives and the other lives or visits; every meeting is verified by cosine in double precision.  At
cosine 0.93 a table lets a pair meet with chance 0.8, so six tables miss it with about 5e-5, and
with 1e-8 or less at 0.97.

Exact copies are one class with a weight before hashing.  Buckets are grouped by ids only; vectors join the
buckets in which some pair can meet.  A bucket above ``BLOCK`` members becomes pairs of blocks.  A pair that
meets several times is counted in the first of its meetings only (both ends' buckets are recomputed for the
pairs that pass), so no pair list is ever built: a block sends one count and one tree edge per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored, whole_groups
from .components import connected_components

COSINE = 0.93
TABLES = 6
HASHES = 2
PROBES = 6
BLOCK = 2048
AXES = 6  # nearest axes of a hash that probes combine


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, -1)
        h *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 2024) -> np.ndarray:
    """``[rows, tables, probes]`` bucket codes of the rows of ``x`` (not zero); column 0 is where the row lives."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    unit = np.zeros((n, width))
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    unit[:, :d] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    rng = np.random.default_rng(seed + width)
    top = min(AXES, width)
    out = np.zeros((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        codes, loss = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            y = unit
            for _ in range(3):
                y = _hadamard(y * rng.choice((-1.0, 1.0), size=width))
            size = np.abs(y)
            at = np.argsort(-size, axis=1, kind="stable")[:, :top]
            near = np.take_along_axis(size, at, 1)
            code = at * 2 + (np.take_along_axis(y, at, 1) > 0)
            codes = (codes[:, :, None] * (2 * width) + code[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(n, -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(codes, best, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]  # tiny dimensions have fewer buckets
    return out


def _rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat double values and offsets of a list column."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    sizes = np.fromiter((len(v) for v in arr), dtype=np.int64, count=len(arr)) if arr.null_count else np.diff(arr.offsets.to_numpy())
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(sizes)]


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: every row with its class key ``k1, k2`` (null if it links with nothing), and one
    row per class of equal vectors of one label: ``k1, k2, id`` (smallest vec_id), ``weight``, ``label, vec``."""
    e = F.col("embedding")
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e.alias("embedding"))
    plain = F.transform(e, lambda x: x + F.lit(0).cast("float"))  # one zero
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).select(
        "vec_id", "label", F.when(F.col("good"), plain).alias("vec"),
        F.when(F.col("good"), F.xxhash64(F.lit(1), "label", plain)).alias("k1"), F.when(F.col("good"), F.xxhash64(F.lit(2), plain, "label")).alias("k2"),
    )
    named = rows.filter("k1 is not null").groupBy("k1", "k2", "vec_id").agg(F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = named.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    return rows.select("vec_id", "k1", "k2"), classes


def _hashed(classes: DataFrame) -> DataFrame:
    """``k1, k2, label, t, code, lives`` for each bucket that a class lives in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                part = big.slice(lo, 2000)
                flat, at = _rows(part.column("vec"))
                sizes = np.diff(at)
                code = np.zeros((part.num_rows, TABLES, PROBES), dtype=np.int64)
                for d in np.unique(sizes):
                    own = np.flatnonzero(sizes == d)
                    x = flat[(at[own][:, None] + np.arange(d)[None, :])]
                    code[own] = buckets(x)
                each = np.repeat(np.arange(part.num_rows), TABLES * PROBES)
                t = np.tile(np.repeat(np.arange(TABLES), PROBES), part.num_rows)
                lives = np.tile(np.arange(PROBES) == 0, part.num_rows * TABLES)
                once = lives | (code != code[:, :, :1]).ravel()  # probes that tiny dimensions lack repeat the first
                take = pa.array(each[once])
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(take) for k in ("k1", "k2", "label", "dim")]
                    + [pa.array(t[once], pa.int32()), pa.array(code.ravel()[once]), pa.array(lives[once])],
                    ["k1", "k2", "label", "dim", "t", "code", "lives"],
                )

    label = dict(classes.dtypes)["label"]
    rows = classes.select("k1", "k2", "label", F.size("vec").alias("dim"), "vec")
    return rows.mapInArrow(run, f"k1 long, k2 long, label {label}, dim int, t int, code long, lives boolean")


def _met(classes: DataFrame) -> DataFrame:
    """Members of the buckets (or pairs of blocks of one) in which a pair can meet, with their vectors."""
    hashed = stored(_hashed(classes), "cross-polytope")
    bucket = ["label", "dim", "t", "code"]
    sizes = hashed.groupBy(*bucket).agg(F.count("*").alias("members"), F.max("lives").alias("lived")).filter("members > 1 and lived")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("k1", "k2"), blocks).cast("int")
    met = hashed.join(sizes, bucket).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other"))
    met = met.select("k1", "k2", "t", "code", "lives", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), key.alias("key"))
    return met.join(classes, ["k1", "k2"])


def _linked(classes: DataFrame, cosine: float) -> DataFrame:
    """``id, links`` (weights of partners found in one block) and, where a tree needs it, ``other`` to join with."""
    columns = ["key", "id", "weight", "label", "t", "code", "lives", "own", "lo", "hi", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key = t.column("key").to_numpy()
            ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
            lives = t.column("lives").to_numpy().astype(bool)
            table, code = t.column("t").to_numpy(), t.column("code").to_numpy()
            own, lo_, hi_ = (t.column(k).to_numpy() for k in ("own", "lo", "hi"))
            group = t.column("label").combine_chunks().dictionary_encode()
            group = (pa.concat_arrays(group.chunks) if isinstance(group, pa.ChunkedArray) else group).indices.to_numpy()
            flat, at = _rows(t.column("vec"))
            sizes = np.diff(at)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            left, right = [], []
            for lo, hi in zip(cut.tolist(), np.r_[cut[1:], len(key)].tolist(), strict=True):
                res = lo + np.flatnonzero(lives[lo:hi])
                if not len(res) or hi - lo < 2:
                    continue
                d = sizes[lo]
                if (sizes[lo:hi] != d).any():
                    raise ValueError("two buckets share a key")
                x = flat[at[lo] : at[hi]].reshape(-1, d)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.sqrt((x * x).sum(1))
                for s in range(0, len(res), 256):
                    r = res[s : s + 256]
                    c = (x[r - lo] @ x.T) / (norm[r - lo][:, None] * norm[None, :])
                    i, j = np.nonzero(c >= cosine)
                    i, j = r[i], j + lo
                    ok = (i != j) & (~lives[j] | (i < j)) & (group[i] == group[j]) & (code[i] == code[j]) & (table[i] == table[j])
                    # of a pair of blocks only what crosses, of a block with itself all
                    ok &= (lo_[i] == hi_[i]) | (own[i] != own[j])
                    left.append(i[ok])
                    right.append(j[ok])
            if not left or not sum(map(len, left)):
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            some, back = np.unique(np.r_[i, j], return_inverse=True)
            codes = np.zeros((len(some), TABLES, PROBES), dtype=np.int64)
            for d in np.unique(sizes[some]):
                of = np.flatnonzero(sizes[some] == d)
                codes[of] = buckets(flat[at[some[of]][:, None] + np.arange(d)[None, :]])
            keep = []
            for s in range(0, len(i), 100_000):
                p, q = back[: len(i)][s : s + 100_000], back[len(i) :][s : s + 100_000]
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                swap = ids[a] > ids[b]
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                home_p, home_q = codes[p, :, 0], codes[q, :, 0]
                there = (codes[q] == home_p[:, :, None]).any(2)  # q visits where p lives
                here = (codes[p] == home_q[:, :, None]).any(2)
                first = (there | here).argmax(1)
                row = np.arange(len(p))
                place = np.where(there[row, first], home_p[row, first], home_q[row, first])
                keep.append((first == table[a]) & (place == code[a]))
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            links = np.zeros(len(ids), dtype=np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            # a spanning star of each component of the block's links: every member with its smallest
            root = np.arange(len(ids))
            while True:
                low = np.minimum(root[i], root[j])
                was = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                if (root == was).all():
                    break
            touched = np.unique(np.r_[i, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[touched]), pa.array(links[touched]), pa.array(ids[root[touched]])], ["id", "links", "other"]
            )

    rows = _met(classes).select(*columns).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "id long, links long, other long")


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label, ..)``: ``vec_id, n_links`` (other vectors of the same
    label with cosine ``cosine`` or more), ``component_id`` (smallest vec_id reachable by links), ``kept``.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different length neither.  Repeated rows of one vec_id are one vector and all
    returned; a null vec_id has no links, a null component and is kept.  Other columns are ignored; an empty table
    gives none."""
    rows, classes = classes_of(vectors)
    classes = stored(classes, "cross-polytope-classes")
    found = checkpointed(_linked(classes, cosine))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    full = (
        classes.select("k1", "k2", "id", "weight").join(counts, "id", "left")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .select("k1", "k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    )
    out = rows.join(full, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
