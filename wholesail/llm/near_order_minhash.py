"""Near-duplicate documents by Order MinHash (Marçais et al. 2019), verified by banded alignment.

A document is its sequence of five-word shingles; the i-th occurrence of a shingle is labelled i, so repeats
count.  Each of ``SKETCHES`` hash orders picks the ``PICK`` smallest labelled shingles and keeps them in
text order; two texts agree on a sketch with a chance that falls with their edit distance, also when
the same shingles stand in another order.  Texts that agree on a sketch meet in a bucket.  Pairs that meet are
candidates if their lengths and a signature of ``BINS`` bins (smallest labelled shingle of each hash range)
allow the similarity; the margin is ``SIGMAS`` standard errors of the signature.  A candidate pair is aligned
(longest common subsequence of shingles inside a band as wide as the similarity leaves) and linked if
``c / (n + m - c) >= 0.8``, c being the aligned shingles.

How the work stays in proportion: exact copies are one class before anything else.  Inside a bucket rows are
assigned to star centres, so a first pass sends at most one pair per row and bucket to the alignment.
A second pass settles the candidates that are still in different components: the rows that have such a candidate
are gathered by connected candidates, in blocks, and aligned there unless meanwhile connected, so no
list of pairs is built and no candidate link between components is lost.  Only the rows outside a gathering's
largest component meet all others; buckets and gatherings of any size are cut into pairs of blocks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, whole_groups
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 16
PICK = 3
BINS = 256
SIGMAS = 4.5
BLOCK = 4096
STAR = 512
GATHER = 512
GATHER_SHINGLES = 1_000_000  # of the texts of a chunk of a gathering
DENSE = 8  # matches a shingle from which alignment goes by bits
MASK_BITS = 1 << 28
NAMELESS = 1 << 62  # ids from here on stand for texts whose rows have no id

_Q = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFT = (np.uint64(30), np.uint64(27), np.uint64(31))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT[0])) * _A
    x = (x ^ (x >> _SHIFT[1])) * _B
    return x ^ (x >> _SHIFT[2])


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _Q)
_POWERS = {"q": np.ones(1, dtype=np.uint64), "inverse": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if len(_POWERS["q"]) < n:
        size = max(n, 2 * len(_POWERS["q"]), 1 << 14)
        inverse = pow(int(_Q), -1, 1 << 64)
        for name, base in (("q", int(_Q)), ("inverse", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["q"], _POWERS["inverse"]


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's five-word shingles in order (lower case, words between ASCII blanks).  A
    text of one to four words is one shingle; null, empty and blank texts have none."""
    raw = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    q, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * q[: len(raw)], out=sums[1:])
    words = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    size = min(WORDS, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * _Q + words[k : len(words) - size + 1 + k])
    return out


def sketch(sh: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``SKETCHES`` 32-bit sketches of a shingle sequence (not empty) with its labelled hashes."""
    order = _mix(label[None, :] ^ _SEEDS[:, None])
    k = min(PICK, len(sh))
    at = np.argpartition(order, k - 1, axis=1)[:, :k] if len(sh) > k else np.broadcast_to(np.arange(k), (SKETCHES, k))
    at = np.sort(at, axis=1)  # text order
    out = _SEEDS.copy()
    for j in range(k):
        out = _mix(out * _Q + sh[at[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _labelled(sh: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence number."""
    by = np.argsort(sh, kind="stable")
    run = sh[by]
    head = np.r_[True, run[1:] != run[:-1]]
    seen = np.arange(len(sh)) - np.maximum.accumulate(np.where(head, np.arange(len(sh)), 0))
    label = np.empty(len(sh), dtype=np.uint64)
    label[by] = _mix(run + seen.astype(np.uint64) * _A)
    return label


def signature(label: np.ndarray) -> bytes:
    """One byte for each of ``BINS`` hash ranges: a digest of its smallest labelled shingle, 0 if it has none."""
    run = np.sort(label)
    bins = (run >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first]] = (_mix(run[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def _candidates(sig: np.ndarray, n: np.ndarray, head: int, tail: np.ndarray, least: float) -> np.ndarray:
    """Which of the rows ``tail`` lengths and signatures allow to be ``least`` similar to row ``head``."""
    one, many = sig[head], sig[tail]
    same = ((many == one) & (one > 0)).sum(1)
    either = ((many > 0) | (one > 0)).sum(1)
    near = same / either >= least - SIGMAS * np.sqrt(least * (1 - least) / either)
    return near & (np.minimum(n[tail], n[head]) >= least * np.maximum(n[tail], n[head]))


def _aligned(lo: np.ndarray, hi: np.ndarray, by: np.ndarray, above: int, below: int) -> int:
    """Longest chain of matches that rises in both sequences; the i-th shingle matches places ``by[lo[i] : hi[i]]``.  Only places j
    with ``-below <= j - i <= above`` (the band) count."""
    tails: list[int] = []
    for i in np.flatnonzero(hi > lo).tolist():
        places = by[lo[i] : hi[i]]
        if len(places) > 1:
            places = places[np.searchsorted(places, i - below) : np.searchsorted(places, i + above, "right")][::-1]
            places = places.tolist()
        else:
            j = int(places[0])
            places = [j] if -below <= j - i <= above else []
        for j in places:
            k = bisect_left(tails, j)
            if k == len(tails):
                tails.append(j)
            else:
                tails[k] = j
    return len(tails)


def _aligned_bits(lo: np.ndarray, hi: np.ndarray, by: np.ndarray) -> int:
    """The same without a band, for sequences of many repeats: one row of the alignment is one long integer, whose addition
    carries a match on to the next free place (Hyyrö's bit-parallel longest common subsequence)."""
    size = len(by)
    row = every = (1 << size) - 1
    masks: dict[int, int] = {}
    for i in np.flatnonzero(hi > lo).tolist():
        mask = masks.get(lo[i])
        if mask is None:
            bits = np.zeros(size, dtype=bool)
            bits[by[lo[i] : hi[i]]] = True
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(masks) * size < MASK_BITS:
                masks[lo[i]] = mask
        met = row & mask
        row = ((row + met) | (row - met)) & every
    return size - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles, of two shingle sequences; exact where it is ``least`` or more, else
    some value below ``least``.  Only matches inside the band that ``least`` allows are aligned."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    low = 0
    top = min(n, m)
    differs = np.flatnonzero(a[:top] != b[:top])
    low = int(differs[0]) if len(differs) else top
    x, y = a[low:], b[low:]
    top = min(len(x), len(y))
    differs = np.flatnonzero(x[len(x) - top :][::-1] != y[len(y) - top :][::-1])
    tail = int(differs[0]) if len(differs) else top
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    c = low + tail
    if len(x) and len(y):
        by = np.argsort(y, kind="stable")
        sy = y[by]
        lo, hi = np.searchsorted(sy, x, "left"), np.searchsorted(sy, x, "right")
        if int((hi - lo).sum()) > DENSE * (len(x) + len(y)):
            c += _aligned_bits(lo, hi, by)
        else:
            c += _aligned(lo, hi, by, m - need, n - need)
    return c / (n + m - c)


def _copy(sh: np.ndarray) -> str | None:
    """Name of a class of copies: texts with the same shingles in the same order."""
    return hashlib.md5(sh.tobytes()).hexdigest() if len(sh) else None


# -- stages ------------------------------------------------------------------------------------
def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, copy`` (hash of the shingle-relevant text, 32 hex digits), ``n`` shingles, sketches ``sk``,
    signature ``sig`` for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            copy, n, sk, sig = [], [], [], []
            for t in part.column("text").to_pylist():
                sh = shingles(t)
                label = _labelled(sh)
                n.append(len(sh))
                copy.append(_copy(sh))
                sk.append(sketch(sh, label) if len(sh) else None)
                sig.append(signature(label) if len(sh) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(copy, pa.string()), pa.array(n, pa.int32()),
                    pa.array(sk, pa.list_(pa.int32())), pa.array(sig, pa.binary()),
                ],
                ["doc_id", "copy", "n", "sk", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, copy string, n int, sk array<int>, sig binary")


def _meetings(nodes: DataFrame) -> DataFrame:
    """``id, key``: each node once per bucket that holds several; a bucket of more than ``BLOCK`` rows becomes pairs
    of blocks, each row in all pairs that hold its block.  Only ids and sketches are grouped by bucket."""
    each = nodes.select("id", F.posexplode("sk").alias("band", "value"))
    sizes = each.groupBy("band", "value").agg(F.count("*").alias("rows")).filter("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    met = each.join(sizes, ["band", "value"]).withColumn("own", own)
    met = met.select("id", "band", "value", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return met.select("id", F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("key"))


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, BINS)


def _stars(nodes: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """Candidate pairs ``(a, b)``, a < b: in each bucket every row with the centre it is assigned to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key, ids = t.column("key").to_numpy(), t.column("id").to_numpy()
            n, sig = t.column("n").to_numpy().astype(np.float64), _signatures(t)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            a, b = [], []
            for lo, hi in zip(cut.tolist(), np.r_[cut[1:], len(key)].tolist(), strict=True):
                rest = lo + np.argsort(ids[lo:hi], kind="stable")
                while len(rest) > 1:
                    head, tail = rest[0], rest[1:]
                    near = _candidates(sig, n, head, tail, least)
                    met = tail[near & (ids[tail] != ids[head])]
                    a.append(np.full(len(met), ids[head]))
                    b.append(ids[met])
                    rest = tail[~near]
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = met.join(nodes, "id").select("id", "n", "sig", "key").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.lit(1).alias("seen")).select("a", "b")


def _open(nodes: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """Edges ``(a, b)`` that connect all candidates that meet in a bucket but lie in different components: per
    bucket one edge for each row that has such a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key, ids, comp = (t.column(k).to_numpy() for k in ("key", "id", "component"))
            n, sig = t.column("n").to_numpy().astype(np.float64), _signatures(t)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            a, b = [], []
            for lo, hi in zip(cut.tolist(), np.r_[cut[1:], len(key)].tolist(), strict=True):
                # of two rows in different components one is outside the largest: only those lead
                names, back, sizes = np.unique(comp[lo:hi], return_inverse=True, return_counts=True)
                if len(names) < 2:
                    continue
                large = back == sizes.argmax()
                rest = lo + np.r_[np.flatnonzero(~large), np.flatnonzero(large)]
                root = np.arange(len(rest))
                for k in range(int((~large).sum())):
                    tail = rest[k + 1 :]
                    near = _candidates(sig, n, rest[k], tail, least) & (comp[tail] != comp[rest[k]]) & (ids[tail] != ids[rest[k]])
                    if near.any():
                        with_ = np.unique(root[np.r_[k, k + 1 + np.flatnonzero(near)]])
                        root[np.isin(root, with_)] = with_[0]
                moved = np.flatnonzero(root != np.arange(len(rest)))
                a.append(ids[rest[moved]])
                b.append(ids[rest[root[moved]]])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = met.join(nodes, "id").select("id", "n", "sig", "component", "key").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long")


def _settled(nodes: DataFrame, gathered: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified links ``(a, b)`` that connect the components of ``nodes(id, n, sig, component)`` inside each gathering
    of ``gathered(node, component)``."""
    rows = nodes.join(gathered.select(F.col("node").alias("id"), F.col("component").alias("gathering")), "id")
    # a chunk's load: rows and shingles, so that neither many texts nor long ones make it large
    load = F.sum(F.lit(1.0) / GATHER + F.col("n") / GATHER_SHINGLES)
    sizes = rows.groupBy("gathering", "component").agg(load.alias("load"))
    largest = sizes.groupBy("gathering").agg(
        F.max_by("component", F.struct("load", "component")).alias("largest"), F.max("load").alias("inside"), F.sum("load").alias("all")
    )
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(c).cast("int"))
    light, heavy = chunks(F.col("all") - F.col("inside")), chunks(F.col("inside"))
    cut = rows.join(largest, "gathering").withColumn("light", F.col("component") != F.col("largest"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("light"), light).otherwise(heavy)).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    # a light chunk meets the light and the heavy chunks, heavy ones do not meet each other
    met = F.transform(upto(light), lambda o: F.when(F.col("light"), F.struct(
        F.lit("l").alias("kind"), F.least("own", o).alias("x"), F.greatest("own", o).alias("y"), (F.col("own") > o).cast("int").alias("side")
    )).otherwise(F.struct(F.lit("h").alias("kind"), o.alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"))))
    also = F.when(F.col("light"), F.transform(upto(heavy), lambda o: F.struct(
        F.lit("h").alias("kind"), F.col("own").alias("x"), o.alias("y"), F.lit(0).alias("side")
    ))).otherwise(F.array().cast("array<struct<kind:string,x:int,y:int,side:int>>"))
    placed = cut.select("id", "n", "sig", "component", "gathering", F.explode(F.concat(met, also)).alias("at"))
    key = F.xxhash64("gathering", "at.kind", "at.x", "at.y").alias("key")
    cross = ((F.col("at.kind") == "h") | (F.col("at.x") != F.col("at.y"))).alias("cross")
    placed = placed.select("id", "n", "sig", "component", key, F.col("at.side").alias("side"), cross)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key, ids, comp, side = (t.column(k).to_numpy() for k in ("key", "id", "component", "side"))
            cross = t.column("cross").to_numpy().astype(bool)
            n, sig, text = t.column("n").to_numpy().astype(np.float64), _signatures(t), t.column("text")
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            a, b = [], []
            for lo, hi in zip(cut.tolist(), np.r_[cut[1:], len(key)].tolist(), strict=True):
                if (comp[lo:hi] == comp[lo]).all():
                    continue
                made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

                def words(i: int) -> tuple[np.ndarray, np.ndarray]:
                    if i not in made:
                        sh = shingles(text[i].as_py())
                        made[i] = (sh, np.sort(_labelled(sh)))
                    return made[i]

                root = np.unique(comp[lo:hi], return_inverse=True)[1]
                order = lo + np.argsort(side[lo:hi], kind="stable")
                for k, i in enumerate(order.tolist()):
                    if cross[i] and side[i]:
                        break
                    tail = order[k + 1 :]
                    tail = tail[(root[tail - lo] != root[i - lo]) & (ids[tail] != ids[i])]
                    if cross[i]:
                        tail = tail[side[tail] == 1]
                    if not len(tail):
                        continue
                    for j in tail[_candidates(sig, n, i, tail, least)].tolist():
                        if root[i - lo] == root[j - lo]:
                            continue
                        (x, lx), (y, ly) = words(i), words(j)
                        c = (ly[np.minimum(np.searchsorted(ly, lx), len(ly) - 1)] == lx).sum()
                        if c >= least * (len(x) + len(y) - c) and similarity(x, y, least) >= least:
                            a.append(ids[i])
                            b.append(ids[j])
                            root[root == root[j - lo]] = root[i - lo]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = placed.join(texts, "id").select("id", "n", "sig", "component", "key", "side", "cross", "text")
    return full.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts align to ``least`` or more.  ``texts(id, text)``.  The text of a centre goes once
    to each group of up to ``STAR`` partners, not once to each pair."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups"))
    members = pairs.join(groups, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part")
    )
    wanted = members.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("side")).unionAll(
        groups.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("side"))
    )
    rows = wanted.join(texts, "id").select("a", "part", "side", "id", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, dtype=np.uint64)
        for piece in slices(batches):
            a, b = [], []
            for x, part, side, i, text in zip(*(piece.column(k).to_pylist() for k in range(5)), strict=True):
                if side == 0:
                    centre, own = (x, part), shingles(text)
                elif centre == (x, part) and similarity(own, shingles(text), least) >= least:
                    a.append(x)
                    b.append(i)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _distinct_text(docs: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, text`` with one row per node id that can be in a pair."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = rows.filter("id is not null")
    if signed.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["id"])
    if signed.filter("doc_id is null and n > 0").limit(1).count():  # found again by the hash of the text
        nameless = classes.filter(F.col("id") >= NAMELESS).select("copy", "id")
        lost = _with_copy(rows.filter("id is null")).join(nameless, "copy").select("id", "text")
        texts = texts.unionAll(lost.dropDuplicates(["id"]))
    return texts


def _with_copy(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            copy = pa.array([_copy(shingles(t)) for t in part.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([copy, part.column("text")], ["copy", "text"])

    return rows.select("text").mapInArrow(run, "copy string, text string")


def _grouped(docs: DataFrame, least: float) -> DataFrame:
    """``doc_id, copy, group_id`` per row; ``group_id`` is null for a group without any id."""
    whole = stored(sketches(docs), "order-minhash")
    signed = whole.select("doc_id", "copy", "n")
    made_up = F.lit(NAMELESS) + F.conv(F.substring("copy", 1, 15), 16, 10).cast("long")
    classes = stored(
        whole.filter("n > 0").groupBy("copy").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.first("sig").alias("sig"))
        .select("copy", F.coalesce("least_id", made_up).alias("id"), "n", "sk", "sig"),
        "order-minhash-classes",
    )
    met = stored(_meetings(classes), "order-minhash-met")
    # whole texts cross the network once; the two passes join the few that met
    texts = stored(_distinct_text(docs, signed, classes).join(met.select("id"), "id", "left_semi"), "order-minhash-texts")
    stars = connected_components(_verified(_stars(classes, met, least), texts, least))
    named = classes.join(stars.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = _settled(named.select("id", "n", "sig", "component"), connected_components(_open(named, met, least)), texts, least)
    linked = connected_components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(rest))
    of_copy = classes.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("group_id", F.coalesce("component", "id"))
    of_copy = of_copy.select("copy", F.when(F.col("group_id") < NAMELESS, F.col("group_id")).alias("group_id"))
    return signed.select("doc_id", "copy").join(of_copy, "copy", "left").select(
        "doc_id", "copy", F.when(F.col("copy").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id")
    )


def groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ..)``: ``doc_id, group_id, kept``.

    group_id: the smallest doc_id of the texts reachable by links of similarity ``least`` or more.  kept: the
    row bears its group's id.  Texts without a word (null, empty, blank) are never linked: each is its own
    group.  A row with a null doc_id takes part with its text: it gets its group's smallest id and is not kept;
    where no member has an id, group_id is null and the rows are kept.  Repeated rows are all returned and say
    the same (``keep_one`` leaves one).  Rows that share a doc_id but not the text count as one document.  Ids are
    below 2^62.  Other columns are ignored; an empty table gives none."""
    g = _grouped(docs, least)
    return g.select("doc_id", "group_id", F.coalesce(F.col("doc_id") == F.col("group_id"), F.col("group_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` (all columns) with one row of each group: that with the smallest doc_id.  Of rows without an id
    whose group has no id either, one of each text stays; texts without a word all stay, repeated rows of one
    doc_id become one."""
    g = stored(_grouped(docs, least), "order-minhash-groups")
    gone = g.filter("doc_id is not null and doc_id <> group_id").select(F.col("doc_id").alias("__gone")).distinct()
    named = docs.filter(F.col("doc_id").isNotNull())
    out = named.join(gone, named["doc_id"].cast("long") == gone["__gone"], "left_anti")
    if g.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    if g.filter("doc_id is null").limit(1).count():
        lost = docs.filter(F.col("doc_id").isNull())
        free = g.filter("doc_id is null and group_id is null").select(F.col("copy").alias("__copy")).distinct()
        packed = lost.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        marked = _with_copy_of_rows(packed)
        single = marked.filter("copy is null").unionAll(
            marked.filter("copy is not null").join(free, F.col("copy") == F.col("__copy"), "left_semi").dropDuplicates(["copy"])
        )
        out = out.unionByName(single.select("row.*"))
    return out


def _with_copy_of_rows(packed: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("copy", T.StringType()), packed.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            copy = pa.array([_copy(shingles(t)) for t in part.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([copy, part.column("row")], ["copy", "row"])

    return packed.mapInArrow(run, schema)
