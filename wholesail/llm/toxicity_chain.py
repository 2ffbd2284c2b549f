"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models on token features; each later model also
sees the probabilities of the earlier categories.  In training these are out-of-fold predictions (each
training document's from models that did not see it), so a later model learns how far to trust what it will get on
new documents.

The last category is the label ``toxic``.  The labels know no finer ones, so the earlier categories are weak
labels: a toxic document is of a category if it holds one of its words (``CATEGORIES``, a parameter; the given ones are
English, so toxic documents in other languages are learnt as of neither).  The
features are found in training and not listed: lower-case words and their 4- and 5-character prefixes,
hashed; of them the models see those whose share among toxic and other training documents differs
significantly.

The models are fitted on a bounded sample of labelled documents (``max_rows``, smallest id hashes, training folds
only) and are some thousand weights; scoring is a narrow pass over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .quality_pu import held_out

#: Words whose presence in a toxic document makes it one of the category.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "contempt": ("disgusting", "pathetic", "scum", "trash", "worthless"),
}
TARGET = "toxic"
BITS = 22
MOST_FEATURES = 4000
FOLDS = 4
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")


class Tokens:
    """Hashed features of a text, with a bounded cache of words."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        known = self.known
        for w in set(_WORD.findall((text or "").lower())):
            ids = known.get(w)
            if ids is None:
                if len(known) >= self.most:
                    known.clear()
                raw = {f"={w}", *(f"<{w[:k]}" for k in (4, 5) if len(w) >= k)}
                ids = known[w] = tuple(zlib.crc32(r.encode()) >> (32 - BITS) for r in raw)
            out.update(ids)
        return out


@dataclass
class Chain:
    names: tuple[str, ...]
    columns: np.ndarray  # feature hashes, sorted
    weights: np.ndarray  # [categories, features + categories]
    bias: np.ndarray

    def __post_init__(self):
        self.place = {int(h): k for k, h in enumerate(self.columns)}

    def rows(self, features: list[set[int]]) -> np.ndarray:
        x = np.zeros((len(features), len(self.columns)))
        place = self.place
        for r, f in enumerate(features):
            hit = [place[h] for h in f if h in place]
            x[r, hit] = 1
        return x

    def predict(self, features: list[set[int]]) -> np.ndarray:
        """Probability of each category, ``[rows, categories]``."""
        x = self.rows(features)
        p = np.zeros((len(x), len(self.names)))
        d = x.shape[1]
        for k in range(len(self.names)):
            z = x @ self.weights[k, :d] + p[:, :k] @ self.weights[k, d : d + k] + self.bias[k]
            p[:, k] = _sigmoid(z)
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Rows:
    """0/1 features of documents as (row, column) pairs, and some dense columns."""

    row: np.ndarray
    col: np.ndarray
    width: int
    dense: np.ndarray

    def only(self, keep: np.ndarray) -> Rows:
        some = keep[self.row]
        return Rows((np.cumsum(keep) - 1)[self.row[some]], self.col[some], self.width, self.dense[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=len(self.dense)) + self.dense @ w[self.width :]

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.col, weights=e[self.row], minlength=self.width), self.dense.T @ e]


def _logistic(x: Rows, y: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam on all rows at once; one class only gives its constant."""
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    w, b = np.zeros(x.width + x.dense.shape[1]), float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max() or not len(w):
        return w, b
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        e = (_sigmoid(x.times(w) + b) - y) / len(y)
        g = np.r_[x.back(e) + ridge * w / 10, e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def fit(features: list[np.ndarray], y: np.ndarray, names: tuple[str, ...], fold: np.ndarray) -> Chain:
    """Chain over the columns of ``y[rows, categories]``; ``fold`` (0 .. FOLDS - 1) makes the out-of-fold
    predictions.  The last column chooses the features."""
    target = y[:, -1] == 1 if len(y) else np.zeros(0, dtype=bool)
    flat = np.concatenate([*features, np.zeros(0, dtype=np.int32)])
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    with_ = np.bincount(flat[target[row]], minlength=1 << BITS)
    without = np.bincount(flat[~target[row]], minlength=1 << BITS)
    n1, n0 = max(1, int(target.sum())), max(1, int((~target).sum()))
    some = np.flatnonzero(with_ + without >= 3)
    a, b = with_[some], without[some]
    share = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    strong = np.abs(z) >= 3.5
    some, z = some[strong], np.abs(z[strong])
    columns = np.sort(some[np.lexsort((some, -z))[:MOST_FEATURES]])
    chain = Chain(names, columns, np.zeros((len(names), len(columns) + len(names))), np.zeros(len(names)))
    at = np.minimum(np.searchsorted(columns, flat), max(0, len(columns) - 1))
    known = columns[at] == flat if len(columns) else np.zeros(len(flat), dtype=bool)
    x = Rows(row[known], at[known], len(columns), np.zeros((len(features), 0)))
    for k in range(len(names)):
        own = y[:, k].astype(float)
        w, chain.bias[k] = _logistic(x, own)
        chain.weights[k, : len(w)] = w
        if k + 1 < len(names):
            p = np.zeros(len(features))
            for f in range(FOLDS):
                out = fold == f
                if out.any():
                    w, b = _logistic(x.only(~out), own[~out])
                    p[out] = _sigmoid(x.only(out).times(w) + b)
            x = Rows(x.row, x.col, x.width, np.concatenate([x.dense, p[:, None]], axis=1))
    return chain


# -- on tables ---------------------------------------------------------------------------------
def train(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, ...]] = CATEGORIES, max_rows: int = 8_000) -> Chain:
    """Fit on at most ``max_rows`` labelled documents of the training folds (crc32 of the id's text mod 5 is not 0):
    half of them toxic ones if there are as many, those with the smallest id hashes.  ``labels(doc_id,
    toxic)``: null labels and ids are ignored, of repeated labels the highest counts.  The picked ids are broadcast and their
    features come to the driver, both bounded by ``max_rows``."""
    own = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    by = [F.xxhash64(F.lit(13), "doc_id"), F.col("doc_id")]
    bad = own.filter("toxic = 1").orderBy(*by).limit(max_rows // 2)
    good = own.filter("toxic = 0").orderBy(*by).limit(max_rows - max_rows // 2)
    words = {k: [zlib.crc32(f"={w}".encode()) >> (32 - BITS) for w in v] for k, v in categories.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for part in slices(batches):
            f = [sorted(tokens.of(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(f, pa.list_(pa.int32()))], ["doc_id", "toxic", "f"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = rows.join(F.broadcast(bad.unionAll(good)), "doc_id").select("doc_id", "toxic", "text")
    sample = picked.mapInArrow(run, "doc_id long, toxic int, f array<int>").toArrow().sort_by("doc_id")
    features = [v.values.to_numpy() for v in sample.column("f")]
    toxic = sample.column("toxic").to_numpy().astype(np.int64)
    weak = [np.array([t and int(np.isin(w, f).any()) for f, t in zip(features, toxic.tolist(), strict=True)], dtype=np.int64) for w in words.values()]
    y = np.stack([*weak, toxic], axis=1)
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in sample.column("doc_id").to_pylist()], dtype=np.int64)
    return fit(features, y, (*categories, TARGET), fold)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ..)``: ``doc_id``, a probability ``p_<category>`` for each category in
    chain order and ``toxic`` (that of the last is ``threshold`` or more).

    Null and empty texts have no features and get the models' base rates; repeated rows and null ids stay; other
    columns are ignored; an empty table gives none.  No shuffle."""
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for part in slices(batches):
            for lo in range(0, part.num_rows, 512):
                piece = part.slice(lo, 512)
                p = chain.predict([tokens.of(t) for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"`{n}` double" for n in names))
    return out.withColumn(TARGET, F.col(names[-1]) >= threshold)
