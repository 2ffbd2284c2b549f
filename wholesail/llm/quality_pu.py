"""Quality classifier by positive-unlabelled learning (non-negative risk, Kiryo et al. 2017).

Trusted positives are labelled good documents, the unlabelled set is web text drawn from the corpus
itself; bad labels are never used as negatives.  With class prior ``p`` the risk of a scorer ``g`` is
``p R+(g) + max(0, Ru-(g) - p Rp-(g))``: the second term estimates the risk on the unseen negatives and is
kept from going below zero, which is what would let a flexible scorer overfit.  The prior is estimated
from the labelled rows (their share of good ones).

The scorer is a one-hidden-layer network on surface statistics of the whole text (byte frequencies,
word, line and repetition statistics); label, language, source and id are not inputs.  The model is fitted on
a bounded sample (``max_rows`` of each set, chosen by a hash of the id, so reruns agree) and is a few
kilobytes; scoring is a narrow pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

FOLDS = 5
THRESHOLD = 0.3


# -- features ----------------------------------------------------------------------------------
def features(text: str | None) -> np.ndarray:
    """Surface statistics of one whole text; null and empty texts give zeros."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not len(raw):
        return out
    hist = np.bincount(raw, minlength=256).astype(np.float64)
    n = float(len(raw))
    out[:128] = np.sqrt(hist[:128] / n)
    out[128] = hist[128:].sum() / n
    upper, lower, digits, blank = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[9:14].sum() + hist[32]
    marks = n - upper - lower - digits - blank - hist[128:].sum()
    out[129:134] = np.array([upper, lower, digits, blank, marks]) / n
    words = text.split()
    if words:
        sizes = np.array([len(w) for w in words], dtype=np.float64)
        distinct = set(words)
        out[134] = np.log1p(len(words)) / 10
        out[135] = sizes.mean() / 20
        out[136] = sizes.std() / 20
        out[137] = len(distinct) / len(words)
        out[138] = sum(not w[-1].isalnum() for w in distinct) / len(distinct)
        out[139] = sum(w.isupper() for w in distinct) / len(distinct)
        out[140] = sum(not any(c.isalnum() for c in w) for w in words) / len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[141] = 1 - len(set(lines)) / len(lines)
        out[142] = np.log1p(n / len(lines)) / 10
        out[143] = sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines)
    return out


N_FEATURES = 144


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), dtype=np.float32)


# -- model -------------------------------------------------------------------------------------
@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of being good, 0 to 1."""
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8)
        g = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 60, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk with the sigmoid loss by Adam.  Without positives or
    unlabelled rows the model is the constant prior."""
    d = N_FEATURES
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean = both.mean(0) if len(both) else np.zeros(d)
    scale = np.maximum(both.std(0), 1e-3) if len(both) else np.ones(d)
    prior = float(np.clip(prior, 0.01, 0.99))
    if not len(positive) or not len(unlabelled):
        return Model(mean, scale, np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))), prior)
    rng = np.random.default_rng(seed)
    zp = np.clip((positive - mean) / scale, -8, 8)
    zu = np.clip((unlabelled - mean) / scale, -8, 8)
    par = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.array(1.0)]
    m1, m2, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    half = 512
    rounds = max(1, int(np.ceil(max(len(zp), len(zu)) / half)))
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(zp)), rng.permutation(len(zu))
        for r in range(rounds):
            p = zp[np.take(order_p, np.arange(r * half, (r + 1) * half), mode="wrap")]
            u = zu[np.take(order_u, np.arange(r * half, (r + 1) * half), mode="wrap")]
            x = np.concatenate([p, u])
            h = np.tanh(x @ par[0] + par[1])
            s = 1 / (1 + np.exp(-np.clip(h @ par[2] + par[3], -40, 40)))  # loss as a negative; 1 - s as a positive
            sp, su = s[: len(p)], s[len(p) :]
            slope = s * (1 - s)
            grad = np.empty_like(s)
            if su.mean() - prior * sp.mean() >= 0:
                grad[: len(p)] = -2 * prior / len(p)
                grad[len(p) :] = 1 / len(u)
            else:  # the estimate of the negatives' risk went below zero: climb back
                grad[: len(p)] = prior / len(p)
                grad[len(p) :] = -1 / len(u)
            g = grad * slope
            back = np.outer(g, par[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * par[0], back.sum(0), h.T @ g + 1e-4 * par[2], g.sum()]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k, q in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * q
                m2[k] = 0.999 * m2[k] + 0.001 * q * q
                par[k] = par[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3]), prior)


# -- on tables ---------------------------------------------------------------------------------
def held_out(doc_id: F.Column) -> F.Column:
    """Fold 0 of 5 by crc32 of the id's text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _featured(rows: DataFrame, keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = feature_matrix(part.column("text").to_pylist())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(keep), flat], [keep, "x"])

    return rows.mapInArrow(run, f"{keep} {dict(rows.dtypes)[keep]}, x array<float>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, prior: float | None = None) -> Model:
    """Fit on at most ``max_rows`` trusted positives and ``max_rows`` unlabelled documents of the training
    folds, those with the smallest id hashes.  ``labels(doc_id, quality)``: null labels and null ids are
    ignored, of repeated labels the lowest counts.  ``prior`` overrides the estimated class prior.
    Only ids are sorted for the sample; the two id lists are broadcast (bounded by ``max_rows``)."""
    fold = ~held_out(F.col("doc_id"))
    own = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & fold)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & fold)
    if prior is None:
        n, good = own.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0))).first()
        prior = good / n if n else 0.5
    pick = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    positive = own.filter("quality = 1").select("doc_id").orderBy(*pick).limit(max_rows).withColumn("positive", F.lit(True))
    web = rows.select("doc_id").distinct().orderBy(*pick).limit(max_rows).withColumn("positive", F.lit(False))
    wanted = positive.unionAll(web)  # 2 * max_rows ids at most
    sample = _featured(rows.join(F.broadcast(wanted), "doc_id").select("positive", "text"), "positive").toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    is_positive = sample.column("positive").to_numpy().astype(bool)
    by = np.lexsort(np.r_[x.T, [is_positive]])  # the order of arrival must not matter
    x, is_positive = x[by], is_positive[by]
    return fit(x[is_positive], x[~is_positive], prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (null and empty texts too; repeated rows
    and null ids stay; other columns are ignored).  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = model.score(feature_matrix(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = model.score(feature_matrix(part.column("text").to_pylist()))
            yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
