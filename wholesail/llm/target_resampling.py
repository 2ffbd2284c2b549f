"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

Features are runs of up to ``longest`` words, hashed into buckets.  Bucket counts of the raw and of the target texts give
one array of integer gains; a document's weight is the sum of its features' gains, its score the weight plus Gumbel
noise keyed by its id, so the k highest scores are a draw without replacement.

Exact ranks come from a parallel sort by regular sampling.  Every task sorts its rows in runs and marks
regular samples, each standing for the same share of its run.  The samples' weighted quantiles are the splitters;
every run is cut at them and its segments go to their ranges, where the sorted segments are merged.  Prefix
counts over the ranges turn places in a range into ranks.  The last key is a row's place in its run, so equal
rows, however many, are cut like any others.

The driver holds the bucket counts (``buckets`` numbers) and the samples (``SAMPLES`` for ``RUN_ROWS`` documents).
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, whole_groups

BUCKETS = 10_000
LONGEST = 1
SCALE = 1000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
RUN_ROWS = 500_000
SAMPLES = 128
_LONG = 48  # longer features are hashed one by one


# -- features of one slice of texts ------------------------------------------------------------------
@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


@lru_cache(maxsize=1)
def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased byte (A-Z only), and whether it belongs to a word: digits, letters, all beyond ASCII.  UTF-8 has only
    bytes beyond ASCII in such characters, so bytes can be judged alone."""
    b = np.arange(256, dtype=np.uint8)
    lower = np.where((b >= 0x41) & (b <= 0x5A), b | 0x20, b).astype(np.uint8)
    word = ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A)) | (lower >= 0x80)
    return lower, word


def crc32s(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of every ``data[start : start + length]``, byte by byte for all at once."""
    table = _crc_table()
    by = np.argsort(-np.minimum(length, _LONG + 1).astype(np.int16), kind="stable")
    s, n = start[by], length[by]
    crc = np.full(len(s), 0xFFFFFFFF, dtype=np.uint32)
    alive = len(s) - np.cumsum(np.bincount(np.minimum(n, _LONG), minlength=_LONG + 1))  # [k]: those longer than k
    for k, m in enumerate(alive[:_LONG].tolist()):
        if not m:
            break
        c = crc[:m]
        crc[:m] = table[(c ^ data[s[:m] + k]) & 0xFF] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > _LONG).tolist():
        crc[i] = zlib.crc32(data[s[i] : s[i] + n[i]])
    out = np.empty_like(crc)
    out[by] = crc
    return out


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of all texts in order, and per text its number of features and of words."""
    arr = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(arr) or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.int64), np.zeros(len(arr), dtype=np.int64), np.zeros(len(arr), dtype=np.int64)
    raw = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    lower, kind = _byte_classes()
    word = kind[raw]
    head = np.zeros(len(raw) + 1, dtype=bool)  # first byte of a text
    head[at] = True
    before = np.r_[False, word[:-1]] & ~head[:-1]
    keep = word | before  # the words of a text, one separator behind each
    joined = np.where(word, lower[raw], 0x20).astype(np.uint8)[keep]
    place = np.cumsum(keep) - 1
    first = np.flatnonzero(word & ~before)
    last = np.flatnonzero(word & ~(np.r_[word[1:], False] & ~head[1:]))
    doc = np.searchsorted(at, first, side="right") - 1
    start, end = place[first], place[last] + 1
    words = np.bincount(doc, minlength=len(arr)).astype(np.int64)
    parts, owners = [], []
    for n in range(1, longest + 1):
        i = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.empty(0, dtype=np.int64)
        parts.append(crc32s(joined, start[i], end[i + n - 1] - start[i]).astype(np.int64) % buckets)
        owners.append(doc[i])
    if longest == 1:
        return parts[0], words, words
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[by], np.bincount(owner, minlength=len(arr)).astype(np.int64), words


# -- gains and scores --------------------------------------------------------------------------------
def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of ``texts(text)``.  Every task sends its counts, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for part in slices(batches):
            n += np.bincount(features(part.column("text"), longest, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Smoothed log ratio of the target's to the raw share of each bucket, in whole ``1/scale``."""
    b = float(len(raw))
    ratio = (target + 1.0) * (float(raw.sum()) + b) / ((raw + 1.0) * (float(target.sum()) + b))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def noise(doc_id: int | None, seed: str = SEED, scale: int = SCALE) -> int:
    """Gumbel noise of a document, from the hash of its id (a null id counts as an empty string)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-scale * np.log(-np.log((h + 0.5) / 4294967296))))


SCORED = "doc_id long, n_features long, words long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED, scale: int = SCALE) -> DataFrame:
    """``doc_id, n_features, words, weight, score`` of every row of ``docs(doc_id, text, ..)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bucket, n, words = features(part.column("text"), longest, len(gain))
            total = np.r_[0, np.cumsum(gain[bucket])]
            weight = np.diff(total[np.r_[0, np.cumsum(n)]])
            lift = np.array([noise(i, seed, scale) for i in part.column("doc_id").to_pylist()], dtype=np.int64)
            cols = [part.column("doc_id"), *(pa.array(x) for x in (n, words, weight, weight + lift))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_features", "words", "weight", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, SCORED)


# -- parallel sort by regular sampling ---------------------------------------------------------------
_KEYS = ("score", "doc_id", "n_features")


def _key(t: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """Sort keys, most important first: score falling, null ids last, smaller id, fewer features."""
    ids = t.column("doc_id")
    none = ids.is_null().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.is_null().to_numpy()
    filled = ids.fill_null(0)
    number = lambda c: c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()
    return [-number(t.column("score")), none.astype(np.int64), number(filled), number(t.column("n_features"))]


def _sorted_runs(rows: DataFrame, run_rows: int, step: float) -> DataFrame:
    """Rows with their ``run``, place ``pos`` in the sorted run, and ``stands``: on regular samples the rows each stands for."""
    names = rows.columns

    def emit(parts: list[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        t = t.take(pa.array(np.lexsort(_key(t)[::-1])))
        n = t.num_rows
        k = max(1, int(np.ceil(n / step)))
        stands = np.full(n, np.nan)
        stands[((np.arange(k) + 0.5) * n / k).astype(np.int64)] = n / k
        t = t.append_column("run", pa.array(np.full(n, run, dtype=np.int64))).append_column("pos", pa.array(np.arange(n)))
        yield from t.append_column("stands", pa.array(stands, mask=np.isnan(stands))).to_batches(max_chunksize=50_000)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, n = TaskContext.get().partitionId() << 24, [], 0
        for big in batches:
            for lo in range(0, big.num_rows, run_rows):
                held.append(big.slice(lo, run_rows))
                n += held[-1].num_rows
                if n >= run_rows:
                    yield from emit(held, run)
                    run, held, n = run + 1, [], 0
        if n:
            yield from emit(held, run)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.select(*names).mapInArrow(sort, f"{kinds}, run long, pos long, stands double")


def _splitters(samples: pa.Table, ranges: int) -> list[tuple[int, ...]]:
    """Keys that cut the weighted samples into ``ranges`` equal parts."""
    keys = [*_key(samples), samples.column("run").to_numpy(), samples.column("pos").to_numpy()]
    by = np.lexsort(keys[::-1])
    upto = np.cumsum(samples.column("stands").to_numpy()[by])
    if not len(by):
        return []
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges, side="left")
    return sorted({tuple(int(k[by[i]]) for k in keys) for i in at.tolist()})


def _merged(runs: DataFrame, splitters: list[tuple[int, ...]], columns: list[str]) -> DataFrame:
    """``columns, range, place``: every row's range and its place in the merged range."""
    first = np.array([s[0] for s in splitters], dtype=np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [*_key(b), b.column("run").to_numpy(), b.column("pos").to_numpy()]
            to = np.searchsorted(first, keys[0], side="left")
            for i in np.flatnonzero(to != np.searchsorted(first, keys[0], side="right")).tolist():  # the score of a splitter
                to[i] = bisect_right(splitters, tuple(int(k[i]) for k in keys))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*columns, "run", "pos")), pa.array(to)], [*columns, "run", "pos", "range"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "range"):
            to = t.column("range").to_numpy()
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for lo, hi in zip(edge.tolist(), np.r_[edge[1:], len(to)].tolist(), strict=True):
                g = t.slice(lo, hi - lo)
                keys = [*_key(g), g.column("run").to_numpy(), g.column("pos").to_numpy()]
                by = np.argsort(keys[0], kind="stable")  # a stable merge sort: merges the sorted segments
                same = np.flatnonzero(np.diff(keys[0][by]) == 0)
                if len(same):  # equal scores: by the other keys
                    tied = np.zeros(len(by), dtype=bool)
                    tied[same] = tied[same + 1] = True
                    own = by[tied]
                    by[tied] = own[np.lexsort([k[own] for k in keys[::-1]])]
                out = g.select([*columns, "range"]).take(pa.array(by)).append_column("place", pa.array(np.arange(len(by))))
                yield from out.to_batches(max_chunksize=50_000)

    kinds = ", ".join(f"`{c}` {t}" for c, t in runs.select(*columns).dtypes)
    dealt = runs.mapInArrow(cut, f"{kinds}, run long, pos long, range long")
    dealt = dealt.repartition(len(splitters) + 1, "range").sortWithinPartitions("range", "run", "pos")
    return dealt.mapInArrow(merge, f"{kinds}, range long, place long")


def ranked(rows: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """``rows(doc_id, n_features, score, ..)`` with ``rank`` (1, 2, ..) by falling score, ties to the smaller doc_id, null
    ids last; equal ids and scores by n_features."""
    columns = rows.columns
    n = rows.count()
    ranges = max(1, -(-n // run_rows))
    runs = stored(_sorted_runs(rows, run_rows, max(1.0, run_rows / min(SAMPLES, ranges * 4))), "resampling-runs")
    samples = runs.filter("stands is not null").select(*_KEYS, "run", "pos", "stands").toArrow()
    merged = stored(_merged(runs, _splitters(samples, ranges), columns), "resampling-ranges")
    upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", (upto - F.col("n")).alias("start"))
    return merged.join(F.broadcast(starts), "range").select(*columns, (F.col("start") + F.col("place") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS,
    seed: str = SEED, scale: int = SCALE, run_rows: int = RUN_ROWS,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ..)``: ``doc_id, n_features, weight, score, rank``.  ``rank`` is that of the draw of
    ``percent`` % of the documents with ``least_words`` words or more towards ``target(text, ..)``, null where not drawn.

    Null and empty texts have no features and weight 0; a null id is hashed as an empty string and ranks behind
    equal scores; repeated rows are separate documents with ranks next to each other; other columns are
    ignored; an empty table gives none, an empty target still ranks (all gains then favour rare buckets)."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), scale)
    all_rows = stored(scored(docs, gain, longest, seed, scale), "resampling-scores")
    able = all_rows.filter(F.col("words") >= least_words)
    drawn = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    able = ranked(able.select(*columns), run_rows)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = all_rows.filter(F.col("words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return able.select(*columns, rank).unionAll(rest)


ORACLE = r"""
with tab as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
w as (
  select doc_id, rn, unnest(ws) as word from (
    select doc_id, row_number() over () as rn,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from documents)),
b as (
  select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from benchmark),
vocab as (
  select word, hex(encode(word)) as h, count(*) filter (raw) as s, count(*) filter (not raw) as t
  from (select word, true as raw from w union all select word, false from b) group by word),
hashed as (
  select word, s, vocab.t,
         xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
                         lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket
  from vocab, tab),
gain as (
  select bucket, floor(1000 * ln((sum(t) + 1)::double * ((select count(*) from w) + 10000)::double
                                 / ((sum(s) + 1)::double * ((select count(*) from b) + 10000)::double)))::bigint as g
  from hashed group by bucket),
weights as (
  select rn, count(*) as n, sum(g)::bigint as weight from w join hashed using (word) join gain using (bucket) group by rn),
scores as (
  select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint as h
  from (select doc_id, row_number() over () as rn from documents) d left join weights using (rn)),
s as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scores),
r as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as place,
         (10 * count(*) over (partition by n_features >= 20)) // 100 as quota
  from s)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= quota then place end::bigint as rank from r
"""
