import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wholesail.llm import target_resampling as R

from . import data

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, longest=1):
    w = WORD.findall("".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(rows, target, longest=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for x in texts:
            for f in plain_features(x, longest)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text, *_ in rows:
        f, words = plain_features(text, longest)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows(n=600, seed=5):
    rng = random.Random(seed)
    vocab = data.words(rng, 300) + ["Über", "naïve", "日本", "x" * 70, "A1-b2_c3"]
    return [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))), "en", "a", 1) for i in range(n)]


@pytest.mark.parametrize("longest, run_rows", [(1, 500_000), (1, 37), (3, 50)])
def test_draw_equals_the_plain_rule(spark, longest, run_rows):
    r = rows()
    target = [x[1].upper() for x in r[:40]] + [None, ""]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = R.resample(data.docs(spark, r).repartition(5), goal, longest=longest, run_rows=run_rows)
    assert data.rows_of(got) == brute(r, target, longest)


def test_edge_rows_and_empty_tables(spark):
    goal = spark.createDataFrame([(1, "abc def")], "item_id long, text string")
    got = R.resample(data.docs(spark, clash=True), goal, run_rows=3)
    kept = [(a, b.replace("\u0000", "\x00") if b else b, *c) for a, b, *c in data.edge_rows()]
    assert data.rows_of(got) == brute(kept, ["abc def"])
    assert R.resample(data.docs(spark, []), goal).count() == 0
    none = R.resample(data.docs(spark, rows(30)), goal.limit(0))
    assert data.rows_of(none) == brute(rows(30), [])


def test_equal_rows_are_cut_like_others(spark):
    r = [(7, " ".join(["same"] * 25), "en", "a", 1)] * 400 + [(i, f"{'other ' * 20}{i}", "en", "a", 1) for i in range(100)]
    scores = spark.createDataFrame([(x[0], 25, i % 3) for i, x in enumerate(r)], "doc_id long, n_features long, score long").repartition(4)
    got = R.ranked(scores, run_rows=20).collect()
    assert sorted(x["rank"] for x in got) == list(range(1, 501))
    by = sorted(got, key=lambda x: x["rank"])
    assert [(-x["score"], x["doc_id"]) for x in by] == sorted((-x["score"], x["doc_id"]) for x in got)
    runs = R._sorted_runs(scores, 20, 5.0).filter("stands is not null").toArrow()
    assert len(R._splitters(runs, 25)) == 24 and runs.column("stands").to_numpy().sum() == pytest.approx(500)


def test_crc_of_many_slices():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 300)
    length = rng.integers(0, 130, 300)
    got = R.crc32s(raw, start, length)
    assert got.tolist() == [zlib.crc32(raw[a : a + n]) for a, n in zip(start, length, strict=True)]
    assert R.crc32s(raw, start[:0], length[:0]).tolist() == []


def test_features_do_not_cross_texts():
    t = pa.array(["ab", "cd", None, "", "E f", "g"]).slice(1)
    bucket, n, words = R.features(t, 2, 1 << 32)
    assert n.tolist() == [1, 0, 0, 3, 1] and words.tolist() == [1, 0, 0, 2, 1]
    assert bucket.tolist() == [zlib.crc32(x) for x in (b"cd", b"e", b"f", b"e f", b"g")]
