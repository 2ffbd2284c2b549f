import random

import numpy as np
import pytest

from wholesail.llm import near_order_minhash as N

from . import data


def plain_similarity(a, b) -> float:
    """Longest common subsequence of the shingles by the full table."""
    if not len(a) or not len(b):
        return 0.0
    row = np.zeros(len(b) + 1, dtype=int)
    for x in a:
        before = row.copy()
        for j in range(len(b)):
            row[j + 1] = before[j] + 1 if x == b[j] else max(row[j], before[j + 1])
    return row[-1] / (len(a) + len(b) - row[-1])


def edited(rng, text: list[str], rate: float) -> list[str]:
    out = []
    for w in text:
        r = rng.random()
        if r < rate / 3:
            continue
        if r < 2 * rate / 3:
            out.append("".join(rng.choice("klmnop") for _ in range(5)))
        out.append(w if r >= rate / 3 and r >= rate else "".join(rng.choice("qrstuv") for _ in range(4)))
    return out


def brute(texts: dict[int, str]) -> dict[int, int]:
    sh = {i: N.shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sh[i]) and len(sh[j]) and min(len(sh[i]), len(sh[j])) >= 0.8 * max(len(sh[i]), len(sh[j])):
                common = len(np.intersect1d(sh[i], sh[j]))
                if common and plain_similarity(sh[i], sh[j]) >= 0.8:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_banded_alignment_is_exact_above_the_threshold():
    rng = random.Random(2)
    for _ in range(150):
        a = data.words(rng, rng.randint(3, 60))
        a += rng.choice([[], a[:10], a])  # repeats
        b = edited(rng, a, rng.choice([0, 0.01, 0.03, 0.1]))
        x, y = N.shingles(" ".join(a)), N.shingles(" ".join(b))
        want, got = plain_similarity(x, y), N.similarity(x, y)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_sketches_see_order_and_edits():
    rng = random.Random(4)
    a = data.words(rng, 300)
    sk = lambda w: N.sketch(x := N.shingles(" ".join(w)), N._labelled(x))
    near = (sk(a) == sk(edited(rng, a, 0.01))).sum()
    turned = (sk(a) == sk(a[150:] + a[:150])).sum()
    assert near > turned and (sk(a) == sk(data.words(rng, 300))).sum() == 0


def corpus(rng) -> dict[int, str]:
    texts, i = {}, 0
    for rate in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05):  # from copies to texts around the threshold
        base = data.words(rng, 120)
        for _ in range(14):
            texts[i] = " ".join(edited(rng, base, rate))
            i += 1
    passage = data.words(rng, 55)
    for _ in range(20):
        texts[i] = " ".join(data.words(rng, 60) + passage + data.words(rng, 60))
        i += 1
    for _ in range(20):
        texts[i] = " ".join(data.words(rng, rng.randint(1, 12)))
        i += 1
    return texts


@pytest.mark.parametrize("small_blocks", [False, True])
def test_groups_equal_brute_force(spark, monkeypatch, small_blocks):
    texts = corpus(random.Random(11))
    if small_blocks:
        monkeypatch.setattr(N, "BLOCK", 5)
        monkeypatch.setattr(N, "GATHER", 3)
        monkeypatch.setattr(N, "STAR", 2)
    df = data.docs(spark, [(i, t, "en", "a", len(t)) for i, t in texts.items()]).repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in N.groups(df).collect()}
    assert got == brute(texts)


def test_edge_rows(spark):
    df = data.docs(spark, clash=True)
    out = [(r["doc_id"], r["group_id"], r["kept"]) for r in N.groups(df).collect()]
    assert sorted(out, key=repr) == sorted(
        [(0, 0, True), (1, 0, False), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True),
         (None, 0, False), (None, None, True), (9, 9, True), (9, 9, True)], key=repr)
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([0, 2, 3, 4, 5, 6, 7, 8, 9, None], key=repr)
    assert N.groups(data.docs(spark, [])).count() == 0 and N.keep_one(data.docs(spark, [])).count() == 0


def test_groups_without_any_id(spark):
    rng = random.Random(8)
    base = data.words(rng, 200)
    near = base[:100] + ["zz"] + base[101:]
    rows = [(None, " ".join(base), "en", "a", 1), (None, " ".join(base), "en", "a", 1), (None, " ".join(near), "en", "a", 1), (4, "alone in here", "en", "a", 1)]
    out = N.groups(data.docs(spark, rows)).collect()
    assert [r["group_id"] for r in out if r["doc_id"] is None] == [None] * 3
    assert N.keep_one(data.docs(spark, rows)).count() == 3  # one of each text without an id


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("alphabet, size", [(1, 60), (2, 90), (5, 200), (400, 200)])
def test_alignment_by_bits_equals_the_table(alphabet, size):
    rng = np.random.default_rng(alphabet)
    for _ in range(8):
        x, y = (rng.integers(0, alphabet, int(rng.integers(1, size))) for _ in range(2))
        by = np.argsort(y, kind="stable")
        lo, hi = np.searchsorted(y[by], x, "left"), np.searchsorted(y[by], x, "right")
        want = lcs(x.tolist(), y.tolist())
        assert N._aligned_bits(lo, hi, by) == want == N._aligned(lo, hi, by, len(y), len(x))


def test_long_repetitive_texts_align_in_seconds():
    import time

    head, tail = N.shingles("start of one"), N.shingles("another end here")
    same = np.full(100_000, 7, dtype=np.uint64)
    a, b = np.concatenate([head, same, tail]), np.concatenate([tail, same[:95_000], head])
    began = time.process_time()
    assert N.similarity(a, b) == pytest.approx(95_000 / (len(a) + len(b) - 95_000))
    line = N.shingles("one two three four five six seven eight nine ten eleven twelve")
    a, b = np.tile(line, 9000), np.tile(np.roll(line, 3), 8500)
    assert N.similarity(a, b) > 0.8
    assert time.process_time() - began < 20
