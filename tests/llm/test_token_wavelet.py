import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wholesail.llm import token_wavelet as W

from . import data

ODD = [
    "It's they'll I'D we've 'S 'tis ''s don't.", "<|startoftext|>a <|endoftext|>", "a<|endoftext|>b <|", "É é É é ß ẞ İ İ ſ ŉ ΑΣ ς", "x\u000by\u000cz\u001c\u0085 w",
    "日本語 🙂👍🏽 ½ ² Ⅷ ४", "A1b22-c_d--e...", "​﻿ \u0000 ,, ,", "Ça n'est-ce", "×÷ ́x  \t\n\r y", "a" * 60 + "!" * 60, "1234567890 ''''ll'll", "ĲĳŒœŠš ıđð Þþ",
]


def library(texts):
    tok = W._tokenizer(W.default_tokenizer())
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def shard(ids, lengths=None):
    return W.Shard(pa.BufferReader(W.shard_bytes(np.array(ids, dtype=np.uint32), [5] if lengths is None else list(range(len(lengths))), np.array([len(ids)] if lengths is None else lengths))))


@pytest.mark.parametrize("n, most", [(0, 1), (1, 1), (500, 1), (3000, 7), (70_000, 49_408), (40_000, 1 << 20)])
def test_wavelet_matrix_answers_like_a_list(n, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), most).astype(np.uint32) % most
    s = shard(ids)
    assert s.ids().tolist() == ids.tolist() and s.doc_ids == [5] and s.tokens == n
    for i in rng.integers(0, n, 40).tolist() if n else []:
        t = int(ids[i])
        at = np.flatnonzero(ids == t)
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert s.token(i) == t and s.count(t) == len(at) and s.count(t, lo, hi) == int((ids[lo:hi] == t).sum())
        assert s.select(t, len(at) // 2) == at[len(at) // 2] and (len(at) > 50 or s.places(t) == at.tolist())
    assert s.count(most + 5) == 0 == s.count(-1) and s.places(1 << 25) == []
    with pytest.raises(IndexError):
        s.token(n)
    with pytest.raises(IndexError):
        s.select(0, n)


def test_a_reader_looks_up_without_reading_all():
    ids = np.random.default_rng(2).integers(0, 40_000, 400_000)
    raw = W.shard_bytes(ids.astype(np.uint32), [1], np.array([len(ids)]))
    s = W.Shard(pa.BufferReader(raw))
    read = []
    at = s._at
    s._at = lambda a, n: (read.append(n), at(a, n))[1]
    assert s.token(123_456) == ids[123_456] and sum(read) < len(raw) / 5
    with pytest.raises(ValueError):
        W.Shard(pa.BufferReader(b"XXXX" + raw[4:]))


def test_files_are_smaller_than_plain_ids():
    ids = np.minimum(np.random.default_rng(3).zipf(1.4, 200_000), 49_000).astype(np.uint32)
    assert len(W.shard_bytes(ids, [1], np.array([len(ids)]))) < 2 * len(ids)


def test_encoder_equals_the_library():
    rng = random.Random(4)
    alphabet = "aA zé'ÉßıİſŁ1²-.,<|>s tT́日\n\t "
    texts = ODD + [None, ""] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    e = W.Encoder(W.default_tokenizer())
    for _ in range(2):  # unknown and known pieces
        assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == library(texts)
    assert e.pieces and all(len(p) <= W._LONG for known in (e.pieces, e.chunks, e.odd) for p in known)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for r, ids in zip(order, library([x[1] for x in order]), strict=True):
        ids = [*ids, 2]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [50, 2_000_000])
def test_files_hold_the_documents_in_order(spark, shard_tokens):
    rng = random.Random(6)
    rows = [(i * 3, " ".join(data.words(rng, rng.randint(0, 40))), "en", "a", 1) for i in range(300)] + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]
    rows = [(a, (b or "").replace("\u0000", ""), *c) for a, b, *c in rows]
    rng.shuffle(rows)
    manifest = W.write(data.docs(spark, rows).repartition(7), shard_tokens=shard_tokens, range_docs=40)
    got = sorted((tuple(r) for r in W.read(manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    files = manifest.orderBy("start").collect()
    assert [f["start"] for f in files] == np.cumsum([0, *(f["n_tokens"] for f in files)])[:-1].tolist() and len(files) >= (20 if shard_tokens == 50 else 1)
    whole = {r["doc_id"]: r["ids"] for r in W.read(manifest, ids=True).collect()}
    assert all(whole[r[0]] == ids + [2] for r, ids in zip(rows, library([r[1] for r in rows]), strict=True))
    wanted = [2, whole[1000][0], 49_407, 70_000]
    assert {r["token"]: r["n"] for r in W.counts(manifest, wanted).collect()} == {t: sum(v.count(t) for v in whole.values()) for t in wanted}
    assert sorted(map(tuple, W.occurrences(manifest, wanted[1:]).collect())) == sorted((t, d, i) for d, v in whole.items() for i, x in enumerate(v) for t in wanted[1:] if x == t)


def test_edge_rows(spark):
    rows = [(a, b.replace("\u0000", "\x00") if b else b, *c) for a, b, *c in data.edge_rows()]
    got = sorted((tuple(r) for r in W.encoded(data.docs(spark, clash=True)).collect()), key=lambda r: r[1])
    want = expected(rows)
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(w[0]), w[2], w[3]) for w in want)  # null ids are ordered by their texts
    assert [g[0] for g in got] == [w[0] for w in want] and got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert W.encoded(data.docs(spark, [])).count() == 0
