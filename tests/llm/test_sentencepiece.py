import random

import numpy as np
import pytest
import sentencepiece

from wholesail.llm import sentencepiece_rounds as S

from . import data


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


def texts():
    rng = random.Random(5)
    alphabet = "abthe eiou  \n\t<>0x▁é①日本語🙂the in ing  "
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    out += [" " * n for n in range(40)] + ["the" * n for n in range(30)] + ["=" * 900, " " * 5000 + "x", "ab" * 5000]
    return out + [r[1] or "" for r in data.edge_rows()]


def test_encodes_and_decodes_as_the_library(library):
    v = S.vocabulary(S.default_model())
    for lo in range(0, len(texts()), 400):
        part = texts()[lo : lo + 400]
        got, want = v.encode(part), library.encode(part)
        assert [g.tolist() for g in got] == want
        assert [v.decode(np.append(g, 2)) for g in got] == [library.decode(w + [2]) for w in want]


def test_round_trip_and_cache_limit(monkeypatch):
    v = S.Vocabulary(S.default_model())
    monkeypatch.setattr(S, "CACHE_WORDS", 10)
    part = [t for t in texts()[:200] if "▁" not in t]
    assert [v.decode(i) for i in v.encode(part)] == part


def test_long_word_takes_the_same_merges(monkeypatch, library):
    v = S.Vocabulary(S.default_model())
    monkeypatch.setattr(S, "LONG_WORD", 5)
    part = texts()[:300]
    assert [g.tolist() for g in v.encode(part)] == library.encode(part)


def test_edge_rows(spark, library):
    import hashlib

    want = sorted(
        (
            (r[0], len(ids := library.encode(r[1] or "", add_eos=True)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
            for r in data.edge_rows()
        ),
        key=repr,
    )
    assert data.rows_of(S.encode(data.docs(spark, clash=True), digest=True)) == want
    assert S.encode(data.docs(spark, [])).count() == 0
    full = {r["doc_id"]: r for r in S.encode(data.docs(spark)).collect()}
    assert full[3]["ids"] == [2] and full[2]["decoded"] == ""
