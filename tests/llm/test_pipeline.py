import numpy as np
import sentencepiece

import corpus_pipeline as L
from wholesail.llm import mixing, near_order_minhash, pii_feistel, quality_pu, sentencepiece_rounds
from wholesail.llm.common import table

from . import data
from .test_mixing import expected

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_rounds.default_model())
    now = {r["doc_id"]: tuple(r) for r in docs.collect()}
    model = quality_pu.train(docs, table(spark, SF, "labels"))
    now = {i: r for i, r in now.items() if model.score(quality_pu.feature_matrix([r[1]]))[0] >= quality_pu.THRESHOLD}
    group = {r["doc_id"]: r["group_id"] for r in near_order_minhash.groups(data.docs(spark, list(now.values()))).collect()}
    now = {i: r for i, r in now.items() if group[i] == i}
    names = pii_feistel.Pseudonyms()
    now = {i: (i, names.apply(r[1])[0], *r[2:]) for i, r in now.items()}
    want = []
    rows = list(now.values())
    for doc_id, size, total, target, taken in expected(rows):
        line_starts = taken > 0
        want += [doc_id] * (int(line_starts) + int(taken > size))
    out = L.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(want)
    for r in out:
        assert r["ids"] == library.encode(now[r["doc_id"]][1] or "", add_eos=True)
        assert r["decoded"] == library.decode(r["ids"])
    assert np.mean([r["ids"][-1] == 2 for r in out]) == 1


def test_every_stage_takes_edge_rows_and_keeps_the_columns(spark):
    full, empty = data.docs(spark, clash=True), data.docs(spark, [])
    for name, stage in L.STAGES[:-1]:
        assert stage(spark, full, SF).columns == full.columns, name
        stage(spark, full, SF).collect()
        assert stage(spark, empty, SF).count() == 0
    name, last = L.STAGES[-1]
    assert last(spark, full, SF).count() == full.count() and last(spark, empty, SF).count() == 0
    assert [n for n, _ in L.STAGES] == ["quality", "near_dedup", "pii", "mix", "tokens"] and mixing.EPOCHS == 2
