import pytest
import tokenizers

from wholesail.llm import token_attribution as T
from wholesail.llm.common import table

from . import data


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute(library, doc_id, text, rule="first"):
    text = text or ""
    lines = text.split("\n")
    starts, at = [], 0
    for k, line in enumerate(lines):
        end = min(len(text), at + len(line) + 1)
        if end > at or len(lines) == 1:
            starts.append((at, end))
        at = end
    e = library.encode(text, add_special_tokens=False)
    place = [a if rule == "first" else max(a, b - 1) for a, b in e.offsets]
    return [(doc_id, k, a, b, sum(a <= p < b for p in place), len(e.ids)) for k, (a, b) in enumerate(starts)]


@pytest.mark.parametrize("rule", ["first", "last"])
def test_counts_equal_the_offsets_of_another_library(spark, library, rule):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = sorted(x for r in docs.collect() if len(r["text"] or "") < 20_000 for x in brute(library, r["doc_id"], r["text"], rule))
    got = [tuple(r) for r in T.attribute(docs, rule=rule).collect()]
    small = {w[0] for w in want}
    assert sorted(g for g in got if g[0] in small) == want
    total = {}
    for g in got:
        total[g[0]] = total.get(g[0], 0) + g[4]
    assert all(total[g[0]] == g[5] for g in got)


def test_sections_given(spark):
    rows = [(1, "hello wonderful world", [(0, 5), (5, 21), (3, 9), (None, 4), (9, 2)]), (2, None, [(0, 4)]), (3, "abc", None), (4, "日本語のテキスト", [(0, 1), (1, 8)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start:int,end:int>>")
    out = {(r["doc_id"], r["section"]): (r["n_tokens"], r["doc_tokens"]) for r in T.attribute(df).collect()}
    assert out[(1, 0)] == (1, 3) and out[(1, 1)] == (2, 3) and out[(1, 2)] == (1, 3) and out[(1, 4)] == (0, 3)
    assert out[(2, 0)] == (0, 0) and (3, 0) not in out
    n, whole = out[(4, 0)]
    assert n + out[(4, 1)][0] == whole


def test_edge_rows(spark, library):
    df = data.docs(spark, clash=True)
    got = data.rows_of(T.attribute(df.select("doc_id", "text", "size", "start", "n")))
    want = sorted((x for r in data.edge_rows() for x in brute(library, r[0], r[1])), key=repr)
    assert got == want
    assert T.attribute(data.docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        T.attribute(df, rule="most")
