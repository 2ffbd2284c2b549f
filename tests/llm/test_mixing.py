import hashlib
import random

import pytest

from wholesail.llm import mixing as M

from . import data


def rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(data.words(rng, rng.randint(0, 80))), "en", rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "é", "Z"]), 1) for i in range(n)]


def expected(rows):
    size = {k: len([w for w in (r[1] or "").split()]) for k, r in enumerate(rows)}
    by = {}
    for k, r in enumerate(rows):
        by.setdefault(r[3], []).append(k)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[k] for k in by[s]) for s in names}
    open_, target, left = set(names), {}, 1.5 * sum(total.values())
    while open_:  # pour by weight, stop the full ones, pour again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    out = []
    for s in names:
        line = sorted(by[s], key=lambda k: (hashlib.md5(f"mix-7|{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), size[k]))
        at = 0
        for k in line:
            quota = int(target[s])
            taken = sum(max(0, min(at + e * total[s] + size[k], quota) - at - e * total[s]) for e in (0, 1))
            out.append((rows[k][0], size[k], total[s], pytest.approx(target[s]), taken))
            at += size[k]
    return out


def test_taken_equals_the_plain_rule(spark):
    r = rows()
    got = sorted((tuple(x) for x in M.taken(data.docs(spark, r).repartition(5), block=64).collect()), key=lambda x: x[0])
    assert got == sorted(expected(r), key=lambda x: x[0])
    for s in {x[3] for x in r}:
        mine = [g for g in got if r[g[0]][3] == s]
        assert sum(g[4] for g in mine) == int(mine[0][3]) and all(g[4] <= 2 * g[1] for g in mine)


def test_schedule_spreads_sources_at_every_length(spark):
    need = {0: 700, 1: 200, 2: 100, 3: 1}
    sources = spark.createDataFrame(list(need.items()), "s int, slots long")
    got = [tuple(x) for x in M.schedule(sources).orderBy("slot").collect()]
    assert all(sorted(r for _, s, r in got if s == k) == list(range(n)) for k, n in need.items())
    for stop in (50, 100, 300, 600):
        share = sum(s == 0 for _, s, _ in got[:stop]) / stop
        assert abs(share - 700 / 1001) < 6 / stop
    ranks = {}
    for _, s, r in got:  # ranked in slot order
        assert r == ranks.get(s, 0)
        ranks[s] = r + 1


def test_mixed_rows(spark):
    r = rows()
    df = data.docs(spark, r, clash=True)
    out = M.mixed(df, block=64)
    assert out.columns == df.columns
    count = {}
    for x in out.collect():
        count[x["doc_id"]] = count.get(x["doc_id"], 0) + 1
    for doc_id, size, _, _, taken in expected(r):
        whole = count.get(doc_id, 0)
        assert whole <= 2 and (whole > 0) == (taken > 0) and abs(whole * size - taken) <= size
        assert size or not whole


def test_rows_carry_the_slot_of_their_block(spark):
    r = rows()
    got = M.scheduled(data.docs(spark, r), block=64).selectExpr("row.doc_id", "row.source", "slot").collect()
    assert sorted(x["doc_id"] for x in got) == sorted(x["doc_id"] for x in M.mixed(data.docs(spark, r), block=64).collect())
    line = {}  # where each document starts on its source's line
    for s in {x[3] for x in r}:
        at = 0
        for x in sorted((x for x in r if x[3] == s), key=lambda x: (hashlib.md5(f"mix-7|{x[0]}".encode()).hexdigest(), len(x[1].split()))):
            line[x[0]] = at
            at += len(x[1].split())
    by_source = {}
    for x in got:
        slots = by_source.setdefault(x["source"], {})
        slots[x["slot"]] = max(slots.get(x["slot"], 0), line[x["doc_id"]] // 64)
    for slots in by_source.values():  # in slot order a source's blocks follow its line, twice over at most
        blocks = [slots[k] for k in sorted(slots)]
        assert sum(a > b for a, b in zip(blocks, blocks[1:], strict=False)) <= 1
    early = [x["source"] for x in sorted(got, key=lambda x: x["slot"])[: len(got) // 4]]
    assert len(set(early)) == len({x["source"] for x in got})  # interleaved, not source by source


def test_edge_rows(spark):
    got = data.rows_of(M.taken(data.docs(spark, clash=True)))
    want = [(a, b, c, float(d.expected), e) for a, b, c, d, e in expected([(r[0], (r[1] or "").replace("\u0000", "0"), *r[2:]) for r in data.edge_rows()])]
    assert [g[:3] + g[4:] for g in got] == sorted((w[:3] + w[4:] for w in want), key=repr)
    assert sum(g[4] for g in got) > 0
    assert M.taken(data.docs(spark, [])).count() == 0 and M.mixed(data.docs(spark, [])).count() == 0
    only = M.taken(data.docs(spark, [(1, None, "en", "a", None), (2, "", "en", "b", 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2


def test_reruns_agree_and_no_python_in_the_plan(spark):
    df = data.docs(spark, rows())
    assert data.rows_of(M.taken(df)) == data.rows_of(M.taken(df.repartition(7)))
    plan = M.taken(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
