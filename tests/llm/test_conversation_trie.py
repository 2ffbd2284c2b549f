import hashlib
import random
import zlib

import pytest

from wholesail.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(n=260, seed=2, words=4):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é🙂", "longer text", ""][:words])) for c in range(n) for t in range(rng.randint(1, 9))]


def got(df, **kw):
    return sorted((tuple(r) for r in T.nodes(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [100, 2000, 32 << 20])
@pytest.mark.parametrize("words", [1, 4])
def test_nodes_equal_brute_force(spark, range_bytes, words):
    r = rows(words=words)
    random.Random(1).shuffle(r)
    assert got(spark.createDataFrame(r, SCHEMA).repartition(5), range_bytes=range_bytes) == brute(r)


@pytest.mark.parametrize("range_bytes", [600, 32 << 20])
def test_copies_long_paths_and_hot_prefixes(spark, range_bytes):
    talk = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(60)]
    r = [(c, i, *t) for c in range(40) for i, t in enumerate(talk)]  # copies
    r += [(100 + c, i, *t) for c in range(30) for i, t in enumerate(talk[: 30 + c])]  # truncated copies
    r += [(200 + c, i, *t) for c in range(60) for i, t in enumerate(talk[:7] + [("user", f"own {c}")])]  # one hot prefix
    assert got(spark.createDataFrame(r, SCHEMA), range_bytes=range_bytes) == brute(r)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    r = [(1, None, "user", "a"), (1, 0, None, "b"), (1, 0, None, "b"), (1, 5, "user", None), (1, 5, "x", "y"), (None, 1, "user", "lost"), (7, None, None, None), (-3, 1, "u", "v"), (-100, 1, "w", "z")]
    r += [(c, 0, "user", "only") for c in range(300, 330)]  # some end up without turns
    df = spark.createDataFrame(r, SCHEMA).selectExpr("*", "'a' line", "'b' key", "'c' n", "'d' depth", "'e' base", "'f' hex")
    assert got(df) == brute(r)
    assert got(spark.createDataFrame([], SCHEMA)) == [] == got(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))


def test_a_conversation_alone(spark):
    assert got(spark.createDataFrame([(500, 0, "user", "héllo")], SCHEMA)) == brute([(500, 0, "user", "héllo")])
