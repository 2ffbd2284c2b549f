"""Prefix trie of conversations by truncation peeling.

A conversation becomes one binary line: 20 bytes a turn, the digest of (role, text) and the text's length, so lines compare
like sequences of turns and a prefix is a prefix.  Equal lines are counted first (partial aggregation), then the
distinct lines are parted by ranges and sorted, so a prefix that a third of all conversations share is spread over
as many tasks as it needs.

In its range a task peels the trie: from the greatest depth down, the surviving nodes lose their last turn and are
regrouped with the lines that end at this depth; counts, children, leaves and savings are added up on the way, so
the nodes are found and aggregated in one pass.  In sorted lines the nodes of a depth are runs of lines, so a
regrouping compares neighbours only.

Nodes on the path of a range's first or last line may go on in the next range.  Their sums leave out each other and
are put together afterwards, again from the greatest depth down: two rows a range and turn of one conversation,
whatever the number of conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GROUP = 100
HEADS = 6
RANGE_BYTES = 32 << 20
ITEM = 20  # bytes of a turn: 16 of the digest, 4 of the length
NO_END = hashlib.sha256(b"").hexdigest()


def lines(conversations: DataFrame) -> DataFrame:
    """``conv_id, hex``: the turns of every conversation of ``conversations(conv_id, turn, role, text, ..)`` in the order of
    ``turn`` (null first, equal turns by their digest), 40 hex digits each.  Texts stay where they are read: only
    digests cross the network."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    item = F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), item.alias("item")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.array_join(F.transform("t", lambda t: t["item"]), "").alias("hex"))


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``conv_id, line``: every conversation c with the first h = crc32(c) % ``heads`` turns of conversation c - c % ``group`` in
    place of its own first h.  A conversation lends its head to fewer than ``group`` others."""
    own = stored(lines(conversations), "trie-own")
    width = 2 * ITEM
    wanted = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    wanted = wanted.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    head = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.substring("hex", 1, width * (heads - 1)).alias("head"))
    met = wanted.join(head, "base", "left")
    line = F.concat(F.expr(f"left(coalesce(head, ''), cast({width} * h as int))"), F.expr(f"substring(hex, cast({width} * h + 1 as int))"))
    return met.select("conv_id", F.unhex(line).alias("line"))


def _ends(members: DataFrame) -> DataFrame:
    """``key, ends``: SHA-256 of the ascending ids of equal lines.  One digest of one text is a sequence by nature: the ids
    of a line (8 bytes each) stream through one task, none are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            keys, ends = [], []
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        ends.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256(str(c).encode())
                else:
                    digest.update(f",{c}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends"])

    dealt = members.repartition("key").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(run, "key binary, ends string")


def distinct_lines(members: DataFrame) -> DataFrame:
    """``line, n, conv_id, ends`` of ``members(conv_id, line)``: each distinct line with its members, the smallest, the digest of all."""
    key = F.unhex(F.md5("line"))
    per = members.groupBy("line").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).withColumn("key", key)
    return per.join(_ends(members.select("conv_id", key.alias("key"))), "key").select("line", "n", "conv_id", "ends")


# -- peeling one range -------------------------------------------------------------------------------
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PEELED = NODE + ", open boolean, chars long, key binary, parent_key binary"
_PEELED = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in PEELED.split(", ")])
_SUMS = ("n", "children", "leaves", "saved")


def _shared(items: np.ndarray, first: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Turns that each line shares with the line before it (0 for the first)."""
    out = np.zeros(len(depth), dtype=np.int64)
    alive = np.arange(1, len(depth))
    d = 0
    while len(alive):
        alive = alive[(depth[alive] > d) & (depth[alive - 1] > d)]
        alive = alive[(items[first[alive] + d] == items[first[alive - 1] + d]).all(1)]
        out[alive] = d = d + 1
    return out


def _path_keys(items: np.ndarray) -> list[bytes]:
    """Digest of every prefix of one line, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for i in items:
        h.update(i.tobytes())
        out.append(h.digest())
    return out


def peel(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted distinct lines ``t(line, n, conv_id, ends)`` of one range, deepest first."""
    line = pa.concat_arrays([c.cast(pa.large_binary()) for c in t.column("line").chunks])
    at = np.frombuffer(line.buffers()[1], dtype=np.int64)[line.offset : line.offset + len(line) + 1]
    raw = np.frombuffer(line.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    items = raw.reshape(-1, ITEM)
    first, depth = (at[:-1] - at[0]) // ITEM, np.diff(at) // ITEM
    count, conv, ends = t.column("n").to_numpy(), t.column("conv_id").to_numpy(), t.column("ends").to_pylist()
    total = len(depth)
    shared = _shared(items, first, depth)
    paths = [_path_keys(items[first[i] : first[i] + depth[i]]) for i in (0, total - 1)]
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))

    def emit(v: dict[str, np.ndarray], d: int, parent: np.ndarray | None, parent_open: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        size = len(v["lo"])
        side = np.where(v["lo"] == 0, 0, 1)
        keys = [None] * size
        ups = [None] * size
        for i in np.flatnonzero(v["open"]).tolist():
            keys[i] = paths[side[i]][d]
        if d:
            for i in np.flatnonzero(parent_open).tolist():  # a parent on the first line's path holds line 0 or else the last line
                ups[i] = paths[0][d - 1] if v["top"][i] == 0 else paths[1][d - 1]
        none = np.ones(size, dtype=bool) if parent is None else parent_open
        end = [ends[e] if e >= 0 else (None if o else NO_END) for e, o in zip(v["end"].tolist(), v["open"].tolist(), strict=True)]
        cols = [
            v["conv"], np.full(size, d), pa.array(np.zeros(size, dtype=np.int64) if parent is None else parent, mask=none),
            v["n"], v["children"], v["leaves"], v["saved"], pa.array(end, pa.string()), v["open"], v["chars"], pa.array(keys, pa.binary()), pa.array(ups, pa.binary()),
        ]
        batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=_PEELED)
        for lo in range(0, size, 50_000):
            yield batch.slice(lo, 50_000)

    level: dict[str, np.ndarray] | None = None
    for d in range(int(depth.max()), -1, -1):
        here = by_depth[cuts[d] : cuts[d + 1]]
        zero = np.zeros(len(here), dtype=np.int64)
        v = {"lo": here, "hi": here + 1, "n": count[here], "conv": conv[here], "children": zero, "leaves": zero, "saved": zero, "end": here}
        if level is not None:  # strip the last turn; what goes on in another range is added up there
            whole = ~level["open"]
            up = {k: level[k] for k in ("lo", "hi", "n", "conv")} | {"end": np.full(len(whole), -1)}
            up |= {"children": whole.astype(np.int64), "leaves": level["leaves"] * whole, "saved": level["saved"] * whole}
            v = {k: np.concatenate([x, up[k]]) for k, x in v.items()}
        order = np.argsort(v["lo"], kind="stable")
        v = {k: x[order] for k, x in v.items()}
        fresh = np.r_[True, (v["hi"][:-1] != v["lo"][1:]) | (shared[v["lo"][1:]] < d)]
        start = np.flatnonzero(fresh)
        node = {k: np.add.reduceat(v[k], start) for k in _SUMS}
        node |= {"lo": v["lo"][start], "hi": v["hi"][np.r_[start[1:], len(fresh)] - 1], "conv": np.minimum.reduceat(v["conv"], start), "end": np.maximum.reduceat(v["end"], start)}
        node["open"] = (node["lo"] == 0) | (node["hi"] == total)
        size = items[first[node["lo"]] + d - 1, 16:].astype(np.int64) @ (256 ** np.arange(3, -1, -1)) if d else np.zeros(len(start), dtype=np.int64)
        node["chars"] = size
        closed = ~node["open"]
        node["leaves"] = np.where(closed & (node["children"] == 0), 1, node["leaves"])
        node["saved"] = node["saved"] + np.where(closed, (node["n"] - 1) * size, 0)
        if level is not None:
            group = np.empty(len(order), dtype=np.int64)
            group[order] = np.cumsum(fresh) - 1
            mine = group[len(here) :]
            level["top"] = node["lo"][mine]
            yield from emit(level, d + 1, node["conv"][mine], node["open"][mine])
        level = node
    yield from emit(level, 0, None, None)


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """Open nodes of all ranges, deepest first and by key, put together; yields whole nodes with their key."""
    owed: dict[bytes, list[int]] = {}  # children, leaves, savings from open children
    wait: dict[bytes, list[dict]] = {}  # children that wait for their parent's id

    def close(g: list[dict]) -> Iterator[dict]:
        key, add = g[0]["key"], owed.pop(g[0]["key"], [0, 0, 0])
        n = {c: g[0][c] for c in ("depth", "key", "parent_key")}
        n["n_convs"], n["conv_id"] = sum(r["n_convs"] for r in g), min(r["conv_id"] for r in g)
        n["n_children"] = sum(r["n_children"] for r in g) + add[0]
        n["n_leaves"] = sum(r["n_leaves"] for r in g) + add[1] if n["n_children"] else 1
        n["saved_tokens"] = sum(r["saved_tokens"] for r in g) + add[2] + (n["n_convs"] - 1) * g[0]["chars"]
        n["ends_sha256"] = next((r["ends_sha256"] for r in g if r["ends_sha256"] is not None), NO_END)
        n["parent_conv_id"] = None
        for child in wait.pop(key, []):
            yield child | {"parent_conv_id": n["conv_id"]}
        if n["parent_key"] is None:
            yield n
            return
        wait.setdefault(n["parent_key"], []).append(n)
        up = owed.setdefault(n["parent_key"], [0, 0, 0])
        for i, x in enumerate((1, n["n_leaves"], n["saved_tokens"])):
            up[i] += x

    group: list[dict] = []
    for r in rows:
        if group and (r["depth"], r["key"]) != (group[0]["depth"], group[0]["key"]):
            yield from close(group)
            group = []
        group.append(r)
    if group:
        yield from close(group)


def trie(members: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per node of the prefix trie of ``members(conv_id, line)``: see ``nodes``."""
    rows = stored(distinct_lines(members), "trie-lines")
    size = rows.agg(F.coalesce(F.sum(F.length("line")), F.lit(0))).first()[0]
    ranges = 1 + size // range_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from peel(pa.Table.from_batches(held))

    dealt = rows.repartitionByRange(ranges, "line").sortWithinPartitions("line")
    peeled = stored(dealt.mapInArrow(run, PEELED), "trie-nodes")

    joined = NODE + ", key binary"
    schema = pa.schema([(f.name, f.type) for f in _PEELED if f.name in joined.replace(",", " ").split()])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for n in _joined(r for b in batches for r in b.to_pylist()):
            out.append(n)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    edge = peeled.filter("open").coalesce(1).sortWithinPartitions(F.col("depth").desc(), "key").mapInArrow(put, joined)
    edge = stored(edge, "trie-edges")
    columns = [c.split()[0] for c in NODE.split(", ")]
    inner = peeled.filter("not open")
    parents = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    below = inner.filter("parent_key is not null").join(parents, "parent_key")
    below = below.withColumn("parent_conv_id", F.col("up"))
    return inner.filter("parent_key is null").select(*columns).unionAll(below.select(*columns)).unionAll(edge.select(*columns))


def nodes(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts count as empty; a null turn comes first, equal turns of a conversation are ordered by their
    digest, repeated rows are turns of their own; rows without a conv_id belong to no conversation; other columns are
    ignored; an empty table gives no rows, not even a root.  A task holds one range of distinct lines (about
    ``range_bytes``) and no texts; a single conversation's digests (20 bytes a turn) are held whole."""
    return trie(stored(rebuilt(conversations, group, heads), "trie-members"), range_bytes)


ORACLE = """
with tab as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
turns as (
  select conv_id, turn, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as item, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
own as (select *, row_number() over (partition by conv_id order by turn nulls first, item) as pos from turns),
convs as (
  select conv_id, conv_id - conv_id % 100 as base, count(*) as own_turns,
         xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint), lambda c, x: xor(c >> 8, any_value(t)[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 6 as h
  from own, tab group by conv_id),
hs as (select c.*, least(h, coalesce(b.own_turns, 0)) as lent from convs c left join (select conv_id, own_turns from convs) b on b.conv_id = c.base),
rebuilt as (
  select hs.conv_id, o.pos as depth, o.item, o.chars from hs join own o on o.conv_id = hs.base and o.pos <= hs.h
  union all
  select hs.conv_id, hs.lent + o.pos - hs.h, o.item, o.chars from hs join own o on o.conv_id = hs.conv_id and o.pos > hs.h),
seqs as (
  select hs.conv_id, coalesce(list(r.item order by r.depth) filter (r.item is not null), []) as items, coalesce(list(r.chars order by r.depth) filter (r.item is not null), []) as chars
  from hs left join rebuilt r using (conv_id) group by hs.conv_id),
members as (
  select conv_id, d as depth, len(items) as len, case when d = 0 then 0 else chars[d] end as chars, md5(array_to_string(items[1:d], '')) as key,
         case when d > 0 then md5(array_to_string(items[1:d - 1], '')) end as up
  from (select *, unnest(range(len(items) + 1)) as d from seqs)),
nodes as (
  select depth, key, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len = depth), '')) as ends_sha256
  from members group by depth, key),
kids as (select depth - 1 as depth, up as key, count(*) as n from nodes where depth > 0 group by all),
sized as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k using (depth, key)),
sums as (
  select m.depth, m.key, sum(case when s.n_children = 0 then 1 else 0 end) as n_leaves, sum((s.n_convs - 1) * s.chars) as saved_tokens
  from sized s join members m on m.conv_id = s.conv_id and m.depth <= s.depth group by m.depth, m.key)
select s.conv_id, s.depth, p.conv_id as parent_conv_id, s.n_convs, s.n_children::bigint as n_children, u.n_leaves::bigint as n_leaves,
       u.saved_tokens::bigint as saved_tokens, s.ends_sha256
from sized s join sums u using (depth, key) left join nodes p on p.depth = s.depth - 1 and p.key = s.up
"""
