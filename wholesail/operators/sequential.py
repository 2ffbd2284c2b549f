"""Bounded walks: path-dependent scans (L11 credit check, L12 stock allocation) without one task per key.

Both rules walk through a key's rows with a *room* that is never overdrawn: a row takes an amount if the room holds it,
else it is refused and takes nothing; other rows give room back.  A give may be tied to a take (a delivery releases
its order's credit): it counts only if that take was accepted.  What a refusal leaves for the next row makes this
no window sum.

A key's rows are cut into chunks of ``CHUNK``, and a chunk's walk is a function that composes: replayed from one start,
it tells its end, and between which other starts all its decisions stay the same (the room may fall by the least that
an accepted take left over, or rise by less than the least a refused one lacked); there it only shifts the end.  So
all chunks are replayed at once from assumed starts, the results are chained over one row per chunk, and only
chunks whose true start lies outside their interval, or for which an earlier chunk refused other takes than assumed,
are replayed again.  Every round settles at least the first of these; rows of a key with one chunk are walked once.

Rows without rooms and ties that lie among fewer rows than a chunk holds are one task's from their first to their last:
they are shuffled once, sorted there and walked without places of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .joins import null_safe_join
from .windows import running_sums

CHUNK = 50_000
BINS = 1 << 16  # of keys, for finding those that may have more rows than a chunk holds
_MOST = 1 << 62  # further than any room


def _walk(batches: Iterator[pa.RecordBatch], out_rows: list[str] | None, unit: float = 1.0) -> Iterator[pa.RecordBatch]:
    """Walk the chunks of one task; per (key, chunk) its start row (side 0), the takes refused earlier (side 1), its rows.
    With ``out_rows`` the rows come out with what became of them, else one row per chunk and per take that was refused and
    has its give in a later chunk."""
    at: tuple | None = None
    begin = room = 0
    taken = 0.0
    low, high = -_MOST, _MOST
    refused: set[int] = set()
    lost: list[tuple] = []

    def closed() -> Iterator[pa.RecordBatch]:
        rows = [{"k": at[0], "chunk": at[1], "start": begin, "end": room, "low": low, "high": high}]
        rows += [{"k": at[0], "chunk": at[1], "to_chunk": c, "pos": p} for c, p in lost]
        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = None
    for b in batches:
        if schema is None:
            schema = pa.schema([("k", b.schema.field("k").type), *((c, pa.int64()) for c in ("chunk", "start", "end", "low", "high", "to_chunk", "pos"))])
        cols = [b.column(c).to_pylist() for c in ("k", "chunk", "side", "pos", "take", "amount", "pair", "later")]
        accepted: list[bool | None] = []
        before: list[int] = []
        after: list[int] = []
        sums: list[float] = []
        for k, chunk, side, pos, take, amount, pair, later in zip(*cols, strict=True):
            if (k, chunk) != at:
                if at is not None and out_rows is None:
                    yield from closed()
                at, begin, room, low, high = (k, chunk), 0, 0, -_MOST, _MOST
                refused.clear()
                lost.clear()
            ok = None
            old = room
            if side == 0:
                begin = room = amount
                taken = (pos - amount) / unit if chunk else 0.0
            elif side == 1:
                refused.add(pos)
            elif not take:
                if pair not in refused:
                    room += amount
                    taken = max(0.0, taken - amount / unit)
            elif amount <= room:
                ok = True
                low = max(low, begin - room + amount)
                room -= amount
                taken += amount / unit
            else:
                ok = False
                high = min(high, begin + amount - room - 1)
                refused.add(pos)
                if later is not None and later != chunk:
                    lost.append((later, pos))
            if out_rows is not None:
                accepted.append(ok)
                before.append(old)
                after.append(room)
                sums.append(taken)
        if out_rows is not None:
            new = [pa.array(accepted, pa.bool_()), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(sums, pa.float64())]
            done = pa.RecordBatch.from_arrays([*(b.column(c) for c in out_rows), *new], [*out_rows, "accepted", "room_before", "room_after", "taken"])
            yield done.filter(pa.compute.equal(b.column("side"), 2))
    if at is not None and out_rows is None:
        yield from closed()


def _walk_whole(batches: Iterator[pa.RecordBatch], key: str, out_rows: list[str], unit: float) -> Iterator[pa.RecordBatch]:
    """Walk the sorted rows of whole keys, each from a room of 0."""
    last, room, taken, begun = None, 0, 0.0, False
    for b in batches:
        if not b.num_rows:
            continue
        # where another key begins; a null key is one too
        codes = b.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.empty(b.num_rows, dtype=bool)
        new[1:] = codes[1:] != codes[:-1]
        new[0] = not begun or b.column(key)[0].as_py() != last
        last, begun = b.column(key)[-1].as_py(), True
        accepted: list[bool | None] = []
        before: list[int] = []
        after: list[int] = []
        sums: list[float] = []
        for first, take, amount in zip(new.tolist(), b.column("take").to_pylist(), b.column("amount").to_numpy().tolist(), strict=True):
            if first:
                room, taken = 0, 0.0
            before.append(room)
            if not take:
                ok = None
                room += amount
                taken = max(0.0, taken - amount / unit)
            elif amount <= room:
                ok = True
                room -= amount
                taken += amount / unit
            else:
                ok = False
            accepted.append(ok)
            after.append(room)
            sums.append(taken)
        made = [pa.array(accepted, pa.bool_()), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(sums, pa.float64())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out_rows), *made], [*out_rows, "accepted", "room_before", "room_after", "taken"])


def _dealt(rows: DataFrame, starts: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of chunks with their starts ``(k, chunk, start)`` and refused takes ``(k, to_chunk, pos)``, each chunk in one task."""
    room = F.col("room") if "room" in starts.columns else F.col("start")
    heads = starts.select("k", "chunk", F.lit(0).alias("side"), F.col("start").alias("amount"), room.alias("pos"))
    known = marks.select("k", F.col("to_chunk").alias("chunk"), F.lit(1).alias("side"), "pos")
    u = rows.withColumn("side", F.lit(2)).unionByName(heads, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    return u.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "side", "pos")


def _tied(rows: DataFrame, key: str) -> DataFrame:
    """``pair`` and ``amount`` of gives that are tied to a take, ``later_pos`` of takes: in the few rows of a tie, a give belongs to the
    take right before it; one without takes effect never."""
    w = Window.partitionBy(key, "tie").orderBy("pos")
    before = F.lag(F.struct("take", "pos", "amount")).over(w)
    after = F.lead(F.struct("take", "pos")).over(w)
    tied = rows.filter("tie is not null").withColumn("_b", before).withColumn("_a", after)
    mine = ~F.col("take") & F.coalesce(F.col("_b.take"), F.lit(False))
    tied = tied.withColumn("pair", F.when(mine, F.col("_b.pos"))).withColumn(
        "amount", F.when(F.col("take"), F.col("amount")).when(mine, F.col("_b.amount")).otherwise(0))
    tied = tied.withColumn("later_pos", F.when(F.col("take") & ~F.coalesce(F.col("_a.take"), F.lit(True)), F.col("_a.pos"))).drop("_a", "_b")
    none = F.lit(None).cast("long")
    return tied.unionByName(rows.filter("tie is null").withColumn("pair", none).withColumn("later_pos", none))


def _settled(hot: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """True starts ``(k, chunk, start)`` and refused takes ``(k, to_chunk, pos)`` of all chunks of keys with several."""
    spark = hot.sparkSession
    kind = hot.schema["k"].dataType.simpleString()
    result_schema = f"k {kind}, chunk long, start long, end long, low long, high long, to_chunk long, pos long"
    todo, states, lost = first, None, None
    none = spark.createDataFrame([], f"k {kind}, chunk long, to_chunk long, pos long")

    def sums(marks: DataFrame) -> DataFrame:
        return marks.groupBy("k", F.col("to_chunk").alias("chunk")).agg(F.count("*").alias("marks"), F.bit_xor(F.xxhash64("pos")).alias("mark_sum"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        room, starts, redo = int(pdf["start"].iloc[0]), [], []
        for start, end, low, high, same in zip(*(pdf[c].tolist() for c in ("start", "end", "low", "high", "same")), strict=True):
            starts.append(room)
            redo.append(not (same and low <= room <= high))
            room += end - start
        return pd.DataFrame({"k": pdf["k"], "chunk": pdf["chunk"], "start": starts, "redo": redo})

    while True:
        marks = none if lost is None else lost
        rows = null_safe_join(hot, todo.select("k", "chunk"), ["k", "chunk"], "inner")
        met = null_safe_join(marks, todo.select("k", F.col("chunk").alias("to_chunk")), ["k", "to_chunk"], "inner")
        got = _dealt(rows, todo, met).mapInArrow(lambda b: _walk(b, None), result_schema).checkpoint(eager=True)
        used = null_safe_join(got.filter("to_chunk is null").drop("to_chunk", "pos"), sums(marks), ["k", "chunk"], "left")
        fresh_lost = got.filter("to_chunk is not null").select("k", "chunk", "to_chunk", "pos")
        if states is not None:
            redone = todo.select("k", "chunk")
            used = used.unionByName(null_safe_join(states, redone, ["k", "chunk"], "left_anti"))
            fresh_lost = fresh_lost.unionByName(null_safe_join(lost, redone, ["k", "chunk"], "left_anti"))
        states, lost = used.checkpoint(eager=True), fresh_lost.checkpoint(eager=True)
        now = sums(lost).withColumnsRenamed({"marks": "now_marks", "mark_sum": "now_sum"})
        same = F.col("marks").eqNullSafe(F.col("now_marks")) & F.col("mark_sum").eqNullSafe(F.col("now_sum"))
        seen = null_safe_join(states, now, ["k", "chunk"], "left").withColumn("same", same)
        chained = seen.select("k", "chunk", "start", "end", "low", "high", "same").groupBy("k").applyInPandas(chain, f"k {kind}, chunk long, start long, redo boolean")
        chained = chained.checkpoint(eager=True)
        todo = chained.filter("redo").select("k", "chunk", "start")
        if todo.isEmpty():
            return chained.select("k", "chunk", "start"), lost.select("k", "to_chunk", "pos")


def _result(rows: DataFrame, columns: Sequence[str]) -> str:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return f"{kinds}, accepted boolean, room_before long, room_after long, taken double"


def bounded_walk(rows: DataFrame, key: str, order_cols: Sequence[str], room: DataFrame | None = None, chunk: int = CHUNK,
                 unit: float = 1.0, take: Column | None = None, amount: Column | None = None) -> DataFrame:
    """``rows(key, order_cols, take, amount, [tie], ..)`` with ``accepted`` (null for gives), ``room_before``, ``room_after`` and ``taken``,
    what is taken and not given back, added up in doubles of ``unit`` amounts from each chunk's exact start.

    Amounts are whole numbers of 0 or more (null: 0).  A key starts with its ``room(key, room)``, else 0.  Gives of a ``tie`` count if the row
    of that tie right before them is an accepted take, and give that take's amount back; gives without a tie always
    count.  Rows equal in ``order_cols`` are walked in any one order; a null key is a key of its own.  ``take`` and ``amount``
    may be given as expressions over other columns, which then are all that moves."""
    made = {"take": F.col("take") if take is None else take, "amount": F.col("amount") if amount is None else amount}
    if room is not None or "tie" in rows.columns:
        return _chunked(rows.withColumns(made), key, order_cols, room, chunk, unit)
    # a key of more than a chunk's rows lies in a bin of as many; the choice decides only how its rows are walked
    of = F.pmod(F.xxhash64(F.col(key)), F.lit(BINS)).cast("int")
    full = [r["bin"] for r in rows.groupBy(of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select("bin").collect()]
    few = rows.filter(~of.isin(full)) if full else rows
    columns = [*rows.columns, *(c for c in made if c not in rows.columns)]
    whole = F.coalesce(made["amount"].cast("long"), F.lit(0).cast("long"))
    dealt = few.repartition(key).sortWithinPartitions(key, *order_cols).withColumns({"take": made["take"], "amount": whole}).select(*columns)
    walked = dealt.mapInArrow(lambda b: _walk_whole(b, key, columns, unit), _result(dealt, columns))
    if full:
        walked = walked.unionByName(_chunked(rows.filter(of.isin(full)).withColumns(made), key, order_cols, None, chunk, unit))
    return walked


def _chunked(rows: DataFrame, key: str, order_cols: Sequence[str], room: DataFrame | None, chunk: int, unit: float) -> DataFrame:
    """``bounded_walk`` by chunks."""
    checkpoint_dir(rows.sparkSession)
    columns = [c for c in rows.columns if c != "tie"]
    d = rows if "tie" in rows.columns else rows.withColumn("tie", F.lit(None).cast("string"))
    d = d.withColumn("amount", F.coalesce(F.col("amount").cast("long"), F.lit(0))).withColumn("_one", F.lit(1).cast("long"))
    d = _tied(running_sums(d, key, order_cols, {"pos": "_one"}).drop("_one"), key)
    of = lambda c: F.floor((F.col(c) - 1) / chunk).cast("long")
    d = d.withColumns({"k": F.col(key), "chunk": of("pos"), "later": of("later_pos")}).drop("tie", "later_pos").checkpoint(eager=True)
    begins = d.groupBy("k").agg(F.max("chunk").alias("last"))
    if room is not None:
        begins = null_safe_join(begins, room.select(F.col(key).alias("k"), "room"), ["k"], "left")
    else:
        begins = begins.withColumn("room", F.lit(0))
    begins = begins.select("k", "last", F.coalesce(F.col("room").cast("long"), F.lit(0)).alias("room")).checkpoint(eager=True)
    starts = begins.filter("last = 0").select("k", F.lit(0).cast("long").alias("chunk"), F.col("room").alias("start"))
    marks = d.select("k", F.col("chunk").alias("to_chunk"), "pos").limit(0)
    many = begins.filter("last > 0")
    if not many.isEmpty():
        hot = null_safe_join(d, many.select("k", "room"), ["k"], "inner")
        change = F.sum(F.when(F.col("take"), -F.col("amount")).otherwise(F.col("amount")))
        per = hot.groupBy("k", "chunk").agg(change.alias("change"), F.first("room").alias("room"))
        prior = F.sum("change").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
        guess = F.when(F.col("chunk") == 0, F.col("room")).otherwise(F.greatest(F.lit(0), F.col("room") + F.coalesce(prior, F.lit(0))))
        first = per.select("k", "chunk", guess.alias("start"))
        settled, marks = _settled(hot.select("k", "chunk", "pos", "take", "amount", "pair", "later"), first)
        starts = starts.unionByName(settled)
    starts = null_safe_join(starts, begins.select("k", "room"), ["k"], "inner")
    return _dealt(d, starts, marks).mapInArrow(lambda b: _walk(b, columns, unit), _result(d, columns))
