"""Mixing sources to target weights by a low-discrepancy source schedule.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``epochs_total`` times
all words; no source gets more than ``max_epochs`` times its words, what is cut off goes to the others by
weight until none is above (a water level, in closed form).

Schedule: a source of quota q words needs ceil(q / block) slots.  Slot i of 0 .. 2^L - 1 takes the i-th van
der Corput point (the bits of i reversed), which falls into the cumulative slot shares of one source; a
source's slots are ranked in slot order and the first it needs are kept.  Of 2^L evenly spread points a
source's share holds at least its slots, and every prefix of the schedule is close to the target shares.

Blocks: the documents of a source are shuffled by a keyed hash and laid end to end, ``max_epochs`` times; the
r-th slot of the source takes the r-th block of ``block`` words of this line, the last slot only up to the quota.

Everything is DataFrame operations.  Running sums are split by (source, hash prefix) and slot ranks by
(source, chunk of slots), so a source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
EPOCHS = 2
BLOCK = 2048
PREFIX = 3  # hex digits of the shuffle hash: 4096 parts of each source
CHUNK = 1 << 16
SEED = "mix-7"


def words(text: F.Column) -> F.Column:
    """Number of runs of characters that are not ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _placed_columns(doc_id: F.Column, text: F.Column, source: F.Column, seed: str) -> list[F.Column]:
    h = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return [source.alias("source"), words(text).alias("size"), h.alias("h"), F.substring(h, 1, PREFIX).alias("part")]


def targets(parts: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """One row per source of ``parts(source, part, size)``: ``source, s`` (its number), ``source_size, target``
    double, ``quota`` (whole words of the target), ``slots``.  The windows without a key run over one row per
    source, never over documents."""
    per = parts.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    number = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("s")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("s", F.lit(len(weights))) + 1)
    rows = per.select("source", "source_size", number).withColumn("w", weight)
    rows = rows.withColumn("cap", F.col("source_size") * float(epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left_words = F.sum("source_size").over(everything) * total - F.sum("cap").over(by_level)
    left_weight = F.sum("w").over(everything) - F.sum("w").over(by_level)
    # the level with the k emptiest sources full is highest for the right k
    rows = rows.withColumn("left", F.when(left_weight > 0, left_words / left_weight))
    level = F.greatest(
        F.sum("source_size").over(everything) * total / F.sum("w").over(everything), F.max("left").over(everything)
    )
    rows = rows.withColumn("target", F.least(F.col("cap"), level * F.col("w")))
    quota = F.floor("target").cast("long")
    return rows.select("source", "s", "source_size", "target", quota.alias("quota"), F.ceil(quota / F.lit(block)).cast("long").alias("slots"))


def schedule(sources: DataFrame) -> DataFrame:
    """``slot, s, r``: the slots kept, each with its source and the rank of the slot within the source.
    ``sources(s, slots)``."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not total:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).alias("s"), F.lit(0).cast("long").alias("r"))
    bits = max(1, (total - 1).bit_length())
    turned = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("decimal(19,0)")
    points = spark.range(1 << bits).select(F.col("id").alias("slot")).withColumn("turned", turned)
    points = points.withColumn("cell", F.expr(f"turned * cast({total} as decimal(19,0)) div cast({1 << bits} as decimal(19,0))"))
    width = max(1, total // 4096)
    points = points.withColumn("grid", F.expr(f"cell div {width}"))
    upto = F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shares = sources.filter("slots > 0").select("s", "slots", upto.alias("hi")).withColumn("lo", F.col("hi") - F.col("slots"))
    shares = shares.withColumn("grid", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    dealt = points.join(shares, "grid").filter("cell >= lo and cell < hi").select("slot", "s", "slots")
    dealt = dealt.withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    counts = dealt.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    rank = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("rank", rank).join(counts.select("s", "chunk", before.alias("before")), ["s", "chunk"])
    return ranked.withColumn("r", F.col("before") + F.col("rank")).filter("r < slots").select("slot", "s", "r")


def _offsets(parts: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each (source, part) starts on its source's line, with the source's figures."""
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = parts.select("source", "part", (F.sum("size").over(run) - F.col("size")).alias("part_start"))
    own = sources.withColumnRenamed("source", "own_source")
    return starts.join(own, starts["source"].eqNullSafe(own["own_source"])).drop("own_source")


def _with_start(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """``rows(source, part, h, size, ..)`` with ``start`` on the source's line and the source's figures."""
    o = offsets.withColumnRenamed("source", "o_source").withColumnRenamed("part", "o_part")
    inside = Window.partitionBy("source", "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    met = at.join(o, at["source"].eqNullSafe(o["o_source"]) & (at["part"] == o["o_part"]))
    return met.withColumn("start", F.col("part_start") + F.col("inside")).drop("o_source", "o_part", "part_start", "inside")


def taken(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ..)``: ``doc_id, size, source_size, target, taken`` (words the
    mix takes of it, repeats counted).

    Null and blank texts have size 0 and are never taken; a null source is a source of its own; repeated rows are
    separate documents; ties of the shuffle hash (a null or repeated doc_id) are ordered by size; other
    columns are ignored; an empty table gives none."""
    d = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_placed_columns(F.col("doc_id"), F.col("text"), F.col("source"), seed)),
        "mix-sizes",
    )
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("size"))
    sources = stored(targets(parts, block=block), "mix-targets")
    slots = schedule(sources)
    placed = _with_start(d, _offsets(parts, sources))
    lo = F.col("start") + F.col("epoch") * F.col("source_size")
    uses = (
        placed.filter("size > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
        .withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota")))
    )
    reach = uses.filter("hi > lo").withColumn("r", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    got = reach.join(slots, ["s", "r"]).select(
        "s", "start", (F.least("hi", (F.col("r") + 1) * block) - F.greatest("lo", F.col("r") * block)).alias("words")
    )
    # a document with words is alone in starting where it starts; one without words takes nothing
    none = placed.select("doc_id", "size", "source_size", "target", "s", "start", F.lit(0).cast("long").alias("words"), F.lit(True).alias("own"))
    worded = none.filter("size > 0").unionByName(got.withColumn("own", F.lit(False)), allowMissingColumns=True)
    summed = worded.groupBy("s", "start").agg(
        *[F.max(F.when(F.col("own"), F.struct(c))).getField(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
        F.sum("words").alias("taken"),
    )
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return summed.select(*columns).unionByName(
        none.filter("size = 0").select("doc_id", "size", "source_size", "target", F.col("words").alias("taken"))
    )


def scheduled(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The mix in its schedule: columns ``row`` (a struct of all columns of ``docs``) and ``slot``, one for each time the block that holds
    a document's first word is scheduled, so zero to ``EPOCHS`` times a document.  Sorted by slot this is the
    interleaved order.  Documents without words are in no block and do not come.  Rows cross the network once, to their
    (source, hash prefix); the slots are one row per block."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    d = docs.select(row, *_placed_columns(F.col("doc_id"), F.col("text"), F.col("source"), seed))
    sized = stored(docs.select(*_placed_columns(F.col("doc_id"), F.col("text"), F.col("source"), seed)), "mix-sizes")
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("size"))
    sources = stored(targets(parts, block=block), "mix-targets")
    slots = stored(schedule(sources), "mix-slots")
    placed = _with_start(d.filter("size > 0"), _offsets(parts, sources))
    epochs = F.array(*[F.lit(e) for e in range(EPOCHS)])
    first = F.col("start") + F.col("epoch") * F.col("source_size")
    out = placed.withColumn("epoch", F.explode(epochs)).withColumn("first", first).filter(F.col("first") < F.col("quota"))
    return out.withColumn("r", F.expr(f"first div {block}")).join(slots, ["s", "r"]).select("row", "slot")


def mixed(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The rows of ``scheduled`` with the columns of ``docs``, in no particular order."""
    return scheduled(docs, block, seed).select("row.*")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-7|' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as s from d group by source),
weighed as (
  select *, 2.0::double * source_size as cap, case s % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from per),
levels as (
  select *, sum(source_size) over () * 1.5::double as total, sum(w) over () as all_w,
         sum(cap) over (order by cap / w, s rows unbounded preceding) as full_words,
         sum(w) over (order by cap / w, s rows unbounded preceding) as full_w
  from weighed),
water as (
  select *, greatest(total / all_w, max(case when all_w - full_w > 0 then (total - full_words) / (all_w - full_w) end) over ()) as level
  from levels),
t as (select source, source_size, least(cap, level * w) as target, floor(least(cap, level * w))::bigint as quota from water),
p as (
  select doc_id, source, size,
         coalesce(sum(size) over (partition by source order by h, size rows between unbounded preceding and 1 preceding), 0) as start
  from d)
select p.doc_id, p.size, t.source_size, t.target,
       (greatest(0, least(p.start + p.size, t.quota) - p.start)
        + greatest(0, least(p.start + p.size + t.source_size, t.quota) - p.start - t.source_size))::bigint as taken
from p join t on p.source is not distinct from t.source
"""
