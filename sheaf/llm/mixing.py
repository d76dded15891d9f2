"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Targets: sources in code point order (null last) weigh 5, 2, 1 and so on; they share ``EPOCHS_TOTAL``
times all words. No target passes ``MAX_EPOCHS`` times its source's words; the excess goes to the others
by weight until none is above. That is a common level: target = min(cap, level * weight), and with the
sources sorted by cap / weight the level follows from running sums.

Queue: each source's documents are shuffled by the md5 of their id. A document's virtual finish time is
its source's words up to and including it, divided by the source's target; a second epoch starts where
the first ends. All entries are ordered by finish time and taken until the total budget is spent. Order
and truncation are distributed: words are summed by slices of finish time, the slice in which the budget
ends is found from those sums and sliced again until it holds at most ``EDGE_ROWS`` rows; only those are
looked at one by one.

No step gathers a source: running sums go over (source, bucket of the shuffle) and then over the few
bucket totals. The oracle SQL states the same with plain windows.

Cases: a null text has size 0; null sources form one source, the last; repeated rows count each, side
by side in the queue; null ids are one id; when there is no word at all every target and take is 0; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.plans.staging import stage

WEIGHTS = (5, 2, 1)
EPOCHS_TOTAL = 1.5
MAX_EPOCHS = 2
#: Rows that a shuffle bucket of a source holds, about, and slices of one unit of finish time.
BUCKET_ROWS = 20_000
SLICES = 4096
#: Rows of a slice that are put in order at once, and the finest slices of a unit of finish time.
EDGE_ROWS, FINEST = 100_000, 1 << 48
LATEST = 64.0
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, shuffle key of every row, staged so that texts are read once."""
    return stage(
        docs.select(
            "doc_id",
            "source",
            word_count("text").alias("size"),
            F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")).cast("binary")).alias("key"),
        ),
        "mix-sizes",
    )


def targets(sized: DataFrame) -> DataFrame:
    """source, rank, source_size, target: one row for each source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    weighed = by_source.withColumn("rank", rank).withColumn("weight", weight)
    cap = (F.col("source_size") * MAX_EPOCHS).cast("double")
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * EPOCHS_TOTAL
    level = (budget - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MAX_EPOCHS) / F.sum("weight").over(after)
    # of the levels that leave their own source under its cap, the first in this order is also the highest
    levels = weighed.select("*", cap.alias("cap"), level.alias("level"))
    chosen = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(
        Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    first = F.coalesce(chosen, F.lit(0.0)) * F.col("weight")
    return levels.select("source", "rank", "source_size", F.least(F.col("cap"), first).alias("target"))


def queue(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """Every row with its source's figures and ``done``: words of the source up to and including it."""
    bits = min(16, max(6, (sized.count() // BUCKET_ROWS).bit_length()))
    head = F.conv(F.substring("key", 1, 4), 16, 10).cast("int")
    dealt = sized.withColumn("bucket", F.shiftright(head, 16 - bits))
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    bases = bases.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bases = bases.withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("run", F.sum("size").over(inside))
    joined = run.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "source", "rank", "key", "size", "source_size", "target", (F.col("base") + F.col("run")).alias("done"))


def slice_of(finish, scale: int):
    return (F.least(finish, F.lit(LATEST)) * scale).cast("long")


def cut(entries: DataFrame, budget: float):
    """Where the budget ends in the order of finish: ((slices of a unit, first slice not whole), last entry taken).

    Without a first part every entry is taken; without a second one that slice gives nothing.
    """
    scale, room, part = SLICES, budget, entries
    while True:
        sliced = part.withColumn("slice", slice_of(F.col("finish"), scale))
        sums = sliced.groupBy("slice").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        over = sums.withColumn("upto", F.sum("words").over(Window.orderBy("slice"))).filter(F.col("upto") > room).orderBy("slice").first()
        if over is None:
            return None, None
        room -= over["upto"] - over["words"]
        part = sliced.filter(F.col("slice") == over["slice"]).drop("slice")
        if over["n"] <= EDGE_ROWS or scale >= FINEST:
            break
        scale *= SLICES
    order = Window.orderBy("finish", "rank", "key", "doc_id", "epoch", "size").rowsBetween(Window.unboundedPreceding, 0)
    kept = part.withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") <= room)
    last = kept.orderBy(*[F.col(c).desc() for c in ("finish", "rank", "key", "doc_id", "epoch")]).first()
    return (scale, over["slice"]), last


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of every row."""
    sized = sizes(docs)
    aims = stage(targets(sized), "mix-targets")
    lined = stage(queue(sized, aims), "mix-queue")
    goal = aims.agg(F.sum("source_size")).first()[0] or 0
    budget = goal * EPOCHS_TOTAL
    epochs = F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))).alias("epoch")
    entries = lined.filter("target > 0").select("rank", "key", "doc_id", "size", "source_size", "target", "done", epochs)
    finish = (F.col("epoch") * F.col("source_size") + F.col("done")) / F.col("target")
    entries = entries.select("rank", "key", "doc_id", "size", "epoch", finish.alias("finish")).filter("size > 0")
    bound, last = cut(entries, budget)
    times = F.lit(0)
    for epoch in range(MAX_EPOCHS):
        at = (F.lit(epoch) * F.col("source_size") + F.col("done")) / F.col("target")
        taken = F.lit(True)
        if bound is not None:
            taken = slice_of(at, bound[0]) < bound[1]
        if last is not None:
            entry = F.struct(at.alias("f"), F.col("rank"), F.col("key"), F.col("doc_id"), F.lit(epoch).alias("e"))
            end = F.struct(
                F.lit(last["finish"]).alias("f"), F.lit(last["rank"]).alias("rank"), F.lit(last["key"]).alias("key"),
                F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["epoch"]).alias("e"),
            )
            taken = taken | (entry <= end)
        times = times + F.when((F.col("target") > 0) & taken, 1).otherwise(0)
    taken = (times * F.col("size")).cast("long").alias("taken")
    return lined.select("doc_id", "source", "size", "source_size", "target", taken)


GROUP = ("__known", "__id", "__has", "__source", "__size")


def grouped(doc_id, source, size) -> list:
    """Columns of GROUP without nulls: what tells rows of the mixture apart."""
    parts = (doc_id.isNotNull(), F.coalesce(doc_id.cast("long"), F.lit(0)), source.isNotNull(), F.coalesce(source, F.lit("")), size)
    return [p.alias(n) for p, n in zip(parts, GROUP)]


def sample_documents(docs: DataFrame) -> DataFrame:
    """``docs`` repeated as often as the mixture takes each: rows not taken go, some come twice.

    Rows of one id, source and size nearly always come equally often, and then one row of the mixture
    speaks for them. In the few groups in which the mixture ends, the rows with the least texts come more often.
    """
    columns, epochs = docs.columns, range(1, MAX_EPOCHS + 1)
    times = (F.col("taken") / F.col("size")).cast("int").alias("__n")
    mixed = mix(docs).filter("size > 0").select(*grouped(F.col("doc_id"), F.col("source"), F.col("size")), times)
    often = [F.count_if(F.col("__n") >= e).alias(f"__{e}") for e in epochs]  # how many rows come so often or more
    groups = stage(mixed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("__rows"), *often).filter("__1 > 0"), "mix-groups")
    level = [(F.col(f"__{e}") == 0) | (F.col(f"__{e}") == F.col("__rows")) for e in epochs]
    is_even = reduce(Column.__and__, level)
    rows = docs.select(*grouped(F.col("doc_id"), F.col("source"), word_count("text")), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    n = sum([F.when(F.col(f"__{e}") > 0, 1).otherwise(0) for e in epochs], F.lit(0))
    even = rows.join(groups.filter(is_even).select(*GROUP, n.alias("__n")), list(GROUP)).select("__row", "__n")
    uneven = groups.filter(~is_even)
    if not uneven.isEmpty():
        met = rows.join(uneven, list(GROUP)).withColumn("__k", F.row_number().over(Window.partitionBy(*GROUP).orderBy("__row.text")))
        own = sum([F.when(F.col("__k") <= F.col(f"__{e}"), 1).otherwise(0) for e in epochs], F.lit(0))
        even = even.unionByName(met.select("__row", own.alias("__n")).filter("__n > 0"))
    copies = even.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return copies.select(*[F.col("__row")[c].alias(c) for c in columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
caps AS (
  SELECT *, [5, 2, 1][(rank % 3)::INT + 1] AS weight, (source_size * 2)::DOUBLE AS cap FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE
             - coalesce(sum(source_size) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)
            / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM caps),
aims AS (
  SELECT source, rank, source_size,
         least(cap, coalesce((SELECT max(level) FROM levels WHERE level * weight <= cap), 0) * weight) AS target
  FROM levels),
lined AS (
  SELECT s.doc_id, s.source, a.rank, s.key, s.size, a.source_size, a.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
entries AS (
  SELECT rank, key, doc_id, size, epoch, (epoch * source_size + done)::DOUBLE / target AS finish
  FROM lined, (VALUES (0), (1)) e(epoch) WHERE target > 0),
taken AS (
  SELECT doc_id, key, rank, size,
         sum(size) OVER (ORDER BY finish, rank, key, doc_id, epoch, size ROWS UNBOUNDED PRECEDING)
         <= (SELECT sum(size) * 1.5::DOUBLE FROM sized) AS inside
  FROM entries)
SELECT l.doc_id, l.source, l.size, l.source_size, l.target,
       (l.size * (SELECT count(*) FROM taken t WHERE t.doc_id = l.doc_id AND t.inside))::BIGINT AS taken
FROM lined l
"""
