"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Best fit decreasing treats pieces of one length alike, and open sequences with the same room alike, so
the whole corpus is packed exactly from its length histogram (at most ``capacity`` numbers). A segment
tree over remaining capacities finds the tightest room that holds a length in logarithmic time; what it
finds is taken for a run of pieces at once. The plan that comes out is a list of runs: pieces number
``lo`` to ``hi`` of a length go to sequences from ``bin`` on, ``per`` to each, from ``offset`` on. Its size depends on
the capacity, not on the corpus, so it is broadcast.

The pieces themselves stay distributed. Each gets its number among the pieces of its length from a
running count inside (length, bucket) plus the counts of earlier buckets, a bucket being about
``BUCKET_PIECES`` pieces of one length; a join with the plan turns the number into a sequence and an
offset.

Cases: a null or empty text is one piece holding the end id; ids, null ones too, come back bit by bit; longer documents than the capacity are cut
into full pieces after a first one that takes the rest; repeated rows are packed each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.batches import with_many
from sheaf.llm.bpe import encoder
from sheaf.llm.tokenfiles import END_ID, default_tokenizer
from sheaf.plans.staging import stage

CAPACITY = 1024
PIECE = "piece int, start long, length long"
PLAN = "length long, lo long, hi long, bin long, per long, offset long"
#: Pieces of one length that one bucket of the numbering holds, about.
BUCKET_PIECES = 1024
#: Bytes of ids that are handed on together, about.
PART_BYTES = 1 << 21


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit) of every piece of every whole text.

    Without ids only their digest is handed on.
    """
    tokenizer = tokenizer or default_tokenizer()

    def start():
        bpe, end = encoder(tokenizer), end_id.to_bytes(4, "little")

        def work(texts: list[str | None]) -> Iterator[tuple[list[int], tuple]]:
            of, columns, size = [], ([], [], [], [], []), 0
            for i, text in enumerate(texts):
                ids = bpe.encode(text) + end
                view = memoryview(ids)
                for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                    of.append(i)
                    own = view[4 * a : 4 * (a + n)]
                    for column, value in zip(columns, (k, a, n, zlib.crc32(own))):
                        column.append(value)
                    if with_ids:
                        columns[4].append(bytes(own))
                size += len(ids)
                if size > PART_BYTES:
                    yield of, columns
                    of, columns, size = [], ([], [], [], [], []), 0
            if of:
                yield of, columns

        work.close = bpe.forget
        return work

    return with_many(docs, ("doc_id",), PIECE + ", ids_crc32 long" + (", ids binary" if with_ids else ""), start)


class Rooms:
    """Segment tree over remaining capacities: how many open sequences have each room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, lo, hi, bin, per, offset) of best fit decreasing over all pieces."""
    tree = Rooms(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    runs, fresh = [], 0

    def put(room: int, lo: int, hi: int) -> None:
        if hi > lo and room:
            open_.setdefault(room, []).append((lo, hi))
            tree.add(room, hi - lo)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        total, done = histogram[length], 0
        while done < total:
            room = tree.tightest(length)
            left = total - done
            if room is None:
                per = capacity // length
                lo, hi, room = fresh, fresh - (-left // per), capacity
                fresh = hi
            else:
                lo, hi = open_[room].pop()
                tree.add(room, lo - hi)
                per = room // length
            full = min(hi - lo, left // per)
            if full:
                runs.append((length, done, done + full * per, lo, per, capacity - room))
                done += full * per
                put(room - per * length, lo, lo + full)
            rest = min(total - done, per - 1) if lo + full < hi else 0
            if rest:
                runs.append((length, done, done + rest, lo + full, rest, capacity - room))
                done += rest
                put(room - rest * length, lo + full, lo + full + 1)
            put(room, lo + full + bool(rest), hi)
    return runs


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for each piece (column ``length``); other columns are kept."""
    spark: SparkSession = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), PLAN)
    # a length has as many buckets as its own pieces fill, so that no (length, bucket) grows with the corpus
    several = [(n, -(-c // BUCKET_PIECES)) for n, c in counts.items() if c > BUCKET_PIECES]
    buckets = F.create_map(*[F.lit(x) for pair in several for x in pair])[F.col("length")] if several else F.lit(None)
    of = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.coalesce(buckets, F.lit(1)))
    dealt = found.withColumn("__bucket", of.cast("int"))
    per_bucket = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select("length", "__bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("__row", F.row_number().over(inside) - 1).join(bases, ["length", "__bucket"])
    numbered = numbered.withColumn("__no", F.col("__base") + F.col("__row"))
    a, r = numbered.alias("a"), F.broadcast(runs).alias("r")
    on = (F.col("a.length") == F.col("r.length")) & (F.col("a.__no") >= F.col("r.lo")) & (F.col("a.__no") < F.col("r.hi"))
    step = F.col("a.__no") - F.col("r.lo")
    return a.join(r, on).select(
        *[F.col(f"a.{c}") for c in found.columns],
        (F.col("r.bin") + F.floor(step / F.col("r.per"))).alias("sequence_id"),
        (F.col("r.offset") + (step % F.col("r.per")) * F.col("r.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    The ids of a sequence in the order of ``offset`` are what a trainer reads.
    """
    return pack(stage(pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op6(spark, sf_dir: str) -> DataFrame:
    """Packs the pieces by their digests alone; ``pack_documents`` carries the ids themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(stage(pieces(docs, with_ids=False), "pieces"))
