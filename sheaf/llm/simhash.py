"""SimHash near-duplicates through pivot distance tables.

``fingerprints`` gives each text a 64-bit SimHash over word shingles. ``links`` finds the pairs of
distinct fingerprints within ``max_bits`` of each other:

1. meeting: of five disjoint blocks of bits, a pair within 3 bits agrees on at least two, so ten keys
   (one for each two blocks) bring every such pair into one bucket, exactly and by equi-join; more
   fingerprints are cut into more blocks, for wider keys and buckets of the same size;
2. pivot tables: each bucket member carries its Hamming distances to ``PIVOTS`` reference fingerprints,
   worked out once; by the triangle inequality a pair whose distances to any reference differ by more
   than ``max_bits`` can't be near, and is discarded;
3. the survivors are verified by the exact Hamming distance.

Random references alone can't bring pairs together: distances to them stay within a few bits of 32, so
one passes about 46 % of random pairs, and cells over many of them repeat each row exponentially often.

Buckets of up to ``SMALL`` members are self-joined. Larger ones (a group of near copies may hold a third
of all rows) are cut into blocks of about ``BLOCK`` members; each pair of blocks is one bounded task,
which emits a spanning star for each set it connects and never all pairs. Components are found by
alternating large and small stars over stage tables; nothing but row counts reaches the driver.

Cases: a null or blank text has fingerprint 0 and links like any other; a text of fewer words than a
shingle is hashed whole; repeated rows share a fingerprint; a null ``doc_id`` keeps its row, takes its
group's component and never names one (a group without any id has a null component); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sheaf.llm.batches import bound_batches
from sheaf.plans.staging import stage

SEED = 42
SMALL = 32
BLOCK = 2048
#: Shares into which the neighbours of one node are dealt.
SALTS = 64
#: Bits that a pair may differ in, and (most fingerprints, blocks, blocks of a key) of the meeting keys: of
#: five blocks 3 bits leave two untouched, of six three, of eight five, so keys grow wider with the rows.
MAX_BITS = 3
MEETINGS = ((1 << 26, 5, 2), (1 << 33, 6, 3), (1 << 63, 8, 5))
MASK64 = (1 << 64) - 1


def reference_fingerprints(n: int) -> list[int]:
    """n fixed 64-bit references, spread by hashing their numbers."""
    return [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(n)]


PIVOTS = reference_fingerprints(16)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, shingle_words: int, chunk: int = 1 << 15) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; fewer words than a shingle are one.

    Only A-Z are lower-cased; words split at ASCII space.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle_words + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends - 1)[min(shingle_words, len(words)) - 1 :].tolist()
    digest, out = xxhash.xxh64_intdigest, np.empty(n, np.uint64)
    for at in range(0, n, chunk):
        out[at : at + chunk] = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + chunk], stops[at : at + chunk])]
    return out


def fingerprint_of(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        raw = hashes[at : at + chunk].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned fingerprint of a whole text; 0 for one without words."""
    return fingerprint_of(shingle_hashes(text, shingle_words))


def fingerprint_column(text: str, shingle_words: int = 3) -> Column:
    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([signed(simhash(t, shingle_words)) for t in s], dtype="int64")

    return of(F.col(text))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (signed long) of every row."""
    return bound_batches(docs).select(*keep, text).select(*keep, fingerprint_column(text).alias("fp"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of so many blocks of the 64 bits, as equal as can be."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def bucket_keys(fp: str = "fp", blocks: int = 5, agree: int = 2) -> Column:
    """Array of the meeting keys: for each choice of blocks its number and the blocks' bits."""
    bounds = block_bounds(blocks)
    keys = []
    for k, chosen in enumerate(combinations(bounds, agree)):
        key = F.lit(k).cast("bigint")
        for lo, width in chosen:
            bits = F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def meeting(n: int) -> tuple[int, int]:
    """(blocks, blocks of a key) for n distinct fingerprints."""
    return next((blocks, agree) for most, blocks, agree in MEETINGS if n <= most)


def pivot_columns(fp: str = "fp") -> list[Column]:
    return [hamming(F.col(fp), F.lit(signed(p))).cast("tinyint").alias(f"p{i}") for i, p in enumerate(PIVOTS)]


def connect(fp: np.ndarray, pivots: np.ndarray, side: np.ndarray | None, max_bits: int, rows: int = 256) -> np.ndarray:
    """Labels (index of a member) of the sets that pairs within max_bits connect among ``fp``.

    side: for two different blocks, only pairs across are compared; None compares all pairs.
    """
    n = len(fp)
    label = np.arange(n)
    left, right = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        near = np.abs(pivots[part, 0][:, None] - pivots[right, 0][None, :]) <= max_bits
        a, b = np.nonzero(near)
        a, b = part[a], right[b]
        for k in range(1, pivots.shape[1]):
            ok = np.abs(pivots[a, k] - pivots[b, k]) <= max_bits
            a, b = a[ok], b[ok]
        ok = (np.bitwise_count(fp[a] ^ fp[b]) <= max_bits) & (a != b)
        a, b = a[ok], b[ok]
        while len(a):  # lower the labels of linked members until they agree
            x, y = label[a], label[b]
            ok = x != y
            if not ok.any():
                break
            x, y, a, b = x[ok], y[ok], a[ok], b[ok]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(jumped := label[label], label):
                label = jumped
    return label


def _stars(max_bits: int):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        pivots = group[[f"p{i}" for i in range(len(PIVOTS))]].to_numpy(np.int16)
        own = group["i"].iat[0] == group["j"].iat[0]
        label = connect(fp, pivots, None if own else (group["own"] == group["j"]).to_numpy(np.int8), max_bits)
        moved = label != np.arange(len(fp))
        a, b = fp[moved].view(np.int64), fp[label[moved]].view(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return link


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a < b) among the distinct values of ``fp`` that have the components of all near pairs.

    fps: one row for each distinct fingerprint, in column ``fp``. max_bits may be 0 to 3.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the meeting keys hold for at most 3 differing bits")
    keyed = fps.select("fp", F.explode(bucket_keys("fp", *meeting(fps.count()))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(keyed.join(shared, "key").select("key", "n", "fp", *pivot_columns()), "simhash-members")

    a, b = (members.filter(F.col("n") <= SMALL).alias(x) for x in "ab")
    close = [F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= max_bits for i in range(len(PIVOTS))]
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    for c in close:
        on = on & c
    pairs = a.join(b, on & (hamming(F.col("a.fp"), F.col("b.fp")) <= max_bits)).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b")
    )

    large = members.filter(F.col("n") > SMALL)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        large.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
    )
    stars = dealt.groupBy("key", "i", "j").applyInPandas(_stars(max_bits), "a long, b long")
    return pairs.unionByName(stars).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the least of its neighbourhood.

    The least is met by (node, salt): a node with many neighbours has as many rows of it as salts, so its
    neighbours are dealt over tasks.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    salted = both.groupBy("a", salt.alias("salt")).agg(F.min("b").alias("m"))
    least = salted.groupBy("a").agg(F.least(F.min("m"), F.col("a")).alias("m"), F.collect_list("salt").alias("salts"))
    met = least.select("a", "m", F.explode("salts").alias("salt"))
    larger = both.filter("b > a").withColumn("salt", salt)
    return larger.join(met, ["a", "salt"]).select(F.col("m").alias("a"), F.col("b")).filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, go to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("v"))
    return moved.filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of each connected component of edges (a < b).

    Alternating stars need a number of rounds that grows with the logarithm of the component size.
    Each round is a stage table; only a count and a checksum reach the driver.
    """
    current, seen = stage(edges, "components"), None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.min("a")).first()
        if mark[0] == 0 or mark == seen:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = mark
        current = stage(_small_star(_large_star(current)), "components")


def near_duplicates(docs: DataFrame, max_bits: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest reachable id, its own included) of every row."""
    rows = stage(fingerprints(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))), "simhash-rows")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(named, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row for each component: the one of its smallest id.

    Of repeated rows of that id the one with the least text stays. Rows without an id all stay, for
    nothing names a choice among them.
    """
    found = near_duplicates(docs, max_bits)
    return chosen_rows(docs, found.filter("doc_id = component_id").select("doc_id").distinct())


def chosen_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each id of ``chosen``, and every row without an id.

    The ids to leave out are joined, not those to keep: they are the fewer ones, so that the texts are
    often not shuffled (Spark broadcasts them if they come out small).
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    gone = stage(ids.join(chosen, "doc_id", "left_anti").select("doc_id"), "simhash-gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = stage(ids.filter("n > 1").join(chosen, "doc_id", "left_semi").select("doc_id"), "simhash-repeated")
    if repeated.isEmpty():  # the usual case needs no further pass over the texts
        return kept
    single = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    twice = kept.join(repeated, "doc_id", "left_semi")
    least = twice.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r")).select("doc_id", "r.*")
    return single.unionByName(least.select(*docs.columns))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
