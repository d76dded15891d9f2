"""Near-duplicates by exact similarity of five-word shingles, for the pipeline's stage.

Two texts are alike when the Jaccard similarity of their sets of ``WORDS``-word shingles is 0.8 or more.
SimHash brings the closest together (``simhash.links``: pivot distance tables over five-word fingerprints),
but at 0.8 a pair is expected about 10 of 64 bits apart, where no meeting keys hold and distances to
references tell nothing. So the other candidates come from an exact route, and every link, of either
kind, is verified on the whole sets:

1. prefixes: all sets are ordered alike (shingles last that most of all sets hold, then by hash); of n shingles
   the first n - ceil(0.8 n) + 1 are the prefix, and the prefixes of alike sets share a shingle. A shingle
   that more than ``HOT`` prefixes hold (a passage's, or a large group's) brings no pairs together here: two
   alike sets that share such shingles alone are both among the sets that hold one, and these are ordered
   a second time, by counts of all their shingles, with those of more than ``HOT`` sets last;
2. bounds: alike sets have sizes within 0.8 of each other, and differ in at most a ninth of both sizes
   together; the bits in which two parity sketches differ are never more than the shingles that do (a
   sketch has about two bits a shingle; a longer one is folded to the length of a shorter one);
3. leaders: in buckets of hot shingles each set is verified against ``ROUNDS`` others of its bucket, by which
   large groups of near copies become one component without all their pairs (other buckets hold at most
   ``HOT`` sets). A set meets leaders in the ``LEADS`` buckets of its least shingles by another hash, which
   alike sets mostly share, not in a fifth of all its shingles; step 4 sees to all its buckets;
4. rest: all pairs of one bucket whose components still differ are verified.

What is staged is small beside the texts: names, sizes, sketches and prefixes of the sets, and the texts
of those sets alone that are verified. Whole sets are made anew there.

Cases: texts without words are alike; a text of fewer words than a shingle is one shingle; rows
without a ``doc_id`` go where their component has one, else the one with the least text and then other
columns stays; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sheaf.llm import simhash
from sheaf.llm.batches import bound_batches, give_back, with_many, with_results
from sheaf.llm.simhash import SEED, chosen_rows, components, shingle_hashes
from sheaf.plans.staging import stage

WORDS = 5
ROUNDS = 12
#: Buckets of hot shingles in which one set meets leaders.
LEADS = 8
#: Bits of the shortest and the longest parity sketch.
SHORT_SKETCH, LONG_SKETCH = 1 << 7, 1 << 17
#: How many sets make a shingle common, and how many common ones are ordered last; shingles are counted by so many
#: first bits (what they share orders them alike, no more), so many together before they are handed on.
COMMON, MOST = 3, 200_000
PLACE_BITS, TALLIED = 42, 1 << 19
#: Longs of the sketch of fixed length that sets of hot buckets carry, for a bound inside the join.
LONGS = 16
#: Prefixes that may hold a shingle before it is hot.
HOT = 32
#: Sets that one task remembers having written, and sets that it keeps while verifying.
REMEMBERED, KEPT = 1 << 20, 256


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    return np.unique(shingle_hashes(text, words))


def name_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def least_shared(n):
    """Shingles that a set of n shares with any set alike, at least."""
    return (4 * n + 4) // 5


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of them has it."""
    bits = min(LONG_SKETCH, max(SHORT_SKETCH, 1 << (2 * len(shingles)).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fixed_parity(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parity_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, at the length of the shorter one."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def tallied(docs: DataFrame) -> DataFrame:
    """place (the first ``PLACE_BITS`` bits of a shingle) and n, the sets that hold such shingles, of those that ``COMMON`` hold.

    Every set of every text is counted, copies once: with each place goes a part of its set's name. Both travel
    as arrays, one row for each range of places and some texts, and are counted range by range.
    """

    def start():
        seen: set[int] = set()

        def emitted(sets: list[np.ndarray], names: list[int]) -> tuple[list[int], tuple]:
            places = np.concatenate(sets) >> np.uint64(64 - PLACE_BITS)
            names = np.repeat(np.array(names, np.uint16), [len(s) for s in sets])
            order = np.argsort(places)
            places, names = places[order], names[order]
            ranges = (places >> np.uint64(32)).astype(np.int64)
            first = np.concatenate(([0], np.flatnonzero(np.diff(ranges)) + 1))
            ends = [*first[1:].tolist(), len(places)]
            low, bounds = places.astype(np.uint32), list(zip(first.tolist(), ends))
            return [0] * len(first), (ranges[first], [low[x:y].tobytes() for x, y in bounds], [names[x:y].tobytes() for x, y in bounds])

        def work(texts: list[str | None]) -> Iterator[tuple[list[int], tuple]]:
            sets, names, size = [], [], 0
            for t in texts:
                s = shingle_set(t)
                sid = name_of(s)
                if sid in seen or not len(s):
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(sid)
                sets.append(s)
                names.append(sid & 0xFFFF)
                size += len(s)
                if size > TALLIED:
                    yield emitted(sets, names)
                    sets, names, size = [], [], 0
            if sets:
                yield emitted(sets, names)

        return work

    def count(group: pd.DataFrame) -> pd.DataFrame:
        low, names = (np.frombuffer(b"".join(group[c]), t) for c, t in (("low", np.uint32), ("names", np.uint16)))
        held = np.unique(low.astype(np.uint64) << np.uint64(16) | names) >> np.uint64(16)
        place, n = np.unique(held, return_counts=True)
        often = n >= COMMON
        return pd.DataFrame({"place": (int(group["range"].iat[0]) << 32) + place[often].astype(np.int64), "n": n[often].astype(np.int64)})

    dealt = with_many(docs.select("text"), (), "range int, low binary, names binary", start)
    return dealt.groupBy("range").applyInPandas(count, "place long, n long")


def common_places(docs: DataFrame) -> np.ndarray:
    """Places of the shingles that most sets hold, the rarest first; any list keeps the route exact."""
    counted = stage(tallied(docs), "alike-counted")
    # the most frequent ones that are at most MOST together: one number for each count tells from which count on
    least, size = COMMON, 0
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("places")).orderBy(F.col("n").desc()).collect():
        size += r["places"]
        if size > MOST:
            least = r["n"] + 1
            break
    top = counted.filter(F.col("n") >= least).toArrow()
    place, n = (top.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("place", "n"))
    ordered = place[np.lexsort((place, n))].view(np.uint64).copy()
    del top, place, n
    give_back()
    return ordered


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, bits: int = 64) -> np.ndarray:
    """The prefix of a set. common: sorted first ``bits`` bits of shingles; rank: where these come, from 1."""
    n = len(shingles)
    late = np.zeros(n, np.int64)
    if len(common):
        own = shingles >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        late = np.where(common[at] == own, rank[at], 0)
    return shingles[np.lexsort((shingles, late))][: n - least_shared(n) + 1]


def described(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, text_key, sid, n, fp, and, where a task meets a set first, odd and prefix of every row."""
    order = np.argsort(common)
    ordered, rank = common[order], order + 1

    def start():
        seen: set[int] = set()

        def row(text: str | None) -> tuple:
            hashes = shingle_hashes(text, WORDS)
            s = np.unique(hashes)
            sid, fp = name_of(s), simhash.signed(simhash.fingerprint_of(hashes))
            if sid in seen:
                return sid, len(s), fp, None, None
            if len(seen) < REMEMBERED:
                seen.add(sid)
            return sid, len(s), fp, parity(s), prefix(s, ordered, rank, PLACE_BITS).view(np.int64)

        return lambda texts: list(zip(*[row(t) for t in texts])) or [()] * 5

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return with_results(keyed, ("doc_id", "text_key"), "sid long, n int, fp long, odd binary, prefix array<long>", start)


def may_be_alike(a: str, b: str) -> Column:
    """What alike sets' parity sketches must fulfil."""

    @pandas_udf("boolean")
    def of(x: pd.Series, y: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([9 * parity_bits(s, t) <= m for s, t, m in zip(x, y, most)], dtype=bool)

    return of(F.col(f"{a}.odd"), F.col(f"{b}.odd"), F.col(f"{a}.n") + F.col(f"{b}.n"))


def sizes_fit(a: str, b: str) -> Column:
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def verified(a: str, b: str) -> Column:
    @pandas_udf("boolean")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        kept: dict[str, np.ndarray] = {}

        def made(text: str | None) -> np.ndarray:
            got = kept.get(text or "")
            if got is None:
                if len(kept) >= KEPT:
                    kept.clear()
                got = kept[text or ""] = shingle_set(text)
            return got

        return pd.Series([alike(made(s), made(t)) for s, t in zip(x, y)], dtype=bool)

    return of(F.col(a), F.col(b))


class Verifier:
    """Verifies pairs of named sets: first by sketches, then, for what is left, on sets made of the texts anew."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        self.docs = bound_batches(docs).select(F.xxhash64("text").alias("text_key"), "text")
        self.light = rows.filter("odd is not null").select("sid", "n", "odd").dropDuplicates(["sid"])
        self.keys = rows.groupBy("sid").agg(F.min("text_key").alias("text_key"))

    def texts(self, sids: DataFrame) -> DataFrame:
        """sid and text of few sets, found by their texts' hashes."""
        keys = stage(self.keys.join(sids.distinct(), "sid", "left_semi"), "alike-keys")
        return stage(self.docs.join(keys, "text_key").select("sid", "text").dropDuplicates(["sid"]), "alike-texts")

    def edges(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (p, q) those whose whole sets are alike, each once as a < b."""
        once = stage(pairs.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), "alike-met")
        needed = once.select(F.explode(F.array("p", "q")).alias("sid")).distinct()
        light = stage(self.light.join(needed, "sid", "left_semi"), "alike-light")
        may = once.join(light.alias("a"), F.col("p") == F.col("a.sid")).join(light.alias("b"), F.col("q") == F.col("b.sid"))
        may = stage(may.filter(sizes_fit("a", "b")).filter(may_be_alike("a", "b")).select("p", "q"), "alike-pairs")
        texts = self.texts(may.select(F.explode(F.array("p", "q")).alias("sid")))
        left = texts.select(F.col("sid").alias("p"), F.col("text").alias("x"))
        right = texts.select(F.col("sid").alias("q"), F.col("text").alias("y"))
        met = may.join(left, "p").join(right, "q")
        return stage(met.filter(verified("x", "y")).select(F.col("p").alias("a"), F.col("q").alias("b")), "alike-links")


def shared(keyed: DataFrame) -> DataFrame:
    """token and count of the tokens that the prefixes of different sets hold. keyed: token, sid, n."""
    met = keyed.groupBy("token").agg(F.min("sid").alias("x"), F.max("sid").alias("y"), F.count(F.lit(1)).alias("count"))
    return stage(met.filter("x < y").select("token", "count"), "alike-tokens")


def members_of(rows: DataFrame, verifier: Verifier) -> DataFrame:
    """level, token, sid, n: the buckets in which alike sets meet."""
    keyed = rows.filter("prefix is not null").select("sid", "n", F.explode("prefix").alias("token"))
    met = shared(keyed)
    cool = keyed.join(met.filter(F.col("count") <= HOT).select("token"), "token").select(F.lit(0).alias("level"), "token", "sid", "n").distinct()
    cool = cool.withColumn("bits", F.lit(None).cast("array<long>"))
    held = stage(keyed.join(met.filter(F.col("count") > HOT).select("token"), "token").select("sid").distinct(), "alike-held")
    again = reordered(verifier.texts(held))
    later = again.join(shared(again).select("token"), "token").select(F.lit(1).alias("level"), "token", "sid", "n", "bits")
    return stage(cool.unionByName(later), "alike-members")


def reordered(texts: DataFrame) -> DataFrame:
    """token, sid, n, bits of the prefixes of few sets, shingles that more than HOT of them hold last."""

    def start_all():
        return lambda texts: ([shingle_set(t).view(np.int64) for t in texts],)

    every = with_results(texts, ("sid",), "tokens array<long>", start_all).select("sid", F.explode("tokens").alias("token"))
    hot = stage(every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("token"), "alike-hot")
    own = stage(every.join(hot, "token").groupBy("sid").agg(F.collect_list("token").alias("hot")), "alike-own")

    def start():
        def row(text: str | None, hot: list[int] | None) -> tuple:
            s = shingle_set(text)
            late = np.array(sorted(hot or ()), np.int64).view(np.uint64)
            late.sort()
            return len(s), fixed_parity(s), prefix(s, late, np.ones(len(late), np.int64)).view(np.int64)

        return lambda texts, hots: list(zip(*[row(t, h) for t, h in zip(texts, hots)])) or [()] * 3

    added = "n int, bits array<long>, prefix array<long>"
    made = with_results(texts.join(own, "sid", "left"), ("sid",), added, start, "text", "hot")
    return made.select(F.explode("prefix").alias("token"), "sid", "n", "bits")


def close_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (p, q) of sets of one fingerprint, or of linked ones: each with the least of its own, those with each other."""
    single = rows.groupBy("fp").agg(F.min("sid").alias("p"), F.max("sid").alias("most"))
    single = stage(single, "alike-fingerprints")
    found = simhash.links(single.select("fp"))
    a, b = (single.select(F.col("fp").alias(x), F.col("p").alias(y)) for x, y in (("a", "p"), ("b", "q")))
    across = found.join(a, "a").join(b, "b").select("p", "q")
    same = rows.select("fp", F.col("sid").alias("q")).distinct().join(single.filter("p < most"), "fp").filter("q > p")
    return stage(across.unionByName(same.select("p", "q")).distinct(), "alike-close")


def led(members: DataFrame) -> DataFrame:
    """token, sid, n and leaders of the second order's buckets in which a set meets leaders.

    All rounds' leaders come from one aggregate: a plan with an aggregate and a join for each round took the
    driver some 200 MB.
    """
    every = F.array_sort(F.collect_list(F.struct(F.xxhash64("token").alias("h"), "token")))
    few = members.filter("level = 1").groupBy("sid", "n").agg(F.slice(every, 1, LEADS).alias("few"))
    own = stage(few.select(F.explode("few.token").alias("token"), "sid", "n"), "alike-led")
    # no two sets have the same hash of a round, so both columns are the same leader's
    least = [[F.min_by(c, F.xxhash64("sid", F.lit(k))).alias(c) for c in ("sid", "n")] for k in range(ROUNDS)]
    leaders = own.groupBy("token").agg(F.array(*[F.struct(*of) for of in least]).alias("leaders"))
    return stage(own.join(stage(leaders, "alike-leaders"), "token"), "alike-led")


def leader_pairs(members: DataFrame, k: int) -> DataFrame:
    """Each set of a bucket with the bucket's k-th leader, as often as both share buckets."""
    met = members.select(F.struct("sid", "n").alias("a"), F.col("leaders")[k].alias("b"))
    pairs = met.filter((F.col("a.sid") != F.col("b.sid")) & sizes_fit("a", "b"))
    return pairs.select(F.col("a.sid").alias("p"), F.col("b.sid").alias("q"))


def rest_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs of one bucket whose components differ."""
    rooted = members.join(found, members["sid"] == found["node"], "left").drop("node")
    rooted = stage(rooted.withColumn("root", F.coalesce("root", "sid")), "alike-rooted")
    mixed = rooted.groupBy("level", "token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    rest = stage(rooted.join(stage(mixed.select("level", "token"), "alike-mixed"), ["level", "token"]), "alike-rest")
    on = (F.col("a.level") == F.col("b.level")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root"))
    differ = [F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i])) for i in range(LONGS)]
    near = F.coalesce(9 * sum(differ[1:], differ[0]) <= F.col("a.n") + F.col("b.n"), F.lit(True))
    pairs = rest.alias("a").join(rest.alias("b"), on & sizes_fit("a", "b") & near)
    return pairs.select(F.col("a.sid").alias("p"), F.col("b.sid").alias("q"))


def alike_components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of every set that is alike to another one, through any number of others."""
    verifier = Verifier(docs, rows)
    members = members_of(rows, verifier)
    first, hot = close_pairs(rows), led(members)
    for k in range(ROUNDS):
        first = first.unionByName(leader_pairs(hot, k))
    edges = verifier.edges(first)
    rest = rest_pairs(members, components(edges))
    return components(edges.unionByName(verifier.edges(rest)))


def named_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, sid) of every row, and (sid, root, component_id) of every set."""
    rows = stage(described(docs, common_places(docs)), "alike-rows")
    single = rows.groupBy("sid").agg(F.min("doc_id").alias("least"))
    roots = alike_components(docs, rows)
    rooted = single.join(roots, single["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "text_key", "sid"), stage(rooted.join(least, "root").select("sid", "root", "component_id"), "alike-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, sid, component_id (smallest reachable id, its own included) of every row."""
    rows, named = named_sets(docs)
    return rows.join(named, "sid").select("doc_id", "sid", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component: of its smallest id, or without any id the least row."""
    rows, named = named_sets(docs)
    chosen = rows.join(named, "sid").filter("doc_id = component_id").select("doc_id").distinct()
    kept = chosen_rows(docs.filter("doc_id is not null"), chosen)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    alone = rows.filter("doc_id is null").join(named.filter("component_id is null"), "sid").select("text_key", "root").distinct()
    nameless = docs.filter("doc_id is null").withColumn("__key", F.xxhash64("text")).join(alone, F.col("__key") == F.col("text_key"))
    least = nameless.groupBy("root").agg(F.min(F.struct("text", *rest)).alias("r"), F.min("doc_id").alias("doc_id"))
    return kept.unionByName(least.select("doc_id", "r.*"))
