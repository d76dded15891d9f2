"""The pipeline's near-duplicates against brute force over whole shingle sets."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sheaf.llm import alike

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """Smallest id of every component of pairs with similarity 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if a < b and 5 * small >= 4 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def edited():
    """Near copies on both sides of 0.8, chains of them, and texts that share one passage only."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    out = []
    for g in range(12):
        base = r.choices(words, k=r.choice([20, 64, 300]))
        for k in range(8):
            w = list(base)
            for _ in range(k * len(w) // 200 + (k > 0)):
                w[r.randrange(len(w))] = f"edit{g}x{k}"
            out.append(" ".join(w))
            base = w if g % 3 == 0 else base
    passage = " ".join(r.choices(words, k=40))
    out += [" ".join([*r.choices(words, k=30), passage]) for _ in range(40)]
    out += [None, "", " \t\n", "One", "one", "two words", "a b c d e", "A b c d e", "a b c d e f"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("common", [2, 8])
def test_components_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(alike, "COMMON", common)
    texts = edited()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], COLUMNS).repartition(3)
    assert sorted(r["doc_id"] for r in alike.keep_one(docs).collect()) == brute_kept(texts)
    assert alike.keep_one(docs.limit(0)).count() == 0


def test_stage_equals_brute_force_over_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept == brute_kept(texts) and not {2, 56} <= set(kept)


def test_rows_without_an_id_are_of_their_groups(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "A b c d"), (None, "lonely text of none"), (None, "Lonely text of none"), (None, "lonely text of none")]
    rows += [(None, None), (None, ""), (9, "other words"), (None, "one more text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, "Lonely text of none"), (0, "one more text"), (3, "a b c d"), (9, "other words")]


def test_shingles_of_all_sets_are_counted_and_copies_once(spark, monkeypatch):
    monkeypatch.setattr(alike, "TALLIED", 500)
    texts = [t for _, t in edited()] * 2
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    sets = {s.tobytes(): s for s in map(alike.shingle_set, texts)}.values()
    held = Counter(x >> 64 - alike.PLACE_BITS for s in sets for x in s.tolist())
    assert {r["place"]: r["n"] for r in alike.tallied(docs).collect()} == {x: n for x, n in held.items() if n >= alike.COMMON}
    # of more texts than were once sampled none is left out
    held_by_four = F.concat(F.lit("held by four of "), F.col("id") % 15_500, F.lit(" each "), F.col("id"))
    found = alike.tallied(spark.range(62_000).select(held_by_four.alias("text"))).groupBy("n").count().collect()
    assert [(r["n"], r["count"]) for r in found] == [(4, 2 * 15_500)]


def test_leaders_are_met_by_sets_not_by_shingles(spark, monkeypatch):
    r, met = random.Random(5), []
    base = [f"w{i}" for i in range(600)]
    texts = [" ".join([*base[:at], f"edit{k}", *base[at + 1 :]]) for k, at in enumerate(r.sample(range(600), 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    pairs = alike.leader_pairs
    monkeypatch.setattr(alike, "leader_pairs", lambda members, k: met.append(members) or pairs(members, k))
    assert [x["doc_id"] for x in alike.keep_one(docs).collect()] == [0]
    assert len(met) == alike.ROUNDS and 0 < met[0].count() <= 8 * len(texts)


def test_leaders_of_all_rounds_come_from_one_aggregate(spark):
    r = random.Random(6)
    of = {s: (r.randrange(90, 130), r.sample(range(9), 3)) for s in range(-30, 30)}
    rows = [(1, t, s, n, None) for s, (n, tokens) in of.items() for t in tokens]
    members = spark.createDataFrame(rows, "level int, token long, sid long, n int, bits array<long>").repartition(3)
    hot, buckets = alike.led(members), {}
    for s, (_, tokens) in of.items():
        for t in tokens:
            buckets.setdefault(t, []).append(s)
    for k in range(alike.ROUNDS):
        hashes = {x["id"]: x["h"] for x in spark.range(-30, 30).select("id", F.xxhash64("id", F.lit(k)).alias("h")).collect()}
        pairs = {(s, min(b, key=hashes.get)) for b in buckets.values() for s in b}
        expected = {(s, q) for s, q in pairs if s != q and 5 * min(of[s][0], of[q][0]) >= 4 * max(of[s][0], of[q][0])}
        made = alike.leader_pairs(hot, k)
        assert {(x["p"], x["q"]) for x in made.collect()} == expected
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan  # else the driver plans and runs both ROUNDS times at once
