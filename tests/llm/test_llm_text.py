"""Fingerprints, near-duplicates, sketches, toxicity and language on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import langid, simhash, sketch, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, page int"
rng = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), "clash", "clash", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus():
    texts = [(i, prose(40 + i, i)) for i in range(20)]
    base = prose(300, 99).split()
    for k in range(60):  # near copies in one large group
        w = list(base)
        for j in range(k % 4):
            w[(37 * k + 11 * j) % 300] = f"edit{k}x{j}"
        texts.append((100 + k, " ".join(w)))
    texts += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "two words"), (206, texts[0][1].upper()), (207, prose(20000, 5))]
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    fps = {i: plain_simhash(t) for i, t in texts}
    assert {i: simhash.simhash(t) for i, t in texts} == fps
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)
    shown = simhash.near_duplicates(table(spark, texts)).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("h"))
    assert {r["doc_id"]: r["h"] for r in shown.collect()} == {i: f"{x:016x}" for i, x in fps.items()}


def chain(n):
    """Fingerprints in chains and clusters of distinct values within a few bits."""
    out, x = set(), 0x0123456789ABCDEF
    r = random.Random(1)
    for _ in range(n):
        out.add(x)
        for b in r.sample(range(64), 2):
            x ^= 1 << b
    for _ in range(n):
        out.add(0x0F0F0F0F0F0F0F0F ^ sum(1 << b for b in r.sample(range(12), 2)))
        out.add(r.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize("small,block", [(32, 2048), (2, 8)])
def test_links_keep_every_component(spark, monkeypatch, small, block):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = chain(60)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    groups: dict = {}
    for x in fps:
        groups.setdefault(found.get(simhash.signed(x), simhash.signed(x)), set()).add(x)
    want: dict = {}
    for x, r in brute_components({x: x for x in fps}).items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_group_stays_and_ids_may_miss(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "other words here now"), (9, "other words here now"), (None, "lonely text of none")]
    kept = simhash.keep_one(table(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 9), (True, 0), (True, 0)]
    assert kept[0].asDict().keys() == set(table(spark, rows).columns)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_edits_and_likeness(spark):
    texts = [(1, prose(500, 1)), (2, prose(300, 2)), (5, None), (7, "tiny"), (9, prose(2000, 4)), (10, prose(500, 1)), (4097 * 3, prose(50, 8))]
    got = {r["doc_id"]: r for r in sketch.fingerprint_edits(table(spark, texts)).collect()}
    order = sorted(texts, key=lambda x: -x[0])
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[10]["fingerprint"] and got[5]["fingerprint"] == "4:"
    assert got[1]["near_edited"] > 0.4 > got[1]["near_next"]
    one = sketch.fingerprint_edits(table(spark, [(4, "only one text of seven words here")])).first()
    assert one["near_next"] == 1.0
    assert sketch.fingerprint_edits(table(spark, [])).count() == 0


def test_following_over_many_ranges(spark):
    ids = sorted(rng.sample(range(-500, 5000), 120))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["n"] for r in sketch.with_following(df, "doc_id", "text", "n").collect()}
    assert got == {i: f"t{p}" for i, p in zip(ids, ids[-1:] + ids[:-1])}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_machine_learns_an_interaction():
    words = {"insult": 11, "group": 22, "plain": 33}
    samples, labels = [], []
    for k in range(800):
        has = [w for j, w in enumerate(words) if k >> j & 1]
        samples.append(np.array([words[w] for w in has], dtype="<i4"))
        labels.append(float("insult" in has and "group" in has))
    machine = toxicity.fit(samples, np.array(labels), steps=600)
    row = lambda *ws: [machine.index[words[w]] for w in ws if words[w] in machine.index]
    assert machine.score(row("insult", "group")) > 0.7 > 0.3 > machine.score(row("insult")) and machine.score(row("group")) < 0.3


def test_toxic_texts_of_the_held_out_quarter(spark):
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(30, i).split()
        if bad:
            words[7:7] = ["badword", "vile" + str(i % 7)]
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    texts += [(1000, None), (1001, "")]
    marks = spark.createDataFrame(labels + [(0, 1, 0), (None, 0, 1), (7777, 0, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(table(spark, texts), marks)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_frame(table(spark, texts), machine).collect()}
    assert len(scored) == len(texts) and all(0 <= s <= 1 for s in scored.values())
    wrong = [i for i, _, bad in labels if held(i) and (scored[i] >= toxicity.THRESHOLD) != bool(bad)]
    assert wrong == [] and scored[1000] < toxicity.THRESHOLD
    none = toxicity.train(table(spark, texts), marks.filter("false"))
    assert toxicity.score_frame(table(spark, texts[:3]), none).filter("score >= 0.3").count() == 0
    assert toxicity.score_frame(table(spark, []), machine).count() == 0


def test_language_of_the_held_out_quarter(spark):
    sounds = {"en": ("th", "ing", "er", "ou"), "de": ("sch", "ung", "ei", "ch"), "fr": ("eau", "oi", "que", "ai")}
    texts, langs = [], {}
    for i in range(300):
        lang = list(sounds)[i % 3]
        r = random.Random(i)
        texts.append((i, " ".join("".join(r.choices(sounds[lang], k=3)) for _ in range(60))))
        langs[i] = lang
    texts += [(900, None), (901, "123 456 ... \u00bd"), (902, "x")]
    docs = table(spark, texts, langs)
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit_dictionaries(docs)).collect()}
    assert all(found[i]["lang_pred"] == langs[i] and 0 <= found[i]["score"] <= 1 and not found[i]["rejected"] for i in range(300) if held(i))
    assert [found[i]["lang_pred"] for i in (900, 901)] == ["und", "und"] and found[902]["lang_pred"] in sounds
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unknown, langid.fit_dictionaries(unknown)).collect()} == {"und"}
    assert langid.identify(table(spark, []), langid.fit_dictionaries(docs)).count() == 0
