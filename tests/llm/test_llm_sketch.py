"""Fingerprints and likeness against plain versions: every length, repetitive texts, any ids, repeated rows."""

import hashlib
import random
import struct
from collections import Counter

import xxhash

from sheaf.llm import sketch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_hashes(text):
    """The distinct hashes of a text's five-word shingles: XXH64 of the words' XXH64, each seeding the next."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
    out = set()
    for i in range(max(0, len(words) - 4)):
        seed = 42
        for w in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", w), seed)
        out.add(signed(seed))
    return out


def plain_sketch(text):
    hashes = sorted(plain_hashes(text))
    under = [h for h in hashes if h < -(1 << 63) + (1 << 64) // sketch.SCALE]
    return under if len(under) >= sketch.FEW else hashes[: sketch.FEW]


def plain_likeness(a, b):
    x, y = plain_hashes(a), plain_hashes(b)
    cut = -(1 << 63) + (1 << 64) // sketch.SCALE
    u, v = {h for h in x if h < cut}, {h for h in y if h < cut}
    if min(len(u), len(v)) >= sketch.FEW:
        x, y = u, v
    least = min(len(x), len(y))
    return len(x & y) / least if least else float(len(x) == len(y))


def shown(hashes):
    return f"{sketch.SCALE}:" + "".join(f"{h & ((1 << 64) - 1):016x}" for h in hashes)


def samples():
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    out = ["", "spam " * 1000, "ham " * 1000]
    for k in range(30):
        long = r.choices(words, k=400 + 40 * k)
        out += [" ".join(long), " ".join(long[50 : 55 + 7 * k]), " ".join(r.choices(words, k=5 + 9 * k)), f"eggs{k} " * 900]
    return out


def test_rows_equal_plain_versions(spark):
    texts = list(enumerate(samples()))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {q["doc_id"]: q for q in sketch.fingerprint_edits(df).collect()}
    order = sorted(texts, reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        edited, q = t[: len(t) - k] + nxt[:k], got[i]
        assert q["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(t.split()) >= 5 and len(edited.split()) >= 5:
            assert (q["fingerprint"], q["edited_fingerprint"]) == (shown(plain_sketch(t)), shown(plain_sketch(edited)))
        if all(not x.split() or len(x.split()) >= 5 for x in (t, nxt, edited)):
            assert abs(q["near_edited"] - plain_likeness(t, edited)) < 1e-12 and abs(q["near_next"] - plain_likeness(t, nxt)) < 1e-12
    assert all(len(q["fingerprint"]) > 2 for i, q in got.items() if texts[i][1])
    assert got[1]["fingerprint"] != got[2]["fingerprint"] and got[2]["near_next"] == 0.0


def test_short_inside_long(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(40):
        long = r.choices(words, k=400)
        rows += [("inside", " ".join(long[50 : 55 + k % 20]), " ".join(long)), ("apart", " ".join(r.choices(words, k=5 + k)), " ".join(long))]
    df = spark.createDataFrame(rows, "kind string, a string, b string").repartition(4)
    made = sketch.with_sketch(sketch.with_sketch(df, "a", "x"), "b", "y")
    for q in sketch.with_likeness(made, "x", "y", "near", ("a", "b")).collect():
        assert q["near"] == (1.0 if q["kind"] == "inside" else 0.0)


def following(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return Counter((q["doc_id"], q["text"], q["n"]) for q in sketch.with_following(df, "doc_id", "text", "n").collect())


def plain_following(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    return Counter((i, t, before[1]) for (i, t), before in zip(order, order[-1:] + order[:-1]))


def test_any_ids_and_repeated_rows(spark):
    wide = [(-(1 << 63), "low"), (0, "zero"), ((1 << 63) - 1, "high"), ((1 << 53) + 1, "odd"), (1 << 53, "even"), ((1 << 62) + 3, "more")]
    crowd = [(i, f"t{i}") for i in range(150)]
    for rows in (wide, crowd + wide, [(None, "a"), (None, "b"), (None, "a"), (7, "x"), (7, "x"), (7, "x"), (7, "y"), (3, ""), (3, "")], [(5, "alone")], [(5, "twin")] * 3):
        assert following(spark, rows, 3) == plain_following(rows)
