"""Toxicity and language against plain versions of scoring, very long texts, repeated rows and labels."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from sheaf.llm import langid, toxicity

WORDS = {
    "en": "the of and that with from this have there which would about could their after other house river garden winter letter",
    "de": "der die und das mit von dieser haben dort welche wurde nicht schon ihre nach andere haus fluss garten winter brief",
}


def prose(lang, n, seed):
    return " ".join(random.Random(seed).choices(WORDS[lang].split(), k=n))


def plain_score(machine, text):
    """The machine's probability with every pair written out."""
    rows = sorted({machine.index[b] for b in toxicity.buckets(text) if b in machine.index})
    logit = machine.bias + sum(machine.w[i] for i in rows)
    logit += sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(rows) for j in rows[k + 1 :])
    return 1 / (1 + math.exp(-max(-40, min(40, logit))))


def test_scores_equal_all_pairs_written_out(spark):
    bad = lambda i: i % 4 == 0
    texts = [(i, prose("en", 12, i) + (" vile rogue" if bad(i) else "")) for i in range(160)]
    texts += [(i, t) for i, t in texts[:20]] + [(900, prose("en", 300_000, 7) + " vile rogue"), (901, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = [(i, 1, int(bad(i))) for i in range(160)]
    labels = spark.createDataFrame(rows + rows[:30] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score_frame(docs, machine).collect()
    assert len(got) == len(texts)
    by_id = dict(texts)
    for r in got:
        assert abs(r["score"] - plain_score(machine, by_id[r["doc_id"]])) < 1e-9
        if r["doc_id"] < 160 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            assert (r["score"] >= toxicity.THRESHOLD) == bad(r["doc_id"])


def test_terms_are_selected_without_copies_of_the_sample():
    r = np.random.default_rng(3)
    labels = (r.random(500) < 0.3).astype(float)
    samples = [np.unique(np.concatenate((r.integers(0, 200, 60), r.integers(0, toxicity.BUCKETS, 100), np.arange(300, 310)[: int(10 * y)]))).astype("<i4") for y in labels]
    tracemalloc.start()
    kept = toxicity.select_features(samples, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected, marked = [], int(labels.sum())
    for x in np.unique(np.concatenate(samples)):
        held = [int(sum(x in s for s, y in zip(samples, labels) if y == mark)) for mark in (1, 0)] if x < 310 else [0, 0]
        a, b = held[0] + 0.5, held[1] + 0.5
        c, d = max(0.5, marked + 1 - a), max(0.5, len(labels) - marked + 1 - b)
        if sum(held) >= toxicity.MIN_DF and abs(math.log(a / c) - math.log(b / d)) >= toxicity.MIN_Z * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d):
            expected.append(int(x))
    assert kept.tolist() == expected and set(range(300, 310)) <= set(expected)
    assert most < 24 << 20


def test_repeated_labelled_rows_are_learned_from_once(spark):
    docs = spark.createDataFrame([(i, prose("en", 5, i)) for i in range(40)] + [(1, f"again {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    known = labels.filter(~toxicity.held_out())
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda samples, marks, **k: seen.append(len(samples)) or fit(samples, marks, **k)
        toxicity.train(docs, labels, fit_rows=25)
    finally:
        toxicity.fit = fit
    assert seen == [min(25, known.count())]


def plain_sizes(dictionaries, text):
    """Bytes under each dictionary, windows and compressors made anew."""
    raw, sizes = langid.letters(text), []
    parts, at = [], 0
    while len(raw) - at > langid.WINDOW:
        end = raw.rfind(b" ", at + langid.WINDOW // 2, at + langid.WINDOW)
        end = end if end >= 0 else at + langid.WINDOW
        parts.append(raw[at:end])
        at = end
    parts.append(raw[at:])
    assert b"".join(parts) == raw
    for _, content in dictionaries:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        make = lambda: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(make().compress(p)) for p in parts))
    return sizes


def test_language_equals_plain_compression(spark):
    texts = [(i, prose(lang, 30 + i, i), lang) for i in range(120) for lang in (("en", "de")[i % 2],)]
    docs = spark.createDataFrame(texts + texts[:10], "doc_id long, text string, lang string").repartition(2)
    dictionaries = langid.fit_dictionaries(docs)
    found = {r["doc_id"]: r for r in langid.identify(docs, dictionaries).collect()}
    for i, t, _ in texts:
        sizes = plain_sizes(dictionaries, t)
        best = min(sizes)
        assert found[i]["lang_pred"] == dictionaries[sizes.index(best)][0]
        assert abs(found[i]["margin"] - (sorted(sizes)[1] - best) / sorted(sizes)[1]) < 1e-12


def test_margins_hold_at_any_length(spark):
    docs = spark.createDataFrame([(i, prose(lang, 200, i), lang) for i in range(60) for lang in (("en", "de")[i % 2],)], "doc_id long, text string, lang string")
    classifier = langid.Classifier(langid.fit_dictionaries(docs))
    margins = []
    for words in (200, 20_000, 3_500_000):
        lang, score, margin = classifier.predict(prose("en", words, 99))
        assert lang == "en"
        margins.append(margin)
    assert min(margins) > 0.5 * margins[0] > langid.NARROW


def test_a_language_of_long_texts_alone_is_learned(spark):
    long = [(i, prose("de", 9_000, i), "de") for i in range(12)] + [(100 + i, prose("en", 50, i), "en") for i in range(12)]
    docs = spark.createDataFrame(long, "doc_id long, text string, lang string")
    made = dict(langid.fit_dictionaries(docs))
    assert set(made) == {"de", "en"} and all(len(c) <= langid.DICT_BYTES for c in made.values())
    assert docs.agg(F.max(F.length("text"))).first()[0] > langid.MAX_FIT_CHARS
