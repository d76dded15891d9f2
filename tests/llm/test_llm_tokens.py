"""Token files, packing, counts, mixing, URL rules and media against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm import bpe, counts, lockstep, media, mixing, packing, tokenfiles, urls, webp
from sheaf.plans.staging import stage_path

PATH = tokenfiles.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "Hello world, it's a test.\nNew line  double  space", "", None, " lead", "trail ", "tab\there", "a\r\nb", "x\n\ny", "naïve café — “quotes”", "日本語 テキスト",
    "<|endoftext|> inside <|endoftext|>", "123 4567 8.9", "don't we'll I'M", "emoji 😀 ok", "a\u00a0b c", "word," * 50, "\n", " ", "a  ", "a \nb", "end.\n",
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("length", F.lit(0)).repartition(3)


def test_chunked_ids_equal_the_library():
    chunked = bpe.ChunkedBpe(PATH)
    for t in TEXTS:
        assert np.frombuffer(chunked.encode(t), "<u4").tolist() == ids_of(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sdl .,\n\t0é日 —<|>endoftx\u00a0", max_size=60))
def test_chunked_ids_on_random_texts(text):
    assert np.frombuffer(bpe.encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)


def test_letters_with_signs_need_no_whole_call_and_a_full_memo_stays_at_hand(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    chunked, whole, made = bpe.ChunkedBpe(PATH), [], []
    library, word = chunked._library, chunked._word
    monkeypatch.setattr(chunked, "_library", lambda text: whole.append(text) or library(text))
    monkeypatch.setattr(chunked, "_word", lambda text, space: made.append(text) or word(text, space))
    text = "so " + " ".join(f"the, {w}%%% {w}&&& ({w}) the." for w in "one zwei très four fünf six".split()) + "\n*** ends!?"
    assert np.frombuffer(chunked.encode(text), "<u4").tolist() == ids_of(text)
    assert all(t[1] == "(" for t in whole) and made.count("the") == 1
    for odd in ("a.'s b", "don't! x'll, y", "a_b c_ d", "x² y½, z³.", "word…, “q”."):
        assert np.frombuffer(chunked.encode(odd), "<u4").tolist() == ids_of(odd)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=0, max_size=80))
def test_elias_fano_round_trip(sizes):
    ends = np.cumsum([0, *sizes])
    fano = tokenfiles.EliasFano.build(ends)
    assert [fano[i] for i in range(len(ends))] == ends.tolist() == fano.all().tolist()


def test_file_round_trip_and_width():
    rows = [np.array(x, dtype="<u4") for x in ([1, 2, 3], [], [70000], [5])]
    f = tokenfiles.TokenFile(tokenfiles.encode_file(rows))
    assert [f.document(i).tolist() for i in range(4)] == [r.tolist() for r in rows] and f.ids.dtype == np.dtype("<u4")
    assert tokenfiles.TokenFile(tokenfiles.encode_file(rows[:1])).ids.dtype == np.dtype("<u2")
    with pytest.raises(IndexError):
        f.document(4)
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"x" * 60)


def test_token_files(spark):
    rows = [(3 * i - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "same id"), (7, "same id")]
    path = stage_path(spark, "test-token-files")
    tokenfiles.write_token_files(docs(spark, rows), path, file_ids=40)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read_token_files(spark, path).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*ids_of(t), 2], dtype="<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    path = stage_path(spark, "test-no-files")
    tokenfiles.write_token_files(docs(spark, []), path)
    assert tokenfiles.read_token_files(spark, path).count() == 0


def test_parts_of_any_size_are_added_up(spark):
    sizes, path = [200, 3, 0xA9C3, 0x10F0C2, 1], stage_path(spark, "test-sizes")
    rows = [(p, 0, 0, np.array([p], "<i8").tobytes(), 0, tokenfiles.encode_file([np.zeros(n, "<u4")])) for p, n in enumerate(sizes)]
    spark.createDataFrame(rows, tokenfiles.SCHEMA).write.parquet(path)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in tokenfiles.read_token_files(spark, path).collect())
    assert got == [(p, sum(sizes[:p]), n) for p, n in enumerate(sizes)]


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] -= n
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.just(40))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used, seen = {}, {}
    for length, lo, hi, first, per, offset in packing.plan(histogram, capacity):
        for k in range(hi - lo):
            used.setdefault(first + k // per, []).append((offset + k % per * length, length))
        seen.setdefault(length, []).extend(range(lo, hi))
    assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit(lengths, capacity)


def test_packing_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 10)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "word " * 3000), (51, "same"), (51, "same"), (None, "no id")]
    got = packing.pack_documents(docs(spark, rows), 64).collect()
    spans: dict = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for start, length in sorted(s):
            assert start == at
            at += length
        assert at <= 64
    whole = [*ids_of("word " * 3000), 2]
    cut = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 50)
    first = len(whole) % 64 or 64
    assert [c[2] for c in cut] == [first] + [64] * ((len(whole) - first) // 64)
    assert all(zlib.crc32(np.array(whole[a : a + n], dtype="<u4").tobytes()) == crc for _, a, n, crc in cut)
    assert len(spans) == best_fit([r["length"] for r in got], 64)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack_documents(docs(spark, []), 64).count() == 0


def test_counts_splice_exactly(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=counts.default_model())
    r = random.Random(2)
    words = ["alpha", "β", "naïve", "x" * 70, "  ", "\n", "日本語", "a.b,c", "▁", "▁x", "😀"]
    texts = [" ".join(r.choices(words, k=n)) for n in (5, 300, 900, 2500)] + ["z" * 5000, "ab " * 3000, "é" * 3000 + " tail", "<s> </s> " * 400, " " * 3000]
    small = counts.Counter(counts.default_model(), chunk=200, overlap=16)
    assert small.splits and [small.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    rows = [(i, t) for i, t in enumerate([*texts, None, ""])]
    got = {x["doc_id"]: x for x in counts.count_tokens(docs(spark, rows), limit=500).collect()}
    assert all((got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    assert got[3]["over_limit"] and not got[0]["over_limit"] and got[len(texts)]["n_tokens"] == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixture(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, None if i % 41 == 0 else " ".join(["w"] * r.randint(0, 30)), None if i % 7 == 0 else f"s{i % 5}") for i in range(900)]
    rows += [(900, "a\u00a0b\tc", "solo"), (900, "a\u00a0b\tc", "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).repartition(5)
    got = mixing.mix(df).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len([w for w in __import__("re").findall("[^\x20\x09-\x0d]+", t or "")])
    want, taken = plain_targets(sizes), {}
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and g["target"] == pytest.approx(want[g["source"]])
        assert g["taken"] in (0, g["size"], 2 * g["size"])
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = {(g["doc_id"], g["source"]): g["taken"] for g in mixing.mix(df.repartition(2)).collect()}
    assert again == {(g["doc_id"], g["source"]): g["taken"] for g in got}
    sampled = mixing.sample_documents(df)
    assert sampled.columns == df.columns and sampled.count() == sum(g["taken"] // g["size"] for g in got if g["size"])
    assert {(q["size"], q["target"]) for q in sampled.collect()} == {("clash", 1)}
    monkeypatch.setattr(mixing, "EDGE_ROWS", 2)  # the edge is sliced again and again
    monkeypatch.setattr(mixing, "SLICES", 4)
    assert again == {(g["doc_id"], g["source"]): g["taken"] for g in mixing.mix(df).collect()}
    assert mixing.mix(df.filter("false")).count() == 0 and mixing.mix(df.filter("doc_id = 0")).first()["taken"] == 0


def test_rows_of_one_id_in_the_mixture(spark):
    """Rows without an id, of one source and size, in which the mixture ends: each comes as often as some entry of theirs."""
    rows = [(None, f"{k} b c", "one") for k in range(40)] + [(i, "a b c", "two") for i in range(40)] + [(7, "a b c", "two")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = sum(g["taken"] // 3 for g in mixing.mix(df).collect())
    got = mixing.sample_documents(df).collect()
    assert len(got) == taken and {tuple(r) for r in got} <= set(rows)
    times: dict = {}
    for r in got:
        if r["doc_id"] is None:
            times[r["text"]] = times.get(r["text"], 0) + 1
    assert max(times.values()) <= 2


URLS = [
    "http://a.example.net/en/1", "http://EXAMPLE.NET/de/", "https://net/", "http://net", "http://x.org/fr/a?b#c", "http://x.org/fr", "https://example.com/de/x", "ftp://deep.a.b.example.com/de/",
    "http://notexample.net/en/", "no scheme", None, "", "http://a.net?x=/en/", "http://user@h.example.net:80/en/", "file:///x", "http://h.example.net/en/" + "a/" * 300, "x://y://example.net/en/",
]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER)), rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("bound", [50_000, 0])
def test_url_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(urls, "BROADCAST_RULES", bound)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, urls.rule_table(spark)).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS)}
    assert urls.judge(pages.filter("false"), urls.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, urls.rule_table(spark, urls.RULES[:1]).filter("false")).collect()} == {"allow"}


OPEN_RULES = (("org", "/fr", "block"), ("b.org", "/fr/x", "allow"), ("com", "", "block"), ("a.com", "/d", "allow"), ("net", "/", "block"))


def test_rules_that_end_anywhere(spark):
    """A path fits whatever starts with it, and an empty one everything."""
    pages = ["http://x.org/fr", "http://x.org/french", "http://x.org/fr/x", "http://b.org/fr/x1", "http://b.org/f", "http://q.com", "http://q.com/z", "http://a.com/d",
             "http://z.a.com/dd/e", "http://a.com/c", "http://net", "http://net/", None, "http://h.edu/x"]
    rules = OPEN_RULES
    rows = spark.createDataFrame([(i % 9 if i % 4 else None, u) for i, u in enumerate(pages * 3)], "page_id long, url string").repartition(3)
    got: dict = {}
    for r in urls.judge(rows, urls.rule_table(spark, rules)).collect():
        got.setdefault((r["host"], r["path"]), []).append((r["rule"], r["verdict"]))
    assert sum(map(len, got.values())) == 3 * len(pages)
    for u in pages:
        host, path = plain_verdict(u)[:2]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert set(got[(host, path)]) == {max(fits)[1:] if fits else (None, "allow")}


def test_media(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "x" * 40000, "abc", "abc"])]
    got = {r["doc_id"]: r for r in media.describe_media(media.store_media(docs(spark, rows))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        whole = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(whole[-16:]) and r["media_bytes"] > 0
    a, b = got[len(TEXTS) + 1], got[len(TEXTS) + 2]
    assert a.asDict() | {"doc_id": 0} == b.asDict() | {"doc_id": 0}


class Writer(webp.BitWriter):
    """Writes streams with every feature, for the decoder's tests."""

    def head(self, width, height):
        for v, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
            self.write(v, n)

    def symbols(self, kinds):
        """Codes for the five alphabets, each of fixed length 8 (green: 9, of its first 512) or of one symbol."""
        codes = []
        for size, used in kinds:
            lengths = [0] * size
            for s in used:
                lengths[s] = 1 if len(used) == 1 else int(np.ceil(np.log2(len(used))))
            webp.write_code(self, lengths)
            codes.append(webp.canonical(lengths))
        return codes

    def bytes(self):
        return self.value.to_bytes((self.at + 7) // 8, "little")


FULL = list(range(256))


def both(stream):
    """What the plain decoder reads, and lock step beside another stream just as well."""
    plain = webp.decode(stream)
    (other,) = webp.encode_many([np.zeros(30, np.uint8)], 5)
    first, _, third = lockstep.decode_each([stream, webp.chunk_of(other)[0], stream])
    assert (first == plain).all() and (third == plain).all()
    return plain


def plain_image(out, pixels, top):
    """An image of literals, without cache."""
    out.write(0, 1)
    if top:
        out.write(0, 1)
    codes = out.symbols([(280, FULL), (256, FULL), (256, FULL), (256, FULL), (40, [0])])
    for p in pixels:
        for c, s in zip(codes, ((p >> 8) & 255, (p >> 16) & 255, p & 255, p >> 24)):
            out.write(*c[s])


def test_decoder_back_references_and_cache():
    out = Writer()
    out.head(5, 2)
    out.write(0, 1)
    out.write(1, 1)
    out.write(1, 4)  # a cache of two colours
    out.write(0, 1)
    used = [10, 20, 256, 280]  # two literals, a length of 1, a cache index
    codes = out.symbols([(282, used), (256, [1]), (256, [2]), (256, [255]), (40, [1, 3])])
    pixel = lambda g: 255 << 24 | 1 << 16 | g << 8 | 2
    want = []
    for step in ("lit10", "lit20", "left", "cache", "lit10", "up", "up", "left", "left", "left"):
        if step.startswith("lit"):
            out.write(*codes[0][int(step[3:])])
            want.append(pixel(int(step[3:])))
        elif step == "cache":
            out.write(*codes[0][280])
            index = {((webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> 31): p for p in want}
            want.append(index.get(0, 0))
        else:
            out.write(*codes[0][256])  # length symbol 0: one pixel
            out.write(*codes[4][1 if step == "left" else 3] if False else codes[4][1])  # distance symbol 1: short code 2, the pixel before
            want.append(want[-1])
    assert both(out.bytes()).ravel().tolist() == want
    near = webp.near_offsets()
    assert len(near) == 120 and near[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and near[-1] == (8, 7)


def noise(n, seed=1):
    return np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")


def forward_predict(pixels, modes, block):
    """Residuals by the definition: each pixel less its prediction, channel by channel."""
    h, w = pixels.shape
    c = webp.channels(pixels).astype(int)
    out = c.copy()
    for y in range(h):
        for x in range(w):
            if (x, y) == (0, 0):
                guess = np.array([0, 0, 0, 255])
            elif y == 0:
                guess = c[0, x - 1]
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                guess = webp.predict(int(modes[y >> block, x >> block] >> 8) & 15, c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
            out[y, x] = (c[y, x] - guess) & 255
    return out.astype(np.uint8).view("<u4").reshape(h, w)


@pytest.mark.parametrize("mode", range(14))
def test_decoder_predictor(mode):
    pixels = noise(6 * 5, mode).reshape(5, 6)
    modes = np.array([[mode << 8] * 2] * 2, dtype="<u4")
    out = Writer()
    out.head(6, 5)
    for v, n in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
        out.write(v, n)
    plain_image(out, modes.ravel().tolist(), False)
    out.write(0, 1)
    plain_image(out, forward_predict(pixels, modes, 2).ravel().tolist(), True)
    assert (both(out.bytes()) == pixels).all()


def test_decoder_cross_colour_and_subtract_green():
    pixels, factors = noise(24).reshape(4, 6), noise(2, 9).reshape(1, 2)
    c = webp.channels(pixels).astype(int)
    f = webp.channels(factors).view(np.int8).astype(int)[0][np.arange(6) >> 2]
    signed = lambda x: ((x + 128) & 255) - 128
    turned = c.copy()
    turned[..., 2] = (c[..., 2] - ((f[:, 0] * signed(c[..., 1])) >> 5)) & 255
    turned[..., 0] = (c[..., 0] - ((f[:, 1] * signed(c[..., 1])) >> 5) - ((f[:, 2] * signed(c[..., 2])) >> 5)) & 255
    turned[..., 0] = (turned[..., 0] - turned[..., 1]) & 255
    turned[..., 2] = (turned[..., 2] - turned[..., 1]) & 255
    out = Writer()
    out.head(6, 4)
    for v, n in ((1, 1), (webp.CROSS_COLOUR, 2), (0, 3)):
        out.write(v, n)
    plain_image(out, factors.ravel().tolist(), False)
    for v, n in ((1, 1), (webp.SUBTRACT_GREEN, 2), (0, 1)):
        out.write(v, n)
    plain_image(out, turned.astype(np.uint8).view("<u4").ravel().tolist(), True)
    assert (both(out.bytes()) == pixels).all()


@pytest.mark.parametrize("colours", [2, 3, 9, 200])
def test_decoder_palette_with_bundles(colours):
    palette = noise(colours, 3)
    index = np.random.default_rng(4).integers(0, colours, (3, 13))
    steps = webp.channels(palette.reshape(1, -1)).copy()
    steps[0, 1:] -= webp.channels(palette.reshape(1, -1))[0, :-1]
    bundle = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    depth, per = 8 >> bundle, 1 << bundle
    across = -(-13 // per)
    padded = np.zeros((3, across * per), int)
    padded[:, :13] = index
    green = (padded.reshape(3, across, per) << (np.arange(per) * depth)).sum(-1)
    out = Writer()
    out.head(13, 3)
    for v, n in ((1, 1), (webp.PALETTE, 2), (colours - 1, 8)):
        out.write(v, n)
    plain_image(out, steps.view("<u4").ravel().tolist(), False)
    out.write(0, 1)
    plain_image(out, (255 << 24 | green << 8).ravel().tolist(), True)
    assert (both(out.bytes()) == palette[index]).all()
