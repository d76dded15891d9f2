"""What op7 puts out, against plain versions, and both decoders against each other."""

import hashlib
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import lockstep, media, webp


def plain_feature(raw):
    """The feature string by its definition, sample by sample."""
    n = len(raw)
    mean = sum(raw) / n
    spread = (sum(x * x for x in raw) / n - mean * mean) ** 0.5
    shares = [raw.count(x) / n for x in set(raw)]
    bounds = [k * n // 72 for k in range(72)] + [n]
    means = [sum(raw[a:b]) / (b - a) for a, b in zip(bounds, bounds[1:])]
    bits = "".join(str(int(means[9 * r + c + 1] > means[9 * r + c])) for r in range(8) for c in range(8))
    entropy = -sum(s * np.log2(s) for s in shares)
    return [round(mean, 4), round(spread, 4), round(float(entropy), 4), f"{int(bits, 2):016x}"]


def test_rows_equal_plain_versions(spark):
    texts = [(1, "tiny"), (2, None), (3, "é € " * 9000), (None, "no id"), (None, "no id"), ((1 << 62) + 3, "ab" * 5000), (5, "one two three " * 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = media.describe_media(media.store_media(df)).collect()
    stored = {(r["doc_id"], r["n_bytes"]): r["media"] for r in media.store_media(df).collect()}
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in texts:
        whole, n = media.payload(t)
        r, m = by_id[i], stored[(i, n)]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(whole), hashlib.sha256(whole).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(whole[-16:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
        *numbers, bits = r["feature"].split()
        want = plain_feature(whole)
        assert np.allclose([float(x) for x in numbers], want[:3], atol=1e-4) and bits == want[3]
        pixels = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 4)
        assert r["width"] == media.WIDTH and pixels[..., 2::-1].tobytes() == whole and (pixels[..., 3] == 255).all()
        # the plain decoder reads the same samples out of the stored bytes
        found = b""
        while m:
            stream, end = webp.chunk_of(m)
            found += media.samples_of(webp.decode(stream)).tobytes()
            m = m[end:]
        assert found == whole


def parts_of(stream):
    """Names of the format's parts that a stream uses."""
    bits, found = webp.Bits(stream), set()
    width, height = webp.header(bits)
    while bits.read(1):
        kind = bits.read(2)
        found.add(("predictor", "cross-colour", "subtract-green", "palette")[kind])
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            block = bits.read(3) + 2
            webp.read_image(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        elif kind == webp.PALETTE:
            webp.read_image(bits, bits.read(8) + 1, 1, False)
    return found | ({"cache"} if bits.read(1) else set())


def pictures():
    """Samples for which each transform, the cache and back-references pay."""
    r = np.random.default_rng(5)
    steps = np.cumsum(r.integers(-2, 3, (64 * 30, 3)), axis=0)
    noise = r.integers(0, 256, 64 * 30)
    signed = (noise + 128) % 256 - 128
    colours = r.integers(0, 256, (400, 3))
    return {
        "predictor": (steps & 255), "subtract-green": np.stack([noise] * 3, axis=1),
        "cross-colour": np.stack([(signed >> 1) & 255, noise, (-signed >> 2) & 255], axis=1),
        "palette": colours[r.integers(0, 7, 64 * 20)], "cache": colours[(400 * r.random(64 * 30) ** 4).astype(int)],
    }


def test_encoder_uses_what_pays_and_both_decoders_agree():
    made = pictures()
    samples = [p.astype(np.uint8).ravel() for p in made.values()]
    streams = [webp.chunk_of(f)[0] for f in webp.encode_many(samples, 64)]
    for name, raw, stream, pixels in zip(made, samples, streams, lockstep.decode_each(streams)):
        assert name in parts_of(stream)
        assert (pixels == webp.decode(stream)).all() and (media.samples_of(pixels) == raw).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=900), st.integers(1, 9)), min_size=1, max_size=6), st.integers(1, 70))
def test_lock_step_equals_the_plain_decoder(parts, width):
    made = [(raw * times)[: 3 * width * 500] for raw, times in parts]
    samples = [np.frombuffer(raw + b" " * (-len(raw) % (3 * width)), np.uint8) for raw in made]
    files = webp.encode_many(samples, width)
    streams = []
    for f in files:
        stream, end = webp.chunk_of(f)
        assert end == len(f)
        streams.append(stream)
    for raw, stream, pixels in zip(samples, streams, lockstep.decode_each(streams)):
        assert (pixels == webp.decode(stream)).all() and (media.samples_of(pixels) == raw).all()


def test_broken_streams_are_refused():
    (file,) = webp.encode_many([np.frombuffer(b"hello world!" * 48, np.uint8)], 12)
    with pytest.raises(ValueError):
        webp.chunk_of(file[:-3])
    stream, _ = webp.chunk_of(file)
    for cut in (webp.decode, lambda s: next(lockstep.decode_each([s]))):
        with pytest.raises(ValueError):
            cut(stream[: len(stream) // 2])


def test_runs_of_zeros_and_code_lengths_equal_plain_ones():
    r = np.random.default_rng(3)
    for n in range(400):
        out = webp.BitWriter()
        for part in webp.gap_parts(n):
            out.write(*part)
        bits, got = webp.Bits((out.value | 0).to_bytes(out.at // 8 + 8, "little")), 0
        code = webp.PrefixCode(webp.HELPER)
        while bits.at < out.at:
            symbol = code.read(bits)
            got += 1 if symbol == 0 else bits.read(3) + 3 if symbol == 17 else bits.read(7) + 11
        assert got == n
    for size in (2, 3, 40, 280, 2328):
        counts = r.integers(0, 9, size) ** 2
        counts[:2] = 1
        used = np.flatnonzero(counts).tolist()
        heap = sorted((int(counts[s]), [s]) for s in used)
        total = 0
        while len(heap) > 1:
            (a, x), (b, y), *heap = heap
            total += a + b
            heap = sorted([*heap, (a + b, x + y)], key=lambda p: p[0])
        lengths = np.array(webp.code_lengths(counts, 30))
        assert (lengths[used] > 0).all() and int(lengths @ counts) == total and sum(2.0 ** -lengths[used]) == 1


def prose(n, words, seed=7):
    r = np.random.default_rng(seed)
    known = ["".join(map(chr, r.integers(97, 123, size))) for size in r.integers(2, 9, 300)]
    texts = [" ".join(known[k] for k in r.integers(0, len(known), words)) for _ in range(n)]
    return [np.frombuffer(media.payload(t)[0], np.uint8) for t in texts]


def test_work_of_an_image_is_shared_by_its_batch():
    """Python calls don't grow by hundreds for each image: at 2 KB a text they took most of the CPU budget."""

    def calls_of(samples):
        calls = 0

        def seen(frame, event, what):
            nonlocal calls
            calls += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            webp.encode_many(samples, 64)
        finally:
            sys.setprofile(None)
        return calls

    samples = prose(240, 250)
    calls_of(samples[:2])
    assert calls_of(samples) - calls_of(samples[:40]) < 100 * 200


def test_images_are_stored_alike_alone_and_together():
    samples = [s.astype(np.uint8).ravel() for s in pictures().values()] + prose(30, 60) + prose(5, 900)
    samples += [np.zeros(192, np.uint8), np.frombuffer(b"ab" * 96 * 500, np.uint8)]
    files = webp.encode_many(samples, 64)
    assert files == [webp.encode_many([s], 64)[0] for s in samples]
    for raw, file in zip(samples, files):
        assert (media.samples_of(webp.decode(webp.chunk_of(file)[0])) == raw).all()


def test_codes_of_a_batch_equal_those_made_one_by_one():
    r = np.random.default_rng(11)
    every = [np.array([0, 0, 5]), np.array([0, 3]), np.array([1, 1]), np.append(np.zeros(300, int), 4)]
    every += [np.append((1.7 ** np.arange(n)).astype(int), r.integers(0, 3, 40)) for n in (2, 12, 20, 25)]
    every += [np.append(r.integers(0, 9, n) ** 3, 1) for n in (3, 40, 280, 791)]
    row = np.concatenate([np.full(np.count_nonzero(c), k) for k, c in enumerate(every)])
    symbol, counts = np.concatenate([np.flatnonzero(c) for c in every]), np.concatenate([c[c > 0] for c in every])
    lengths = webp.many_lengths(row, counts, len(every))
    value, size = webp.many_codes(row, lengths, len(every))
    parts, bits, parts_of_code = webp.many_code_parts(row, symbol, lengths, np.array([len(c) for c in every]))
    ends = np.cumsum(parts_of_code)
    for k, c in enumerate(every):
        want = webp.code_lengths(c)
        mine = row == k
        assert [want[s] for s in symbol[mine]] == lengths[mine].tolist()
        codes = webp.canonical(want)
        assert [codes[s] for s in symbol[mine].tolist()] == list(zip(value[mine].tolist(), size[mine].tolist()))
        own = slice(ends[k] - parts_of_code[k], ends[k])
        assert webp.joined(list(zip(parts[own].tolist(), bits[own].tolist()))) == webp.joined(webp.code_parts(want))
