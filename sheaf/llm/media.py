"""Media columns: texts as lossless WebP images, read back and described.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are stored as 8-bit samples, three
to a pixel (red, green, blue), 64 pixels to a row. An image holds at most ``STRIPE_ROWS`` rows; longer
payloads are several images one after the other, so the decoder's memory and its longest run of steps stay
bounded whatever a text's length. Features are worked out from the samples that come back out of the
stored bytes, through the whole decoder: prefix codes, back-references, colour cache and inverse transforms.

Cases: a null or empty text is one row of spaces; equal texts have equal media and features; repeated
rows are stored each; ids, null ones too, come back bit by bit; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import with_many, with_results
from sheaf.llm.lockstep import decode_each
from sheaf.llm.webp import channels, chunk_of, encode_many

ROW, SAMPLES = 192, 3
WIDTH = ROW // SAMPLES
STRIPE_ROWS = 32
#: Bytes of payload that are encoded or decoded together, about, and rows that are decoded together.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 1024


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded payload and its unpadded length."""
    raw = text.encode("utf-8", "replace") if text else b""
    return raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The media value of each payload; the images of all are encoded together."""
    samples, step, images = [], ROW * STRIPE_ROWS, []
    for p in payloads:
        whole = np.frombuffer(p, np.uint8)
        stripes = [whole[a : a + step] for a in range(0, len(whole), step)]
        samples += stripes
        images.append(len(stripes))
    files = iter(encode_many(samples, WIDTH))
    return [b"".join([next(files) for _ in range(n)]) for n in images]


def decode_pixels(media: list[bytes]) -> Iterator[np.ndarray]:
    """The (height, width) ARGB arrays of many media values, images one below the other; decoded together."""
    streams, images = [], []
    for m in media:
        before, at = len(streams), 0
        while at < len(m):
            stream, end = chunk_of(m[at:])
            streams.append(stream)
            at += end
        images.append(len(streams) - before)
    pixels = decode_each(streams)
    for n in images:
        yield np.concatenate([next(pixels) for _ in range(n)])


def samples_of(pixels: np.ndarray) -> np.ndarray:
    """The samples of pixels in the order in which they were stored."""
    return channels(pixels)[..., 2::-1].ravel()


def decode_payloads(media: list[bytes]) -> list[np.ndarray]:
    return [samples_of(p) for p in decode_pixels(media)]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, and a 64-bit difference hash of 8 rows of 9 block means."""
    counts = np.bincount(samples, minlength=256)
    n, level = len(samples), np.arange(256)
    mean = int(counts @ level) / n
    spread = (int(counts @ (level * level)) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    bounds = np.arange(72) * n // 72
    sums = np.add.reduceat(samples.astype(np.int64), bounds)
    means = (sums / np.diff(np.append(bounds, n))).reshape(8, 9)
    bits = np.packbits((means[:, 1:] > means[:, :-1]).ravel()).tobytes().hex()
    return f"{mean:.4f} {spread:.4f} {float(-(share * np.log2(share)).sum()):.4f} {bits}"


def slices(weights: list[int]) -> Iterator[slice]:
    """Consecutive slices of at most BATCH_ROWS rows and about BATCH_BYTES."""
    start = size = 0
    for i, w in enumerate(weights):
        if i > start and (i - start >= BATCH_ROWS or size + w > BATCH_BYTES):
            yield slice(start, i)
            start, size = i, 0
        size += w
    if start < len(weights):
        yield slice(start, len(weights))


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (WebP images) of every whole text."""

    def start():
        def work(texts: list[str | None]) -> tuple[list[int], list[bytes]]:
            made = [payload(t) for t in texts]
            media: list[bytes] = []
            for part in slices([len(p) for p, _ in made]):
                media += encode_payloads([p for p, _ in made[part]])
            return [n for _, n in made], media

        return work

    return with_results(docs, ("doc_id",), "n_bytes long, media binary", start)


DESCRIBED = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "height int, width int, pixels binary"
)


def describe_media(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: sizes, digests, features and the whole pixel array of every row.

    ``pixels`` has four bytes for each pixel (blue, green, red, alpha), ``width`` pixels to a row.
    """

    def start():
        def work(media: list[bytes]) -> Iterator[tuple[list[int], tuple]]:
            at = 0
            for part in slices([len(m) for m in media]):
                rows = []
                for m, pixels in zip(media[part], decode_pixels(media[part])):
                    samples = samples_of(pixels)
                    raw = samples.tobytes()
                    rows.append((
                        len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(),
                        feature(samples), *pixels.shape, pixels.astype("<u4", copy=False).tobytes(),
                    ))
                yield list(range(at, at + len(rows))), tuple(zip(*rows))
                at += len(rows)

        return work

    return with_many(stored, ("doc_id", "n_bytes"), DESCRIBED, start, "media")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return describe_media(store_media(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
