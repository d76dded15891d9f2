"""Token-id files with Elias-Fano document boundaries.

One file is a header, then three parts::

    magic  b"SHFEF1\\0\\0"
    u64    documents n, ids m, low bits l, bytes of an id (2 or 4), bytes of the high bits
    low    n+1 values of l bits each, packed from bit 0 on
    high   the unary upper halves: bit (value >> l) + i is set for the i-th boundary
    ids    m ids, each 2 bytes while all are under 65,536, else 4, little-endian

Boundary i (of n+1, the first 0 and the last m) is ``(select1(high, i) - i) << l | low[i]``. Select starts
from a sample of every ``EVERY``-th set bit (40 bits a sample), counts set bits by words from there and
finds the place inside the word by halving it, so offsets need about ``3 + log2(m/n)`` bits each and no
table of 64-bit numbers. Offsets are read that way everywhere, the query's too, ``BLOCK`` at a time.

``write_token_files`` deals documents out by ranges of doc_id, sorts each range and encodes it; a file
ends at about ``FILE_IDS`` ids. Files go through Spark's own writer as rows (part, file, start in the
part, doc ids, payload), so a lost executor's files are written again and none is ever half there; the
payload of each row is one complete file. ``read_token_files`` opens those rows again. Global offsets
are the file's place plus its part's: one number per part is worked out over the small sizes.

Cases: a null or empty text is the end id alone; rows of one doc_id stand in the order of their texts,
rows without an id before all others; many rows of one id are dealt to several files by their texts' first
signs, and exact copies by their places in the table; ids come back bit by bit; an empty table writes no
file; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sheaf.llm.batches import bound_batches, give_back, sliced
from sheaf.llm.bpe import encoder
from sheaf.plans.staging import stage_path

MAGIC = b"SHFEF1\0\0"
HEADER = struct.Struct("<8s5Q")
END_ID = 2
FILE_IDS = 1 << 20
#: Set bits from one sample of the select structure to the next, and boundaries that are read together.
EVERY, BLOCK = 64, 1024
#: Signs of a text by which rows of one id are dealt out.
HEAD = 64
SCHEMA = "part int, file int, first long, docs binary, no_id int, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def place_in_word(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Place of the ``left``-th set bit (from 0) of each 64-bit word, by halving."""
    at = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        upper = left >= ones
        left, at = np.where(upper, left - ones, left), at + np.where(upper, width, 0)
        word = np.where(upper, word >> np.uint64(width), low)
    return at


class EliasFano:
    """A rising sequence of integers in near-minimal space, read by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.words = np.frombuffer(high.tobytes() + b"\0" * (-len(high) % 8), dtype="<u8")
        padded = np.frombuffer(low.tobytes() + b"\0" * 8, np.uint8)
        self.lows = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        # samples: the word of every EVERY-th set bit, and how many set bits that word has before it
        word, skip, seen = [], [], 0
        for at in range(0, len(self.words), BLOCK):
            upto = seen + np.cumsum(np.bitwise_count(self.words[at : at + BLOCK]), dtype=np.int64)
            wanted = np.arange(-(-seen // EVERY) * EVERY, upto[-1], EVERY)
            found = np.searchsorted(upto, wanted, side="right")
            word.append((found + at).astype(np.uint32))
            skip.append((wanted - np.where(found > 0, upto[found - 1], seen)).astype(np.uint8))
            seen = int(upto[-1])
        self.word, self.skip = np.concatenate(word), np.concatenate(skip)

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1])
        l = max(0, (top // n).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(l)) & 1).astype(np.uint8).ravel()
        high = np.zeros((top >> l) + n, np.uint8)
        high[(values >> l) + np.arange(n)] = 1
        return EliasFano(n, l, np.packbits(bits, bitorder="little"), np.packbits(high, bitorder="little"))

    def selects(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th set bits (from 0) of the high part."""
        w = self.word[i // EVERY].astype(np.int64)
        left = i % EVERY + self.skip[i // EVERY]
        while True:
            ones = np.bitwise_count(self.words[w]).astype(np.int64)
            on = left >= ones
            if not on.any():
                return 64 * w + place_in_word(self.words[w], left)
            left, w = np.where(on, left - ones, left), w + on

    def reads(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        at = i * self.low_bits
        low = (self.lows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return (self.selects(i) - i) << self.low_bits | low.astype(np.int64)

    def all(self) -> np.ndarray:
        """All values at once."""
        return self.reads(np.arange(self.n))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.reads(np.array([i]))[0])


def encode_file(documents: list[np.ndarray]) -> bytes:
    """One file of the documents' ids."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    ends = np.array([0, *accumulate(map(len, documents))], dtype=np.int64)
    fano = EliasFano.build(ends)
    kind = "<u2" if not len(ids) or int(ids.max()) < 1 << 16 else "<u4"
    head = HEADER.pack(MAGIC, len(documents), len(ids), fano.low_bits, int(kind[-1]), len(fano.high))
    return head + fano.low.tobytes() + fano.high.tobytes() + ids.astype(kind).tobytes()


class TokenFile:
    """Random access to one file's documents."""

    def __init__(self, raw: bytes):
        magic, self.n, self.m, low_bits, width, high = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        a = HEADER.size
        b = a + ((self.n + 1) * low_bits + 7) // 8
        view = np.frombuffer(raw, np.uint8)
        self.bounds = EliasFano(self.n + 1, low_bits, view[a:b], view[b : b + high])
        self.ids = np.frombuffer(raw, f"<u{width}", self.m, b + high)

    def document(self, i: int) -> np.ndarray:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def blocks(self) -> Iterator[np.ndarray]:
        """The boundaries of BLOCK documents at a time, the last of a block again the first of the next."""
        for at in range(0, self.n, BLOCK):
            yield self.bounds.reads(np.arange(at, min(at + BLOCK, self.n) + 1))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS
) -> None:
    """Write every whole text's ids, each document followed by end_id, in ascending doc_id order."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("head"), F.col("text")]
    sorted_rows = rows.repartitionByRange(order[0], order[1], "place").sortWithinPartitions(*order)
    dealt = sorted_rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        held: list[np.ndarray] = []
        names: list[int] = []
        size = first = file = no_id = part = 0

        def close() -> pa.RecordBatch:
            row = {
                "part": part, "file": file, "first": first, "docs": np.array(names, "<i8").tobytes(), "no_id": no_id, "payload": encode_file(held),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for b in sliced(batches):
            for part, doc, text in zip(*[b.column(c).to_pylist() for c in ("part", "doc_id", "text")]):
                got = np.frombuffer(bpe.encode(text) + end, dtype="<u4")
                no_id += doc is None
                names.append(0 if doc is None else doc)
                held.append(got)
                size += len(got)
                if size >= file_ids:
                    yield close()
                    first, file = first + size, file + 1
                    held, names, size, no_id = [], [], 0, 0
        if held:
            yield close()
        bpe.forget()
        give_back()

    bound_batches(dealt).mapInArrow(run, SCHEMA).write.parquet(path)


def part_offsets(files: DataFrame) -> dict[int, int]:
    """Ids before each part. One number per written part comes to the driver, whatever the documents."""
    sizes = files.groupBy("part").agg(F.max("end").alias("ids")).orderBy("part").collect()
    return dict(zip([r["part"] for r in sizes], accumulate([r["ids"] for r in sizes], initial=0)))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    files = spark.read.schema(SCHEMA).parquet(path)
    low_first = F.hex(F.substring("payload", 17, 8))  # turned round by bytes: F.reverse takes them for characters
    ids = F.conv(F.concat(*[F.substring(low_first, at, 2) for at in range(15, 0, -2)]), 16, 10).cast("long")
    offsets = part_offsets(files.select("part", (F.col("first") + ids).alias("end")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):  # files are large: one at a time
                r = b.slice(row, 1).to_pylist()[0]
                f, at = TokenFile(r["payload"]), 0
                base, names = offsets[r["part"]] + r["first"], np.frombuffer(r["docs"], "<i8")
                for bounds in f.blocks():
                    ends = bounds.tolist()
                    crcs = [zlib.crc32(f.ids[a:z].astype("<u4", copy=False).data) for a, z in zip(ends, ends[1:])]
                    n = len(crcs)
                    doc_id = pa.array(names[at : at + n], mask=np.arange(at, at + n) < r["no_id"])
                    yield pa.RecordBatch.from_arrays(
                        [doc_id, pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at += n

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5(spark, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path)
