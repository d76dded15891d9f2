"""Token counts of whole texts, huge ones by overlap resynchronisation.

The library for a SentencePiece BPE model encodes a text of up to ``CHUNK`` characters in one call. A
longer one is encoded in overlapping chunks with offsets. Two neighbours are spliced at a boundary that
both have inside their overlap and that is proven stable: there, a space stands after a visible
character. In such a model no piece holds a space mark after another sign (checked when it is loaded), so
no merge of the whole text can cross the place, and what either side encodes on its own part is what the
whole text gives. Where the overlap has no such boundary (a run without spaces), it is widened, twofold
each time, until alignment succeeds or the chunk reaches the end of the text.

Cases: a null or empty text has no bytes and no tokens; strings of control tokens inside a text are
ordinary text, as the library has it; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import with_results

CHUNK = 1 << 15
OVERLAP = 256
LIMIT = 4096
MARK = "▁"
#: A space between two visible characters, neither of them the space mark itself (bytes e2 96 81).
STABLE = re.compile(rb"(?<=[^\s])(?<!\xe2\x96\x81) (?=[^\s])(?!\xe2\x96\x81)")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts by one model. Chunk and overlap are in UTF-8 bytes, as the library's offsets are."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, max(2, min(overlap, chunk // 2))
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.splits = all(MARK not in p[1:] or not p.strip(MARK) for p in pieces)

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))

    def _starts(self, chunk: bytes, opens_text: bool) -> list[int]:
        """Byte offset of every token in a chunk. One inside a text begins at a stable space.

        The library's prefix would double that space, so it is left to the prefix.
        """
        shift = 0 if opens_text else 1
        found = self.library.encode(chunk[shift:].decode(), return_type="proto", num_threads=1)
        starts = [p.begin + shift for p in found.pieces]
        if starts and shift:
            starts[0] = 0
        return starts

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= self.chunk or not self.splits:
            return self.whole(text)
        raw = text.encode()
        total, at, wanted, overlap = 0, 0, self.chunk, self.overlap
        while True:
            stop = min(len(raw), at + wanted)
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop += 1
            left = self._starts(raw[at:stop], at == 0)
            if stop == len(raw):
                return total + len(left)
            cut = self._splice(raw, at, stop, overlap, left)
            if cut is None:  # alignment failed: more of the text, and twice the overlap to look through
                wanted, overlap = wanted + 2 * overlap, 2 * overlap
                continue
            total, at, wanted, overlap = total + bisect_left(left, cut - at), cut, self.chunk, self.overlap

    def _splice(self, raw: bytes, at: int, stop: int, overlap: int, left: list[int]) -> int | None:
        """A stable place of the overlap at which the left chunk and one begun in the overlap both cut."""
        places = [m.start() for m in STABLE.finditer(raw, max(at + 1, stop - overlap), stop)]
        if len(places) < 2:
            return None
        lefts = {x + at for x in left}
        rights = {x + places[0] for x in self._starts(raw[places[0] : stop], False)}
        common = [p for p in places[1:] if p in lefts and p in rights]
        return common[len(common) // 2] if common else None


@lru_cache(maxsize=2)
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    """One counter for each worker process and model."""
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    model = model or default_model()

    def start():
        library = counter(model)
        return lambda texts: ([library.count(t) for t in texts],)

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = with_results(rows, ("doc_id", "n_bytes"), "n_tokens long", start)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
