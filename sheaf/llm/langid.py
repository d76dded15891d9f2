"""Language identification by compression.

For each language a zstandard raw-content dictionary is made from a bounded sample of its labelled
texts. A text is compressed whole with every dictionary, both reduced to lower-cased letters and single
spaces between their runs, so that layout and signs, which no language owns, weigh nothing. Texts are
compressed in windows of about ``WINDOW`` bytes, each against the dictionary afresh, and the bytes of all
windows are added up: a long text must not become its own dictionary, or all languages would come out
level. The language with the fewest bytes wins, ties going to the language with more labelled rows. When
the runner-up needs hardly more bytes, the margin is narrow and the text is marked ``rejected`` (the
prediction is still given).

Fitting reads ``text`` and non-null ``lang`` outside the held-out quarter, of the ``MAX_LANGUAGES`` most
frequent languages: about ``FIT_DOCS`` texts of each, taken by the hash of their id, from each text a run
of at most ``MAX_FIT_CHARS`` characters at a place that the hash gives as well. The dictionary takes them
in the order of the hash until it has ``DICT_BYTES``. lang, source and doc_id never enter a prediction.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; if no language could
be learned every text is; repeated rows are learned from once and judged each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import with_results
from sheaf.llm.toxicity import held_out

FIT_DOCS = 200
MAX_FIT_CHARS = 16_384
DICT_BYTES = 1 << 17
MAX_LANGUAGES = 256
#: Bytes that are compressed at once.
WINDOW = 1 << 11
LEVEL = 5
#: A relative margin below this is narrow: the two best sizes are all but equal.
NARROW = 0.002
SHARPNESS = 40.0
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """A text's runs of letters, lower-cased, with single spaces between them."""
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def windows(raw: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The whole of ``raw`` in runs of at most ``size`` bytes, cut at the last space that allows it."""
    at = 0
    while len(raw) - at > size:
        end = raw.rfind(b" ", at + size // 2, at + size)
        end = at + size if end < 0 else end
        yield raw[at:end]
        at = end
    yield raw[at:]


def fit_dictionaries(docs: DataFrame, fit_docs: int = FIT_DOCS) -> list[tuple[str, bytes]]:
    """(language, dictionary content), languages with more learnable rows first."""
    learn = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    most = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return []
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(scale, math.ceil(scale * fit_docs / n)))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale))
    spare = F.greatest(F.length("text") - MAX_FIT_CHARS, F.lit(0))
    run = F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(6)), spare + 1) + 1).cast("int"), F.lit(MAX_FIT_CHARS))
    got = learn.filter((drawn < share[F.col("lang")]) & (F.length("text") > 0)).select("lang", drawn.alias("drawn"), run.alias("text")).distinct()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in got.collect():
        texts.setdefault(r["lang"], []).append((r["drawn"], r["text"]))
    made = []
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        content = b" ".join(letters(t) for _, t in sorted(texts.get(lang, [])))[:DICT_BYTES]
        if len(content) >= 8:
            made.append((lang, content))
    return made


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL):
        self.sides = []
        for lang, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.sides.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1, growing with the margin) and relative margin to the runner-up."""
        if not text or not self.sides or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = letters(text)
        parts = list(windows(raw))
        sizes = [sum([len(c.compress(p)) for p in parts]) for _, c in self.sides]
        best = min(sizes)
        at = sizes.index(best)
        rest = sizes[:at] + sizes[at + 1 :]
        margin = (min(rest) - best) / min(rest) if rest else 1.0
        score = 1 / sum(math.exp(-SHARPNESS * (s - best) / best) for s in sizes)
        return self.sides[at][0], score, margin


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score, margin and rejected of every row."""

    def start():
        classifier = Classifier(dictionaries)
        return lambda texts: list(zip(*[classifier.predict(t) for t in texts])) or [(), (), ()]

    rejected = (F.col("lang_pred") == "und") | (F.col("margin") < NARROW)
    found = with_results(docs, keep, "lang_pred string, score double, margin double", start)
    return found.withColumn("rejected", rejected)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit_dictionaries(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
