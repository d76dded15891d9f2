"""Page geometry: tokens to words, lines and segments; rotation, columns and the need for OCR.

Boxes are (x, y, w, h) in points, the origin at the top left. What is a fold over a page's few hundred
tokens runs in a page kernel (``pages_of`` through ``applyInPandas``, one page to a group); what is an
aggregate or a comparison with the row before is a DataFrame operation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cmp_to_key

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.functions.scalars import trim

TOKENS = (
    "doc_id string, page int, ord int, text string, x double, y double, w double, h double, "
    "size double, font string, bold boolean"
)
PAGES = "doc_id string, page int, width double, height double, rotation int"
BOLD = r"(?i)bold|black|heavy|semibold|-bd|,bold"


@dataclass
class Box:
    x: float
    y: float
    w: float
    h: float

    @property
    def right(self) -> float:
        return self.x + self.w

    @property
    def bottom(self) -> float:
        return self.y + self.h

    @property
    def middle(self) -> float:
        return self.y + self.h / 2


def around(boxes: list[Box]) -> Box:
    x, y = min(b.x for b in boxes), min(b.y for b in boxes)
    return Box(x, y, max(b.right for b in boxes) - x, max(b.bottom for b in boxes) - y)


def vertical_overlap(a: Box, b: Box) -> float:
    """Shared height over the smaller height; 0 for boxes apart."""
    shared = min(a.bottom, b.bottom) - max(a.y, b.y)
    least = min(a.h, b.h)
    return shared / least if shared > 0 and least > 0 else 0.0


@dataclass
class Word:
    text: str
    box: Box
    size: float
    bold: bool = False
    tokens: list[int] = field(default_factory=list)


@dataclass
class Segment:
    text: str
    box: Box
    words: list[Word]

    @property
    def size(self) -> float:
        return max((w.size for w in self.words), default=0.0)


@dataclass
class Line:
    text: str
    box: Box
    words: list[Word]
    segments: list[Segment]


@dataclass
class Page:
    index: int
    width: float
    height: float
    words: list[Word]
    lines: list[Line]


@dataclass
class Token:
    text: str
    box: Box
    size: float
    bold: bool = False


def reading_order(tokens: list[Token]) -> list[int]:
    """Indices by row, then by x. Tokens are of one row when their centres are within half a height."""

    def compare(i: int, j: int) -> float:
        a, b = tokens[i].box, tokens[j].box
        apart = a.middle - b.middle
        return apart if abs(apart) > min(a.h, b.h) * 0.5 else a.x - b.x

    return sorted(range(len(tokens)), key=cmp_to_key(compare))


def words_of(tokens: list[Token]) -> list[Word]:
    """Tokens run together while the gap is smaller than a space would be."""
    groups: list[list[int]] = []
    for i in reading_order(tokens):
        t = tokens[i]
        if groups:
            before = tokens[groups[-1][-1]]
            gap = t.box.x - before.box.right
            spaced = before.text[-1:].isspace() or t.text[:1].isspace()
            near = C.WORD_GAP_MIN <= gap < max(before.size, t.size) * C.WORD_GAP_FACTOR
            if near and not spaced and vertical_overlap(before.box, t.box) > C.WORD_OVERLAP:
                groups[-1].append(i)
                continue
        groups.append([i])
    made = []
    for g in groups:
        own = [tokens[i] for i in g]
        text = " ".join("".join(t.text for t in own).split())
        made.append(Word(text, around([t.box for t in own]), max(t.size for t in own), any(t.bold for t in own), g))
    return made


def _segment(words: list[Word]) -> Segment:
    return Segment(trim(" ".join(w.text for w in words)), around([w.box for w in words]), words)


def line_of(words: list[Word]) -> Line:
    """A row of words, cut into segments where the gap is wide for the text around it."""
    runs: list[list[Word]] = []
    for w in words:
        if runs and w.box.x - runs[-1][-1].box.right <= max(runs[-1][-1].size, w.size) * C.SEGMENT_GAP_FACTOR:
            runs[-1].append(w)
        else:
            runs.append([w])
    whole = _segment(words)
    return Line(whole.text, whole.box, words, [_segment(r) for r in runs])


def lines_of(words: list[Word]) -> list[Line]:
    """Words joined to a row when they overlap any of its words in height; rows from the top down."""
    rows: list[list[Word]] = []
    for w in sorted(words, key=lambda w: w.box.middle):
        if rows and any(vertical_overlap(v.box, w.box) > C.LINE_OVERLAP for v in rows[-1]):
            rows[-1].append(w)
        else:
            rows.append([w])
    lines = [line_of(sorted(r, key=lambda w: w.box.x)) for r in rows]
    return sorted(lines, key=lambda line: (line.box.y, line.box.x))


def page_of(index: int, width: float, height: float, tokens: list[Token]) -> Page:
    words = words_of([t for t in tokens if trim(t.text)])
    return Page(index, width, height, words, lines_of(words))


def columns_of(words: list[Word], page_width: float) -> list[tuple[float, float]]:
    """(x, width) of text columns: what lies between corridors that no word crosses.

    A corridor is wide, well inside the text, and has lines of text (bands of its height) on both sides.
    """
    if len(words) < C.COLUMN_MIN_WORDS:
        return []
    text = around([w.box for w in words])
    step, steps = C.COLUMN_BUCKET, math.ceil(page_width / C.COLUMN_BUCKET)
    if text.h <= 0:
        return []
    left, right, middle = np.array([(w.box.x, w.box.right, w.box.middle) for w in words if w.box.h]).T
    crossed = np.zeros(steps + 1, int)  # +1 where a word enters, -1 after it leaves
    np.add.at(crossed, np.clip(left // step, 0, steps).astype(int), 1)
    np.add.at(crossed, np.clip(right // step + 1, 0, steps).astype(int), -1)
    free = np.concatenate(([False], np.cumsum(crossed)[:steps] == 0, [False]))
    opens, closes = (np.flatnonzero(np.diff(free.astype(int)) == s) * step for s in (1, -1))
    band = ((middle - text.y) // max(1.0, text.h / C.COLUMN_BANDS)).astype(int)
    inner = (closes - opens >= C.COLUMN_GUTTER) & (opens > text.x + C.COLUMN_MARGIN) & (closes < text.right - C.COLUMN_MARGIN)
    bounds = [text.x]
    for a, b in zip(opens[inner].tolist(), closes[inner].tolist()):
        centre = (a + b) / 2
        if len(np.intersect1d(band[right <= centre], band[left >= centre])) >= C.COLUMN_SHARED:
            bounds += [a, b]
    bounds.append(text.right)
    found = [(x, end - x) for x, end in zip(bounds[::2], bounds[1::2]) if end - x > C.COLUMN_WIDTH]
    return found if len(found) > 1 else []


# DataFrame operators --------------------------------------------------------------------------------


def normalise_tokens(tokens: DataFrame) -> DataFrame:
    """Blank tokens dropped; bold read off the font's name where it isn't given."""
    return tokens.filter(F.length(F.regexp_replace("text", r"[\s\x{A0}\x{FEFF}]", "")) > 0).withColumn(
        "bold", F.coalesce(F.col("bold"), F.col("font").rlike(BOLD))
    )


def text_rotation(tokens: DataFrame, angle: str = "angle") -> DataFrame:
    """Quarter turn (90 or 270, else 0) that most of a page's text runs at, weighed by its length.

    Of equal votes the angle seen first wins.
    """
    quadrant = F.pmod(F.floor(F.col(angle) / 90 + 0.5) * 90, F.lit(360)).cast("int")
    votes = tokens.filter(F.length(F.trim("text")) > 0).groupBy("doc_id", "page", quadrant.alias("quadrant"))
    votes = votes.agg(F.sum(F.length(F.trim("text"))).alias("weight"), F.min("ord").alias("seen"))
    best = votes.groupBy("doc_id", "page").agg(F.max_by("quadrant", F.struct("weight", -F.col("seen"))).alias("best"))
    return best.select("doc_id", "page", F.when(F.col("best").isin(90, 270), F.col("best")).otherwise(0).alias("correction"))


def needs_ocr(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, chars, needs_ocr: pages with hardly any text for their area."""
    chars = tokens.groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    few = F.greatest(F.lit(float(C.OCR_MIN_CHARS)), F.col("width") * F.col("height") / C.OCR_AREA)
    both = pages.join(chars, ["doc_id", "page"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    return both.select("doc_id", "page", "chars", (F.col("chars") < few).alias("needs_ocr"))


def document_totals(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_count, char_count, needs_ocr."""
    per_page = needs_ocr(tokens, pages)
    return per_page.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum("chars").alias("char_count"), F.bool_or("needs_ocr").alias("needs_ocr")
    )


def gap_islands(rows: DataFrame, by: list[str], order: list[Column], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: ``starts`` says, from the row before (``lag`` over the same window), where one begins.

    Words from tokens and segments from words are islands of this kind once their order is given.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    flagged = rows.withColumn("__start", F.coalesce(starts.cast("int"), F.lit(1)))
    return flagged.withColumn(name, F.sum("__start").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def previous_right(by: list[str], order: list[Column], x: str = "x", w: str = "w") -> Column:
    return F.lag(F.col(x) + F.col(w)).over(Window.partitionBy(*by).orderBy(*order))
