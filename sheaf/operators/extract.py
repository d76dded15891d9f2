"""Tables, fields and prose of pages; a pile is analysed twice, the first pass informing the second.

The rules look at neighbouring lines of one page and consume what they match, so they run as a kernel
over one document at a time. The pile-wide part, how many documents carry a label, is an aggregate.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.functions.labels import normalise_label as normalise_label_column
from sheaf.functions.scalars import trim, type_of
from sheaf.functions.values import js_trim, with_value
from sheaf.operators.geometry import Box, Line, Page, Segment, Token, around, page_of
from sheaf.plans.staging import stage

CANDIDATES = (
    "doc_id string, ord int, label string, value string, page int, relation string, type string, confidence double, "
    "x double, y double, w double, h double, label_x double, label_y double, label_w double, label_h double"
)
ANALYSED = (
    "doc_id string, fields array<struct<label:string,value:string,page:int,relation:string,type:string,confidence:double,"
    "x:double,y:double,w:double,h:double,label_x:double,label_y:double,label_w:double,label_h:double>>, "
    "tables array<struct<page:int,header:array<string>,rows:array<array<string>>,columns:int,x:double,y:double,w:double,h:double>>, "
    "narrative array<string>, said string, width double, height double, heads array<string>"
)


@dataclass
class Table:
    page: int
    header: list[str] | None
    rows: list[list[Segment]]
    columns: int
    box: Box


@dataclass
class Field:
    label: str
    label_box: Box
    value: str
    value_box: Box
    page: int
    relation: str
    type: str
    confidence: float


def is_text(s: str) -> bool:
    return type_of(s)[0] == "text"


def aligned(a: Line, b: Line) -> bool:
    """Same number of segments, two at least, each pair sharing its left or its right edge."""
    if len(a.segments) != len(b.segments) or len(a.segments) < 2:
        return False
    pairs = zip(a.segments, b.segments)
    return all(
        min(abs(p.box.x - q.box.x), abs(p.box.right - q.box.right)) <= C.TABLE_TOLERANCE for p, q in pairs
    )


def find_tables(page: Page, recurring: set[str] | None = None, min_rows: int = C.TABLE_MIN_ROWS) -> list[Table]:
    lines, found, at = page.lines, [], 0
    while at < len(lines):
        stop = at + 1
        while stop < len(lines) and aligned(lines[at], lines[stop]):
            stop += 1
        table = _table(page.index, lines[at:stop], recurring, min_rows) if stop - at >= min_rows else None
        if table is None:
            at += 1
            continue
        found.append(table)
        at += len(table.rows) + (table.header is not None)
    return found


def _table(page: int, run: list[Line], recurring: set[str] | None, min_rows: int) -> Table | None:
    """The table that a run of aligned lines is, if it is one."""
    head, body = run[0], run
    words_only = all(is_text(s.text) for s in head.segments)
    if words_only and len(run) >= min_rows and any(not is_text(s.text) for line in run[1:] for s in line.segments):
        body = run[1:]
    headed = body is not run
    columns = len(head.segments)
    if not (headed or columns >= C.TABLE_WIDE or len(body) >= C.TABLE_LONG):
        # two columns and few lines: labels recur over the pile, a table's entries don't
        if recurring is None or columns != 2:
            return None
        if sum(line.segments[0].text in recurring for line in body) / len(body) >= C.TABLE_RECURRING:
            return None
    while recurring is not None and len(body) > min_rows and body[-1].segments[0].text in recurring:
        body = body[:-1]
    box = around([line.box for line in body])
    top = head.box.y if headed else body[0].box.y
    box = Box(box.x, top, box.w, body[-1].box.bottom - top)
    header = [s.text for s in head.segments] if headed else None
    return Table(page, header, [line.segments for line in body], columns, box)


def normalise_label(s: str) -> str:
    return trim(re.sub(r"[:：#]+\Z", "", trim(s)))


def looks_like_label(text: str, size: float | None = None, median: float = C.DEFAULT_SIZE) -> bool:
    t = trim(text)
    if not t or (size is not None and size > median * C.HEADING_FACTOR):
        return False
    if t[-1] in ":：":
        return True
    return len(t.split()) <= C.LABEL_MAX_WORDS and is_text(t) and re.search("[A-Za-z]", t) is not None


def is_value_for(label: Segment, value: Segment) -> bool:
    """It types as something, is long, or is set larger than its label."""
    return not is_text(value.text) or len(value.words) > C.VALUE_WORDS or value.size > label.size * C.VALUE_LARGER


def pieces_of(segment: Segment) -> list[tuple[str, Box]]:
    """Space-separated pieces; a word that holds several is shared out by characters."""
    out = []
    for word in segment.words:
        parts = word.text.split()
        length, at = max(1, len(" ".join(parts))), 0
        for part in parts:
            b = word.box
            out.append((part, b if len(parts) == 1 else Box(b.x + b.w * at / length, b.y, b.w * len(part) / length, b.h)))
            at += len(part) + 1
    return out


def split_fused(segment: Segment) -> tuple[Segment, Segment] | None:
    """Label and value of a segment that holds both: the cut whose value types most clearly."""
    pieces = pieces_of(segment)
    best, where = 0.0, 0
    for cut in range(len(pieces) - 1, 0, -1):
        head, tail = (" ".join(t for t, _ in part) for part in (pieces[:cut], pieces[cut:]))
        kind, confidence = type_of(tail)
        if kind == "text" or not is_text(head) or not re.search("[A-Za-z]", head):
            continue
        if confidence + cut * 0.001 > best:
            best, where = confidence + cut * 0.001, cut
    if not where:
        return None
    sides = (pieces[:where], pieces[where:])
    label, value = (Segment(" ".join(t for t, _ in p), around([b for _, b in p]), segment.words) for p in sides)
    return label, value


def field(page: int, label: Segment, value: Segment, relation: str, gap: float) -> Field:
    kind, confidence = type_of(value.text)
    near = max(0.0, 1 - gap / (C.REACH_RIGHT if relation == "right" else C.REACH_BELOW))
    score = min(C.CONFIDENCE_MAX, C.CONFIDENCE_BASE + near * C.CONFIDENCE_NEAR + confidence * C.CONFIDENCE_TYPE)
    return Field(normalise_label(label.text), label.box, value.text, value.box, page, relation, kind, score)


def find_fields(page: Page, tables: list[Table]) -> list[Field]:
    sizes = sorted(w.size for w in page.words)
    median = sizes[len(sizes) // 2] if sizes else C.DEFAULT_SIZE
    label = lambda s: looks_like_label(s.text, s.size, median)
    slack = C.TABLE_SLACK
    inside = lambda line: any(t.box.y - slack <= line.box.middle <= t.box.bottom + slack for t in tables)
    lines = [line for line in page.lines if not inside(line)]
    out: list[Field] = []
    for i, line in enumerate(lines):
        if len(line.segments) == 1:
            fused = split_fused(line.segments[0])
            if fused and label(fused[0]):
                out.append(field(page.index, *fused, "right", 0.0))
            continue
        taken = False
        for own, after in zip(line.segments, [*line.segments[1:], None]):
            if taken:
                taken = False
            elif label(own):
                if after is not None and (not label(after) or is_value_for(own, after)):
                    out.append(field(page.index, own, after, "right", after.box.x - own.box.right))
                    taken = True
                elif below := find_below(lines[i : i + 1 + C.BELOW_LINES], own, label):
                    out.append(field(page.index, own, below[0], "below", below[1]))
    return out


def find_below(lines: list[Line], own: Segment, label) -> tuple[Segment, float] | None:
    """The value under a label of the first line, among the lines after it."""
    for line in lines[1:]:
        gap = line.box.y - lines[0].box.bottom
        if gap > own.box.h * C.BELOW_GAP:
            return None
        for s in line.segments:
            if abs(s.box.x - own.box.x) <= C.BELOW_X and (not label(s) or is_value_for(own, s)):
                return s, gap
    return None


def self_description(page: Page) -> str | None:
    """What a page says it is: the lone line under its largest type, up to the first value in it."""
    largest = max((w.size for w in page.words), default=0.0)
    at = next((i for i, line in enumerate(page.lines) if any(s.size >= largest for s in line.segments)), None)
    if at is None or at + 1 >= len(page.lines):
        return None
    line = page.lines[at + 1]
    text = trim(line.segments[0].text)
    if len(line.segments) != 1 or line.box.y > page.height * C.TITLE_HEIGHT or text[-1:] in (",", ";"):
        return None
    head: list[str] = []
    for word in text.split():
        if not is_text(word):
            break
        head.append(word)
    if not 0 < len(head) <= C.TITLE_WORDS:
        return None
    title = re.sub(r"[.:]+\Z", "", " ".join(head))
    return title if re.search("[A-Za-z]", title) else None


def analyse(pages: list[Page], recurring: set[str] | None = None) -> tuple[list[Field], list[Table], list[str]]:
    """Fields, tables and prose lines of a document."""
    tables = [find_tables(p, recurring) for p in pages]
    fields = [f for p, t in zip(pages, tables) for f in find_fields(p, t)]
    every = [t for ts in tables for t in ts]
    rows = {f.label_box.y for f in fields} | {f.value_box.y for f in fields}
    prose = [
        line.text
        for p in pages
        for line in p.lines
        if line.box.y not in rows
        and not any(t.box.y <= line.box.middle <= t.box.bottom for t in every)
        and len(line.text.split()) > C.NARRATIVE_WORDS
    ]
    return fields, every, prose


# DataFrame operators --------------------------------------------------------------------------------


def document_pages(group: pd.DataFrame) -> list[Page]:
    """The pages of one document's rows (tokens left-joined to pages), in order."""
    out = []
    for index, rows in group.sort_values(["page", "ord"], kind="stable").groupby("page"):
        tokens = [
            Token(r.text, Box(r.x, r.y, r.w, r.h), r.size, bool(r.bold)) for r in rows.itertuples() if isinstance(r.text, str)
        ]
        out.append(page_of(int(index), float(rows["width"].iat[0]), float(rows["height"].iat[0]), tokens))
    return out


def _box(b: Box, prefix: str = "") -> dict[str, float]:
    return {f"{prefix}{k}": float(getattr(b, k)) for k in "xywh"}


def heads_of(pages: list[Page]) -> list[str]:
    """Texts that begin a line of several runs: what can be the first cell of a table's row."""
    return sorted({line.segments[0].text for p in pages for line in p.lines if len(line.segments) > 1})


def analyse_documents(tokens: DataFrame, pages: DataFrame, recurring: DataFrame | None = None) -> DataFrame:
    """One row per document with its fields, tables, prose, self-description, first page's size and line heads.

    recurring: doc_id and label, of each document's heads those that recur as labels over the pile. A group
    holds one document's tokens and labels, so the shuffle key is the document and no group grows with the pile.
    """
    rows = pages.select("doc_id", "page", "width", "height").join(tokens, ["doc_id", "page"], "left")

    def analysed(doc_id: str, group: pd.DataFrame, known: set[str] | None) -> pd.DataFrame:
        found = document_pages(group)
        fields, tables, prose = analyse(found, known)
        shown = [
            {"label": f.label, "value": f.value, "page": f.page, "relation": f.relation, "type": f.type, "confidence": f.confidence}
            | _box(f.value_box) | _box(f.label_box, "label_")
            for f in fields
        ]
        grids = [
            {"page": t.page, "header": t.header, "rows": [[s.text for s in r] for r in t.rows], "columns": t.columns} | _box(t.box)
            for t in tables
        ]
        first = found[0]
        return pd.DataFrame({
            "doc_id": [doc_id], "fields": [shown], "tables": [grids], "narrative": [prose],
            "said": [self_description(first)], "width": [first.width], "height": [first.height], "heads": [heads_of(found)],
        })

    if recurring is None:
        return rows.groupBy("doc_id").applyInPandas(lambda key, group: analysed(key[0], group, None), ANALYSED)

    def again(key: tuple, group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return analysed(key[0], group, set(known["label"])) if len(group) else pd.DataFrame()

    return rows.groupBy("doc_id").cogroup(recurring.select("doc_id", "label").groupBy("doc_id")).applyInPandas(again, ANALYSED)


def label_frequency(candidates: DataFrame) -> DataFrame:
    """label, documents: in how many documents each label occurs."""
    return candidates.groupBy("label").agg(F.countDistinct("doc_id").alias("documents"))


def recurring_labels(candidates: DataFrame, documents: int) -> DataFrame:
    return label_frequency(candidates).filter(F.col("documents") >= min(C.RECURRING_DOCS, max(1, documents))).select("label")


def analyse_pile(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Two passes: labels that recur over the pile tell, in the second, fields from table rows.

    The pile's vocabulary stays a table: each document meets it by equality with the heads of its lines.
    """
    first = stage(analyse_documents(tokens, pages), "pile-first")
    labels = recurring_labels(candidates_of(first), first.count())
    heads = first.select("doc_id", F.explode("heads").alias("label"))
    return analyse_documents(tokens, pages, heads.join(labels, "label"))


def candidates_of(analysed: DataFrame) -> DataFrame:
    """One row per field candidate, numbered in reading order inside its document."""
    return analysed.select("doc_id", F.posexplode("fields").alias("ord", "f")).select("doc_id", "ord", "f.*")


def with_is_label(df: DataFrame, text: str, name: str = "is_label", size: str | None = None, median: str | None = None) -> DataFrame:
    """Adds the label test of a column of segment texts."""
    typed = with_value(df, F.col(text), "__v")
    t = js_trim(F.col(text))
    plain = (F.size(F.split(t, r"\s+")) <= C.LABEL_MAX_WORDS) & (F.col("__v.type") == "text") & t.rlike("[A-Za-z]")
    heading = F.lit(False) if size is None else F.col(size) > F.col(median) * C.HEADING_FACTOR
    return typed.withColumn(name, F.when((t == "") | heading, False).when(t.rlike(r"[:：]\z"), True).otherwise(plain)).drop("__v")


def candidate_confidence(gap: Column, relation: Column, type_confidence: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1 - gap / F.when(relation == "right", C.REACH_RIGHT).otherwise(C.REACH_BELOW))
    return F.least(F.lit(C.CONFIDENCE_MAX), C.CONFIDENCE_BASE + near * C.CONFIDENCE_NEAR + type_confidence * C.CONFIDENCE_TYPE)


def split_fused_texts(df: DataFrame, text: str) -> DataFrame:
    """text, label, value of each distinct text that fuses a label and its value.

    Every cut becomes a row, both of its sides are typed, and the cut whose value types most clearly wins.
    """
    whole = df.select(F.col(text).alias("text")).distinct()
    pieces = F.filter(F.split(js_trim(F.col("text")), r"\s+"), lambda p: p != "")
    cut = whole.withColumn("p", pieces).filter(F.size("p") >= 2).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    sides = cut.select(
        "text", "cut", F.array_join(F.slice("p", F.lit(1), F.col("cut")), " ").alias("label"),
        F.array_join(F.slice("p", F.col("cut") + 1, F.size("p") - F.col("cut")), " ").alias("value"),
    )
    typed = with_value(sides, F.col("value"), "__tail").filter("__tail.type <> 'text'")
    typed = with_value(typed, F.col("label"), "__head").filter(F.col("label").rlike("[A-Za-z]") & (F.col("__head.type") == "text"))
    best = typed.groupBy("text").agg(F.max_by(F.struct("label", "value"), F.col("__tail.confidence") + F.col("cut") * 0.001).alias("b"))
    return best.select("text", normalise_label_column(F.col("b.label")).alias("label"), F.col("b.value").alias("value"))


def median_size(words: DataFrame) -> DataFrame:
    """doc_id, page, median: the upper median of the words' sizes, 10 on a page without any."""
    sizes = F.sort_array(F.collect_list("size"))
    middle = F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int"))
    return words.groupBy("doc_id", "page").agg(F.coalesce(middle, F.lit(C.DEFAULT_SIZE)).alias("median"))


def dump(analysed: DataFrame) -> list[dict]:
    """Documents as plain dictionaries, for looking at a few by eye."""
    return [json.loads(r) for r in analysed.toJSON().collect()]
