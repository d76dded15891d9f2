"""Review: queue and summary, corrections as an append-only log, and rules learned from one edit.

Cells are written once. Confirming, correcting and generalising append events (cell_id, seq, status,
corrected_to, confidence); ``current_cells`` lays each cell's last event over its base row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.functions.scalars import parse_date as parse_date_text
from sheaf.functions.scalars import trim
from sheaf.functions.values import js_trim, parse_date, pinned, with_value
from sheaf.operators.cells import needs_review

EVENTS = "cell_id string, seq long, status string, corrected_to string, confidence double"


@dataclass(frozen=True)
class Signature:
    """What kind of edit a correction was: strip_prefix, strip_suffix, strip_both, date_convention, manual."""

    kind: str
    first: str = ""
    second: str = ""

    @property
    def key(self) -> str:
        if self.kind == "strip_both":
            return f"strip_both:{self.first}|{self.second}"
        if self.kind == "date_convention":
            return f"date:{self.first}->{self.second}"
        return f"{self.kind}:{self.first}" if self.kind != "manual" else "manual"

    def describe(self) -> str:
        said = lambda s: json.dumps(s, ensure_ascii=False)
        match self.kind:
            case "strip_prefix":
                return f"remove the leading {said(self.first)}"
            case "strip_suffix":
                return f"remove the trailing {said(self.first)}"
            case "strip_both":
                return f"remove {said(self.first)} and {said(self.second)}"
            case "date_convention":
                return f"read these dates as {'month first' if self.second == 'mdy' else 'day first'}"
        return "a one-off correction"


MANUAL = Signature("manual")


def classify(before: str, after: str) -> Signature:
    """The most specific edit that turns one text into the other: date order, then ends taken off."""
    b, a = trim(before), trim(after)
    if not a or not b or a == b:
        return MANUAL
    readings = {style: (parse_date_text(b, style) or (None,))[0] for style in ("dmy", "mdy")}
    if readings["dmy"] != readings["mdy"]:
        if a == readings["mdy"]:
            return Signature("date_convention", "dmy", "mdy")
        if a == readings["dmy"]:
            return Signature("date_convention", "mdy", "dmy")
    prefix, found, suffix = b.partition(a)
    if found:
        shape = (min(len(prefix), 2), min(len(suffix), 2))  # one stripped character is too weak a rule
        if shape == (2, 2):
            return Signature("strip_both", prefix, suffix)
        if shape == (2, 0):
            return Signature("strip_prefix", prefix)
        if shape == (0, 2):
            return Signature("strip_suffix", suffix)
    return MANUAL


def apply_signature(signature: Signature, raw: Column) -> Column:
    """The value after the edit, or null where the rule doesn't apply."""
    v = js_trim(raw)
    cut = lambda start, stop: js_trim(v.substr(F.lit(start + 1), F.greatest(F.lit(0), F.length(v) - start - stop)))
    a, b = signature.first, signature.second
    match signature.kind:
        case "strip_prefix":
            return F.when(v.startswith(a), cut(len(a), 0))
        case "strip_suffix":
            return F.when(v.endswith(a), cut(0, len(a)))
        case "strip_both":
            return F.when(v.startswith(a) & v.endswith(b), cut(len(a), len(b)))
        case "date_convention":
            return F.when(parse_date(raw)["ambiguous"], parse_date(raw, b)["iso"])
    return F.lit(None).cast("string")


def preview(signature: Signature, cells: DataFrame, exclude: str | None = None, id: str = "cell_id") -> DataFrame:
    """cell_id, document, before, after of the cells a rule would change; nothing is written.

    Left out: the edited cell, nulls, what stays as it is, and what would be emptied or lose its type.
    """
    after = apply_signature(signature, F.col("raw"))
    changed = pinned(cells.filter(F.col("raw") != ""), "after", after)
    if exclude is not None:
        changed = changed.filter(F.col(id) != exclude)
    both = with_value(with_value(changed, F.col("raw"), "__was"), F.col("after"), "__is")
    spoilt = (F.col("__was.type") != "text") & (F.col("__is.type") == "text")
    kept = both.filter(F.col("after").isNotNull() & (F.col("after") != js_trim(F.col("raw"))) & (F.col("after") != "") & ~spoilt)
    return kept.select(id, "document", F.col("raw").alias("before"), "after")


def siblings(cells: DataFrame, field: str) -> DataFrame:
    return cells.filter((F.col("field") == field) & (F.col("status") == "unreviewed"))


def current_cells(base: DataFrame, events: DataFrame) -> DataFrame:
    """Base cells with the last event of each laid over."""
    last = events.groupBy("cell_id").agg(F.max_by(F.struct("status", "corrected_to", "confidence"), "seq").alias("e"))
    joined = base.join(last, "cell_id", "left")
    return joined.select(
        *[c for c in base.columns if c not in ("status", "confidence", "corrected_to")],
        F.coalesce("e.status", "status").alias("status"),
        F.coalesce("e.confidence", base["confidence"]).alias("confidence"),
        F.col("e.corrected_to").alias("corrected_to"),
    )


def confirm(cell_id: Column | str, seq: Column) -> list[Column]:
    c = F.col(cell_id) if isinstance(cell_id, str) else cell_id
    return [c.alias("cell_id"), seq.cast("long").alias("seq"), F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("corrected_to"), F.lit(C.CONFIRMED).alias("confidence")]


def correct(cell_id: str, after: Column, seq: Column) -> list[Column]:
    return [F.col(cell_id).alias("cell_id"), seq.cast("long").alias("seq"), F.lit("corrected").alias("status"), js_trim(after).alias("corrected_to"), F.lit(C.CONFIRMED).alias("confidence")]


def apply_batch(current: DataFrame, approved: DataFrame, seq: int) -> DataFrame:
    """Events for an approved list (cell_id, after): only cells that nobody has reviewed meanwhile."""
    guarded = approved.join(current.filter("status = 'unreviewed'").select("cell_id"), "cell_id", "left_semi")
    return guarded.select(
        "cell_id", F.lit(seq).cast("long").alias("seq"), F.lit("corrected").alias("status"), F.col("after").alias("corrected_to"), F.lit(C.GENERALISED).alias("confidence")
    )


def queue(cells: DataFrame, fields: DataFrame, everything: bool = False) -> DataFrame:
    """Cells to look at, least certain first: of included fields, unreviewed and below the bar.

    fields: field, position, included. They are a pile's vocabulary and go to every task: dealt out by field,
    all cells of one would come to one task.
    """
    joined = cells.join(F.broadcast(fields.filter("included").select("field", "position")), "field")
    return (joined if everything else joined.filter(needs_review())).orderBy("confidence", "document", "position")


def summary(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total, needs_review, confirmed, corrected, empty of the cells, by the given columns."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(needs_review()).alias("needs_review"), is_("confirmed"), is_("corrected"), is_("empty"))


def summary_of_fields(cells: DataFrame, fields: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``summary`` over the cells of included fields alone."""
    return summary(cells.join(F.broadcast(fields.filter("included").select("field")), "field", "left_semi"), by)


def patch_fields(fields: DataFrame, events: DataFrame) -> DataFrame:
    """fields with the last non-null name, type and included of each field's events (field, seq, …)."""
    names = ("name", "type", "included")
    last = events.groupBy("field").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(f"new_{n}") for n in names])
    joined = fields.join(last, "field", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in names else F.col(c) for c in fields.columns])
