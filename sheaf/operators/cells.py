"""Cells: the first candidate of each field, empty cells, canonical values, and the committed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sheaf import constants as C
from sheaf.functions.values import date_proofs, resolve_date_style, with_value
from sheaf.plans.staging import stage


#: Confidence of a date whose order nothing settles, and of one that its column's style settles.
AMBIGUOUS, SETTLED = C.DATE_CONFIDENCE["open"], C.DATE_CONFIDENCE["settled"]


def first_candidates(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """The first candidate of each (document, field). labels: kind, label, field.

    Candidates of one ``ord`` stand in the order of a column ``place``, where they have one.
    """
    met = candidates.join(labels, ["kind", "label"])
    order = Window.partitionBy("doc_id", "field").orderBy(F.asc_nulls_last("ord"), *[c for c in ("place",) if c in candidates.columns])
    return met.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def empty_cells(documents: DataFrame, fields: DataFrame, filled: DataFrame) -> DataFrame:
    """(doc_id, field) pairs that a kind's schema expects and the document doesn't supply.

    documents: kind, doc_id; fields: kind, field. Every document meets its own kind's fields only.
    """
    expected = documents.select("kind", "doc_id").join(fields.select("kind", "field"), "kind")
    return expected.join(filled.select("doc_id", "field"), ["doc_id", "field"], "left_anti")


def resolve_cells(candidates: DataFrame, labels: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """All cells of a pile: those found, and the empty ones with status ``empty``."""
    found = first_candidates(candidates, labels).select(
        "kind", "doc_id", "field", F.col("value").alias("raw"), F.col("label").alias("source_label"), "confidence", "page",
        F.struct("x", "y", "w", "h").alias("box"),
        F.struct(F.col("label_x").alias("x"), F.col("label_y").alias("y"), F.col("label_w").alias("w"), F.col("label_h").alias("h")).alias("label_box"),
        F.lit("unreviewed").alias("status"),
    )
    missing = empty_cells(documents, fields, found).select("kind", "doc_id", "field", F.lit(0.0).alias("confidence"), F.lit("empty").alias("status"))
    return found.unionByName(missing, allowMissingColumns=True)


def date_styles(cells: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """``by``, style, evidence, dmy, mdy: the date convention that each group's values prove."""
    dmy, mdy = date_proofs(F.col(raw))
    counted = cells.filter(F.col(raw).isNotNull()).groupBy(*by).agg(F.count_if(dmy).alias("dmy"), F.count_if(mdy).alias("mdy"))
    style = resolve_date_style(F.col("dmy"), F.col("mdy"))
    evidence = F.when(style == "dmy", F.col("dmy")).when(style == "mdy", F.col("mdy")).otherwise(0)
    return counted.select(*by, style.alias("style"), evidence.alias("evidence"), "dmy", "mdy")


def first_seen(cells: DataFrame, order: list[str]) -> Column:
    """The least of the columns ``order``, as an aggregate.

    A single number stays one: a struct won't go into the rows of a hash table, and each task would sort its cells.
    """
    one = len(order) == 1 and isinstance(cells.schema[order[0]].dataType, NumericType)
    return F.min(order[0] if one else F.struct(*order))


def majority_types(cells: DataFrame, by: list[str], order: list[str], raw: str = "raw") -> DataFrame:
    """``by``, type: the most frequent type of each group's values; on ties the one that comes first."""
    kinds = with_value(cells.filter(F.col(raw).isNotNull()), F.col(raw), "__v")
    counts = kinds.groupBy(*by, F.col("__v.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), first_seen(cells, order).alias("seen"))
    return counts.groupBy(*by).agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), "seen")).alias("type"))


def canonical(cells: DataFrame, order: list[str], by: tuple[str, ...] = ("field",)) -> DataFrame:
    """Adds ``value`` (struct of ``type_value``), ``style``, ``column_type`` and the blended confidence.

    Values are grouped by field and the label they were found under, for one source writes dates one
    way: a single provable date settles its group's ambiguous ones. Corrected texts count as the raw ones.
    """
    given = F.coalesce("corrected_to", "raw") if "corrected_to" in cells.columns else F.col("raw")
    keyed = cells.withColumns({"__given": given, "__label": F.coalesce("source_label", F.lit(""))})
    # typed once: the facts of the groups and the cells themselves are read from the same table
    typed = stage(with_value(keyed, F.col("__given"), "__v", proof="__proof"), "typed")
    groups = [*by, "__label"]
    counts = typed.filter(F.col("__given").isNotNull()).groupBy(*groups, F.col("__v.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), first_seen(cells, order).alias("seen"),
        F.count_if(F.col("__proof") == "dmy").alias("dmy"), F.count_if(F.col("__proof") == "mdy").alias("mdy"),
    )
    facts = counts.groupBy(*groups).agg(
        F.min_by("type", F.struct((-F.col("n")).alias("n"), "seen")).alias("column_type"), F.sum("dmy").alias("dmy"), F.sum("mdy").alias("mdy")
    )
    proved = F.when(F.col("column_type") == "date", resolve_date_style(F.col("dmy"), F.col("mdy"))).otherwise("unknown")
    facts = stage(facts.select(*groups, "column_type", proved.alias("style")), "facts")  # its size is known when the join is planned
    joined = typed.join(facts, groups, "left").withColumn("style", F.coalesce("style", F.lit("unknown")))
    # only an ambiguous date depends on the style: it was read day-first, so month-first swaps the two
    v = F.col("__v")
    settled = (v["type"] == "date") & (v["confidence"] == AMBIGUOUS) & (F.col("style") != "unknown")
    swapped = F.regexp_replace(v["text"], r"\A(\d+)-(\d{2})-(\d{2})\z", "$1-$3-$2")
    reread = v.withField("text", F.when(F.col("style") == "mdy", swapped).otherwise(v["text"])).withField("confidence", F.lit(SETTLED))
    out = joined.withColumn("value", F.when(F.col("__given").isNotNull(), F.when(settled, reread).otherwise(v)))
    blended = F.greatest(F.lit(0.0), F.col("confidence") * C.BLEND_OLD + F.col("value.confidence") * C.BLEND_TYPE)
    return out.withColumn("confidence", F.coalesce(blended, "confidence")).drop("__given", "__label", "__v", "__proof")


def unresolved_dates(cells: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """Groups of canonical cells in which some date stays ambiguous: what a log should warn of."""
    low = (F.col("value.type") == "date") & (F.col("value.confidence") < 0.5) & (F.col("style") == "unknown")
    return cells.groupBy(*by).agg(F.count_if(low).alias("ambiguous")).filter("ambiguous > 0")


def cast_value(value: Column, kind: str) -> Column:
    """A canonical value as its column's type; what won't cast becomes null."""
    text = value["text"]
    if kind == "date":
        return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))
    if kind in ("money", "number"):
        return F.coalesce(value["number"], F.regexp_replace(text, ",", "").try_cast("double")).try_cast(C.COLUMN_TYPES[kind])
    if kind == "boolean":
        return F.coalesce(value["boolean"], text.try_cast("boolean"))
    return text.try_cast(C.COLUMN_TYPES.get(kind, "string"))


def needs_review(status: str = "status", confidence: str = "confidence") -> Column:
    return (F.col(status) == "unreviewed") & (F.col(confidence) < C.REVIEW_BELOW)


def commit_table(cells: DataFrame, fields: list[tuple[str, str, str]], document: str = "document") -> DataFrame:
    """One row per document: typed columns by the fields' order, ``_needs_review``, ``_uncast``.

    fields: (field, column, type). Values are cast first, so one aggregate by document makes the columns
    and the counts; of several values of one field the largest stays. ``_uncast`` counts values that were
    there and became null in their column's type.
    """
    cast = {name: cast_value(F.col("value"), kind) for _, name, kind in fields}
    own = {name: F.col("field") == field for field, name, _ in fields}
    columns = [F.max(F.when(own[name], c)).alias(name) for name, c in cast.items()]
    lost = [F.count_if(own[name] & F.col("value.text").isNotNull() & c.isNull()) for name, c in cast.items()]
    uncast = sum(lost, F.lit(0)).cast("int").alias("_uncast")
    return cells.groupBy(document).agg(*columns, uncast, F.count_if(needs_review()).cast("int").alias("_needs_review"))


def accuracy(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """field, checked, correct, missing: extracted texts against the recorded ones (document, field, text)."""
    from sheaf.functions.values import accuracy_text

    met = truth.join(cells.select("document", "field", F.col("value.text").alias("got")), ["document", "field"], "left")
    same = accuracy_text(F.col("got")) == accuracy_text(F.col("text"))
    return met.groupBy("field").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(same).alias("correct"), F.count_if(F.col("got").isNull()).alias("missing")
    )
