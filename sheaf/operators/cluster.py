"""Grouping documents into kinds by structure: signatures, their similarity, leader clustering."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.plans.staging import stage

SIGNATURE = ("shape", "table_columns", "row_scale", "field_count", "types", "narrative_lines")
TYPES = C.VALUE_TYPES
#: Distinct signatures that the driver holds at once.
BATCH = 4096


def signatures(analysed: DataFrame) -> DataFrame:
    """doc_id, signature, table_count of every analysed document (its types as counts in a fixed order)."""
    hundreds = lambda c: F.floor(F.col(c) / 100 + 0.5).cast("int").cast("string")
    numbered = F.transform("tables", lambda t, i: F.struct(t["columns"].alias("c"), (-i).alias("first"), F.size(t["rows"]).alias("n")))
    widest = F.array_max(numbered)
    scale = F.when(widest.isNull(), 0).otherwise(F.floor(F.log2(F.greatest(F.lit(1), widest["n"])) + 0.5))
    held = F.transform("fields", lambda f: f["type"])
    counts = F.transform(F.array(*[F.lit(t) for t in TYPES]), lambda t: F.size(F.filter(held, lambda x: x == t)))
    return analysed.select(
        "doc_id",
        F.struct(
            F.concat(hundreds("width"), F.lit("x"), hundreds("height")).alias("shape"),
            F.coalesce(widest["c"], F.lit(0)).alias("table_columns"),
            scale.cast("int").alias("row_scale"),
            F.size("fields").alias("field_count"),
            counts.alias("types"),
            F.size("narrative").alias("narrative_lines"),
        ).alias("signature"),
        F.size("tables").alias("table_count"),
    )


def similar_count(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(1 - F.abs(a - b) / F.greatest(F.lit(1), a + b))


def type_cosine(a: Column, b: Column) -> Column:
    """Cosine of two count arrays: 1 if both are all zero, 0 if one is."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    na, nb = (total(F.transform(c, lambda x: (x * x).cast("double"))) for c in (a, b))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(dot / F.sqrt(na * nb))


def similarity(a: Column, b: Column) -> Column:
    """Weighted agreement of two signatures, 0 to 1."""
    columns = F.when(a["table_columns"] == b["table_columns"], 1.0).when(
        (a["table_columns"] == 0) | (b["table_columns"] == 0), 0.0
    ).otherwise(C.CLUSTER_PARTIAL)
    scale = F.greatest(F.lit(0.0), 1 - F.abs(a["row_scale"] - b["row_scale"]) / C.CLUSTER_SCALE)
    parts = (
        F.when(a["shape"] == b["shape"], 1.0).otherwise(0.0), columns, scale, similar_count(a["field_count"], b["field_count"]),
        type_cosine(a["types"], b["types"]), similar_count(a["narrative_lines"], b["narrative_lines"]),
    )
    total = F.lit(0.0)
    for weight, part in zip(C.CLUSTER_WEIGHTS, parts):
        total = total + weight * part
    return total / sum(C.CLUSTER_WEIGHTS)


def similarity_of(a: tuple, b: tuple) -> float:
    """The same of two signatures as tuples, on the driver."""
    near = lambda x, y: 1.0 if x == y else 1 - abs(x - y) / max(1, x + y)
    na, nb = (sum(x * x for x in s[4]) for s in (a, b))
    if na and nb:
        cosine = sum(x * y for x, y in zip(a[4], b[4])) / math.sqrt(na * nb)
    else:
        cosine = float(na == nb)
    columns = 1.0 if a[1] == b[1] else C.CLUSTER_PARTIAL if a[1] and b[1] else 0.0
    parts = (float(a[0] == b[0]), columns, max(0.0, 1 - abs(a[2] - b[2]) / C.CLUSTER_SCALE), near(a[3], b[3]), cosine, near(a[5], b[5]))
    return sum(w * p for w, p in zip(C.CLUSTER_WEIGHTS, parts)) / sum(C.CLUSTER_WEIGHTS)


def find_leaders(distinct: list[tuple], threshold: float = C.CLUSTER_THRESHOLD, known: list[tuple] = ()) -> list[int]:
    """Positions, among distinct signatures in first-seen order, of those that found a cluster beside the known ones."""
    leaders, found = list(known), []
    for i, s in enumerate(distinct):
        if all(similarity_of(s, k) < threshold for k in leaders):
            leaders.append(s)
            found.append(i)
    return found


def plain(signature) -> tuple:
    return tuple(signature[k] for k in SIGNATURE)


def with_leaders(signed: DataFrame, leaders: list[tuple[int, object, tuple]], signature: str, since: str) -> DataFrame:
    """A row for each row of ``signed`` and leader (number, since, signature), with ``leader``, ``since`` and ``leading``.

    The leaders are one literal of the plan: nothing is joined.
    """
    kind = f"struct<leader:int,since:{since},leading:{signed.schema[signature].dataType.simpleString()}>"
    told = json.dumps([{"leader": n, "since": s, "leading": dict(zip(SIGNATURE, x))} for n, s, x in leaders])
    every = F.from_json(F.lit(told), f"array<{kind}>")
    return signed.withColumn("__l", F.explode(every)).select(*signed.columns, "__l.*")


def leaders_of(signed: DataFrame, order: str, threshold: float) -> list[tuple[int, object, tuple]]:
    """(number, since, signature) of the clusters' founders.

    Distinct signatures come to the driver ``BATCH`` at a time, in first-seen order; after each batch those
    that a founder covers are filtered where they are, so the driver never holds more than a batch.
    """
    rest, found = signed.groupBy("signature").agg(F.min(order).alias("first")), []
    since = dict(signed.dtypes)[order]
    while True:
        batch = rest.orderBy("first").limit(BATCH).collect()
        shown = [plain(r["signature"]) for r in batch]
        new = find_leaders(shown, threshold, [x for _, _, x in found])
        found += [(len(found) + k, batch[i]["first"], shown[i]) for k, i in enumerate(new)]
        if len(batch) < BATCH:
            return found
        later = rest.filter(F.col("first") > batch[-1]["first"])
        met = with_leaders(later, found, "signature", since).withColumn("score", similarity(F.col("signature"), F.col("leading")))
        rest = stage(met.groupBy("signature").agg(F.min("first").alias("first"), F.max("score").alias("s")).filter(F.col("s") < threshold).drop("s"), "uncovered")


def cluster_documents(signed: DataFrame, order: str = "doc_id", threshold: float = C.CLUSTER_THRESHOLD) -> DataFrame:
    """doc_id, kind (0 for the largest, ties by age), leader's number.

    A document joins the most similar cluster founded before it (the later one on ties) or founds one.
    Only the first document of each distinct signature can found one, so the sequential part runs over
    distinct signatures; every document then joins its signature by equality.
    """
    since = dict(signed.dtypes)[order]
    leaders = leaders_of(signed, order, threshold)
    distinct = signed.groupBy("signature").agg(F.min(order).alias("first"))
    met = with_leaders(distinct, leaders, "signature", since).withColumn("score", similarity(F.col("signature"), F.col("leading")))
    met = met.filter((F.col("score") >= threshold) | (F.col("first") == F.col("since")))
    options = met.groupBy("signature").agg(F.collect_list(F.struct("score", "leader", "since")).alias("options"))
    own = F.filter("options", lambda o: o["since"] <= F.col(order))
    joined = signed.select(order, "signature").join(options, "signature")
    joined = joined.select(order, F.array_max(F.transform(own, lambda o: F.struct(o["score"], o["leader"])))["leader"].alias("leader"))
    sizes = joined.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each leader
    ranked = sorted(sizes, key=lambda r: (-r["n"], r["leader"]))
    numbers = F.from_json(F.lit(json.dumps({str(r["leader"]): k for k, r in enumerate(ranked)})), "map<string,int>")
    return joined.select(order, numbers[F.col("leader").cast("string")].alias("kind"), "leader")
