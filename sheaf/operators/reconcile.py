"""Reconciling labels into fields: statistics, co-occurrence, pair scores, constrained merging, naming.

Rows carry ``kind`` throughout, so all kinds are reconciled together. The number of labels is a pile's
vocabulary; documents are only ever aggregated. The merge itself depends on order and on a veto between
whole groups, so it is a small fold over one kind's labels.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.functions.labels import label_tokens, ordinal, token_similarity
from sheaf.functions.values import shape_of


#: Candidates that one task sorts, about.
TASK_ROWS = 250_000


def by_document(candidates: DataFrame) -> DataFrame:
    """Candidates dealt out by document, to more tasks the more there are.

    The tasks of the session's own setting grow with the input, and every sort by document, label or shape holds
    a whole task's rows.
    """
    return candidates.repartition(max(1, -(-candidates.count() // TASK_ROWS)), "doc_id")


def ranked(candidates: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0): a candidate's place among its document's candidates of the same type, by y, then x."""
    candidates = by_document(candidates)
    w = Window.partitionBy("kind", "doc_id", "type").orderBy("y", "x", "ord")
    return candidates.withColumn("rank", F.row_number().over(w) - 1)


def label_stats(candidates: DataFrame) -> DataFrame:
    """One row per (kind, label). Needs kind, doc_id, ord, label, value, type, x, y, page_width, page_height.

    ``occurrences`` counts candidates, not documents; type is that of the first; shapes and samples keep
    their order. Order is by document, then types by their first candidate in reading order, then rank.
    Samples and shapes are bounded: the first ``SAMPLES`` and ``SHAPES`` of each label by that order, for
    free text has a shape of its own in every value.
    """
    r = ranked(candidates)
    opening = Window.partitionBy("kind", "doc_id", "type").orderBy("y", "x", "ord")
    keyed = r.withColumn("seen", F.struct("doc_id", F.first(F.struct("y", "x", "ord")).over(opening).alias("opening"), "rank"))
    keyed = keyed.withColumn("shape", shape_of(F.col("value")))
    px, py = F.col("x") / F.greatest(F.lit(1.0), F.col("page_width")), F.col("y") / F.greatest(F.lit(1.0), F.col("page_height"))
    base = keyed.groupBy("kind", "label").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by("type", "seen").alias("type"),
        F.avg(px).alias("px"),
        F.avg(py).alias("py"),
        F.avg("rank").alias("rank"),
        F.min("seen").alias("first"),
    )
    shapes = keyed.groupBy("kind", "label", "shape").agg(F.min("seen").alias("seen"))
    order = Window.partitionBy("kind", "label").orderBy("seen")
    shapes = shapes.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= C.SHAPES)
    shapes = shapes.groupBy("kind", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "shape"))), lambda s: s["shape"]).alias("shapes"))
    number = Window.partitionBy("kind", "label").orderBy("seen")
    samples = keyed.withColumn("k", F.row_number().over(number)).filter(F.col("k") <= C.SAMPLES)
    samples = samples.groupBy("kind", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("samples"))
    both = base.join(shapes, ["kind", "label"]).join(samples, ["kind", "label"])
    # labels are numbered in first-seen order; a kind's labels are its vocabulary, so one window each is small
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("kind").orderBy("first", "label"))).drop("first")


def cooccurrence(candidates: DataFrame) -> DataFrame:
    """kind, a, b (a < b): labels that some document holds together."""
    labels = candidates.select("kind", "doc_id", "label").distinct()
    a, b = (labels.withColumnRenamed("label", x) for x in "ab")
    return a.join(b, ["kind", "doc_id"]).filter("a < b").select("kind", "a", "b").distinct()


def told(reason: str, **values: Column) -> Column:
    """A reason's sentence with its places filled."""
    parts = re.split(r"\{(\w+)\}", C.REASONS[reason])
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def merge_score(a: str, b: str, together: Column) -> Column:
    """Struct(score, blocked, reasons) of two labels' statistics (structs named a and b)."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = x("type") == y("type")
    kinds = F.array_sort(F.array(x("type"), y("type")))
    compatible = same | (kinds == F.array(F.lit("identifier"), F.lit("text"))) | (kinds == F.array(F.lit("money"), F.lit("number")))
    name = token_similarity(label_tokens(x("label")), label_tokens(y("label")))
    named = name > C.NAME_GATE
    by_shape = x("type").isin("identifier", "text")
    shaped = by_shape & F.arrays_overlap(x("shapes"), y("shapes"))
    alike = ~by_shape & same
    gap = F.abs(x("rank") - y("rank"))
    close, near = gap < C.RANK_CLOSE, (gap >= C.RANK_CLOSE) & (gap < C.RANK_NEAR)
    place = F.greatest(F.lit(0.0), 1 - (F.abs(x("px") - y("px")) * C.POSITION_X + F.abs(x("py") - y("py"))) / C.POSITION_SPAN)
    placed = place > C.POSITION_GATE
    one = lambda c: F.when(c, 1).otherwise(0)
    signals = one(named) + one(shaped | alike) + one(close | near) + one(placed)
    score = (
        F.when(named, name * C.NAME_WEIGHT).otherwise(0.0)
        + F.when(shaped, C.SHAPE_WEIGHT).when(alike, C.KIND_WEIGHT).otherwise(0.0)
        + F.when(same, C.SAME_TYPE_WEIGHT).otherwise(0.0)
        + F.when(close, C.RANK_CLOSE_WEIGHT).when(near, C.RANK_NEAR_WEIGHT).otherwise(0.0)
        + F.when(placed, place * C.POSITION_WEIGHT).otherwise(0.0)
    )
    amounts = F.when(x("type") == "money", "amounts").otherwise(F.concat(x("type"), F.lit(" values")))
    shape, turn = F.element_at(x("shapes"), 1), ordinal(F.floor(x("rank") + 0.5) + 1)
    reasons = F.array_compact(F.array(
        F.when(named & (name > C.NAME_CLEAR), told("same_name")).when(named, told("shared_word")),
        F.when(shaped, told("shape", shape=shape)).when(alike, told("type", type=amounts)),
        F.when(close, told("rank", ordinal=turn, type=x("type"))).when(near, told("near_rank", type=x("type"))),
        F.when(placed, told("place")),
    ))
    made = lambda s, blocked, why: F.struct(s.alias("score"), F.lit(blocked).alias("blocked"), why.alias("reasons"))
    return (
        F.when(together, made(F.lit(0.0), True, F.array(told("apart", a=x("label"), b=y("label")))))
        .when(~compatible, made(F.lit(0.0), False, F.array(told("unlike"))))
        .when(signals < C.MIN_SIGNALS, made(F.lit(0.0), False, F.array(told("weak"))))
        .otherwise(made(F.least(F.lit(1.0), score), False, reasons))
    )


def pair_scores(stats: DataFrame, together: DataFrame) -> DataFrame:
    """kind, a, b, a_ord, b_ord, score, blocked, reasons of every two labels of a kind (the earlier is a)."""
    whole = stats.select("kind", F.struct("label", "ord", "type", "shapes", "rank", "px", "py").alias("s"))
    x, y = whole.withColumnRenamed("s", "a"), whole.withColumnRenamed("s", "b")
    pairs = x.join(y, "kind").filter(F.col("a.ord") < F.col("b.ord"))
    pairs = pairs.withColumn("p", F.least("a.label", "b.label")).withColumn("q", F.greatest("a.label", "b.label"))
    met = together.select("kind", F.col("a").alias("p"), F.col("b").alias("q"), F.lit(True).alias("met"))
    scored = pairs.join(met, ["kind", "p", "q"], "left").withColumn("e", merge_score("a", "b", F.col("met").isNotNull()))
    return scored.select(
        "kind", F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "e.*"
    )


def merge_labels(labels: list[str], pairs: list[tuple[str, str, float]], apart: set[frozenset[str]]) -> dict[str, str]:
    """label: root, merging the strongest pairs first and never two groups that hold labels seen together."""
    group = {label: [label] for label in labels}
    root = {label: label for label in labels}
    for a, b, _ in sorted(pairs, key=lambda p: -p[2]):
        ra, rb = root[a], root[b]
        if ra == rb or any(frozenset((x, y)) in apart for x in group[ra] for y in group[rb]):
            continue
        for x in group[ra]:
            root[x] = rb
        group[rb] += group.pop(ra)
    return root


def merge_groups(stats: DataFrame, pairs: DataFrame, together: DataFrame, threshold: float = C.MERGE_THRESHOLD) -> DataFrame:
    """kind, label, root of every label. One group is one kind's vocabulary, not its documents."""
    strong = pairs.filter(~F.col("blocked") & (F.col("score") >= threshold))
    part = lambda tag, df, a, b, s, o: df.select(
        "kind", F.lit(tag).alias("tag"), F.col(a).alias("a"), F.lit(None).cast("string").alias("b") if b is None else F.col(b).alias("b"), s.alias("score"), o.alias("o")
    )
    zero = F.lit(0.0)
    rows = (
        part("label", stats, "label", None, zero, F.struct(F.col("ord").alias("x"), F.lit(0).alias("y")))
        .unionByName(part("pair", strong, "a", "b", F.col("score"), F.struct(F.col("a_ord").alias("x"), F.col("b_ord").alias("y"))))
        .unionByName(part("apart", together, "a", "b", zero, F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
        .select("kind", "tag", "a", "b", "score", F.col("o.x").alias("x"), F.col("o.y").alias("y"))
    )

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        of = lambda tag: g[g["tag"] == tag].sort_values(["x", "y"], kind="stable")
        labels = of("label")["a"].tolist()
        apart = {frozenset(p) for p in zip(of("apart")["a"], of("apart")["b"])}
        strongest = list(zip(of("pair")["a"], of("pair")["b"], of("pair")["score"]))
        root = merge_labels(labels, strongest, apart)
        return pd.DataFrame({"kind": key[0], "label": labels, "root": [root[x] for x in labels]})

    return rows.groupBy("kind").applyInPandas(run, "kind int, label string, root string")


def fields_of(stats: DataFrame, roots: DataFrame, pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """kind, field, name, aliases, type, coverage, samples, rationale, position of every reconciled field.

    documents: kind, documents (how many the kind has).
    """
    s = stats.join(roots, ["kind", "label"])
    shouting = (F.col("label") == F.upper("label")).cast("int")
    clipped = F.col("label").rlike("[.#]").cast("int")
    clarity = F.struct((-F.size(label_tokens(F.col("label")))).alias("t"), shouting.alias("s"), clipped.alias("c"), (-F.col("occurrences")).alias("n"), "ord")
    member = F.struct("ord", "label", "type", "samples")
    grouped = s.groupBy("kind", "root").agg(
        F.min_by("label", clarity).alias("name"),
        F.array_sort(F.collect_list(member)).alias("members"),
        F.sum("occurrences").alias("occurrences"),
    )
    a, b = (roots.withColumnsRenamed({"label": x, "root": f"root_{x}"}) for x in "ab")
    why = pairs.join(a, ["kind", "a"]).join(b, ["kind", "b"]).filter("root_a = root_b and size(reasons) > 0")
    text = F.concat(F.lit('"'), "a", F.lit('" ≡ "'), "b", F.lit('": '), F.array_join("reasons", "; "))
    why = why.groupBy("kind", F.col("root_a").alias("root")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("a_ord", "b_ord", text.alias("t")))), lambda r: r["t"]).alias("rationale")
    )
    full = grouped.join(why, ["kind", "root"], "left").join(documents, "kind")
    coverage = F.least(F.lit(1.0), F.col("occurrences") / F.greatest(F.lit(1), F.col("documents")))
    full = full.select(
        "kind",
        F.col("root").alias("field"),
        "name",
        F.filter(F.transform("members", lambda m: m["label"]), lambda m: m != F.col("name")).alias("aliases"),
        F.element_at("members", 1)["type"].alias("type"),
        coverage.alias("coverage"),
        F.slice(F.flatten(F.transform("members", lambda m: m["samples"])), 1, C.SAMPLES).alias("samples"),
        F.coalesce("rationale", F.array().cast("array<string>")).alias("rationale"),
        F.element_at("members", 1)["ord"].alias("ord"),
    )
    order = Window.partitionBy("kind").orderBy(F.col("coverage").desc(), "ord")
    return full.withColumn("position", F.row_number().over(order) - 1).drop("ord")


def kind_said(said: DataFrame) -> DataFrame:
    """kind, title, n: the most frequent self-description of a kind (kind, doc_id, said), in its first casing."""
    keyed = said.filter(F.col("said").isNotNull()).withColumn("key", F.lower("said"))
    votes = keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("said", "doc_id").alias("title"), F.min("doc_id").alias("first"))
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), "first")
    return votes.withColumn("k", F.row_number().over(order)).filter("k = 1").select("kind", "title", "n")


def kind_names(documents: DataFrame, said: DataFrame, fields: DataFrame) -> DataFrame:
    """kind, name. fields: those kept; documents: kind, documents."""
    from sheaf.functions.labels import pluralise, title_case

    words = fields.groupBy("kind").agg(
        F.lower(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "aliases"))), lambda f: F.concat(F.array(f["name"]), f["aliases"]))), " ")).alias("words"),
        F.min_by("name", F.when((F.col("coverage") >= C.IDENTIFYING) & (F.col("type") == "identifier"), F.col("position"))).alias("identifier"),
        F.min_by("name", F.when(F.col("coverage") >= C.IDENTIFYING, F.col("position"))).alias("covered"),
        F.min_by("name", "position").alias("first"),
    )
    quorum = F.greatest(F.lit(2), F.ceil(F.col("documents") * C.NAME_QUORUM))
    vocabulary = F.coalesce(*[F.when(F.contains(F.col("words"), F.lit(w)), F.lit(label)) for w, label in C.KIND_WORDS])
    named = documents.join(words, "kind", "left").join(kind_said(said), "kind", "left")
    fallback = F.concat(F.coalesce("identifier", "covered", "first"), F.lit(" documents"))
    name = (
        F.when(F.col("words").isNull(), "Unstructured documents")
        .when(F.col("n") >= quorum, pluralise(title_case(F.col("title"))))
        .otherwise(F.coalesce(vocabulary, fallback, F.concat(F.lit("Kind "), (F.col("kind") + 1).cast("string"))))
    )
    return named.select("kind", name.alias("name"))
