"""Label and name functions, as Column expressions (and the one naming step that is sequential)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.functions.values import js_trim


def normalise_label(c: Column) -> Column:
    return js_trim(F.regexp_replace(js_trim(c), r"[:：#]+\z", ""))


def label_tokens(c: Column) -> Column:
    """Words of a label: parentheses and rates dropped, abbreviations spelt out, stop words left out."""
    t = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    t = F.regexp_replace(t, r"@?\s*\d+(\.\d+)?\s*%", " ")
    words = F.filter(F.split(F.regexp_replace(t, "[^a-z0-9#]+", " "), " +"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in C.ABBREVIATIONS.items() for x in kv])
    spelt = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.filter(spelt, lambda w: ~w.isin(*C.STOPWORDS))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays, and a bonus when one holds the other; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    bonus = F.when(shared == F.least(F.size(x), F.size(y)), C.NAME_CONTAINED).otherwise(0.0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.least(F.lit(1.0), shared / union + bonus))


def label_similarity(a: Column, b: Column) -> Column:
    return token_similarity(label_tokens(a), label_tokens(b))


def similar_pairs(names: DataFrame) -> DataFrame:
    """a, b (a < b), similarity of all distinct labels (column ``label``) that share a word; no other pair is alike.

    Labels meet at their words, so the work is that of the pairs that come out, not of all there could be.
    """
    told = names.withColumn("w", F.array_distinct(label_tokens(F.col("label"))))
    words = told.select("label", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = (words.select("word", F.col("label").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, "word").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("s"))
    bonus = F.when(F.col("s") == F.least("na", "nb"), C.NAME_CONTAINED).otherwise(0.0)
    shared = F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    return met.select("a", "b", F.least(F.lit(1.0), shared + bonus).alias("similarity"))


def ordinal(n: Column) -> Column:
    return F.when(n == 1, "first").when(n == 2, "second").when(n == 3, "third").otherwise(F.concat(n.cast("string"), F.lit("th")))


def title_case(c: Column) -> Column:
    """Words in capitals become Capitalised; deliberate mixed case stays."""
    capital = lambda w: F.concat(F.substring(w, 1, 1), F.lower(w.substr(F.lit(2), F.length(w))))
    return F.array_join(F.transform(F.split(c, r"\s+"), lambda w: F.when(w == F.upper(w), capital(w)).otherwise(w)), " ")


def pluralise(c: Column) -> Column:
    return (
        F.when(c.rlike(r"(?i)s\z"), c)
        .when(c.rlike(r"(?i)(ch|sh|x|z)\z"), F.concat(c, F.lit("es")))
        .when(c.rlike(r"(?i)[^aeiou]y\z"), F.concat(c.substr(F.lit(1), F.length(c) - 1), F.lit("ies")))
        .otherwise(F.concat(c, F.lit("s")))
    )


def column_name(c: Column) -> Column:
    """The base of a field's column name, before it is told apart from names already taken."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    t = F.substring(F.regexp_replace(t, r"\A(\d)", "f_$1"), 1, C.COLUMN_NAME_LENGTH)
    return F.when(t == "", "field").otherwise(t)


def table_name(c: Column) -> Column:
    """``extract_`` and the slug of a kind's name; one underscore is dropped at each end."""
    return F.concat(F.lit("extract_"), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_|_\z", ""))


def distinct_names(bases: list[str]) -> list[str]:
    """Names told apart by _2, _3 and so on, in order; a made name may itself be taken already."""
    taken: set[str] = set()
    out = []
    for base in bases:
        name, n = base, 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_base(name: str) -> str:
    """Python twin of ``column_name`` for the driver's short list of fields."""
    t = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", name.lower()))
    return re.sub(r"^(\d)", r"f_\1", t)[: C.COLUMN_NAME_LENGTH] or "field"
