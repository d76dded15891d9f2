"""Document fingerprints: threshold-scaled sketches, in DataFrame functions alone.

A text's shingles are its runs of ``SHINGLE`` words (split at ASCII space; a shorter text is one
shingle). Each is hashed to 64 bits, and every hash below the fixed fraction 1/``SCALE`` of the range is
kept, of texts of every length alike. Sketches can be merged by union, and the share of one sketch found
in another estimates containment however unequal the documents are.

That no text is without a hash, the ``FEW`` smallest are kept even where they lie over the threshold;
comparisons leave those out. Where fewer than ``FEW`` hashes of either text lie under the threshold, a
sketch can't tell, and the two texts' whole sets of shingles are compared instead.

The next document is found in ranges of the order of ids and digests. Spark's sample of that order deals
ids and digests alone into ranges, so neither wide nor outlying ids matter; a range's last key is its bound.
Rows then go to their ranges by comparison with the bounds, the last row of each also to the next range, so
texts are shuffled once and each range is ordered by itself.

Cases: a null text counts as empty and has an empty sketch, written ``4:``; likeness is the share of the
smaller set found in the other, 1 for two empty texts and 0 where one is empty and the other isn't;
rows of one doc_id stand in the order of their texts' MD5, rows without an id before all others; rows
repeated whole follow one another; the document after the last is the first, so a single one follows
itself; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.plans.staging import stage

SHINGLE = 5
SCALE = 4
#: Hashes that every sketch has (if its text has as many), and that a comparison of sketches needs.
FEW = 16
FLOOR = -(1 << 63)
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows of a range, about, and ranges at most (their bounds are a literal of the plan).
RANGE_ROWS, RANGES = 4096, 4096


def below(hashes: Column, scale: int = SCALE) -> Column:
    return F.filter(hashes, lambda h: h < F.lit(FLOOR + (1 << 64) // scale))


def shingles_of(text: str) -> Column:
    """The distinct hashes of a whole text's shingles."""
    words = F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))

    def runs(w: Column) -> Column:
        n = F.size(w)
        run = F.transform(
            F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        )
        return F.when(n >= SHINGLE, run).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.transform(F.array(words), runs)[0])  # words are bound once


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted distinct hashes that the sketch of a text keeps."""
    hashed = df.withColumn("__shingles", F.sort_array(shingles_of(text)))
    kept = F.transform(F.array(below(F.col("__shingles"))), lambda x: F.when(F.size(x) >= FEW, x).otherwise(F.slice("__shingles", 1, FEW)))[0]
    return hashed.withColumn(name, kept).drop("__shingles")


def shown(sketch: str) -> Column:
    """A sketch as text: the scale and the hashes as 16 hexadecimal digits each."""
    return F.concat(F.lit(f"{SCALE}:"), F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ""))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set of hashes found in the other."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def with_likeness(df: DataFrame, a: str, b: str, name: str, texts: tuple[str, str]) -> DataFrame:
    """Adds ``name``: how alike the sketches a and b are, or their texts where the sketches can't tell."""
    with_sides = df.withColumns({"__a": below(F.col(a)), "__b": below(F.col(b))})
    enough = F.least(F.size("__a"), F.size("__b")) >= FEW
    both = F.array(F.struct(shingles_of(texts[0]).alias("x"), shingles_of(texts[1]).alias("y")))
    whole = F.transform(both, lambda p: containment(p["x"], p["y"]))[0]
    got = F.when(enough, containment(F.col("__a"), F.col("__b"))).otherwise(whole)
    return with_sides.withColumn(name, got).drop("__a", "__b")


def order_key(id: Column, text: Column) -> Column:
    """A text that sorts as documents do: without an id first, then by id, then by the text's digest."""
    place = F.lpad(F.hex(F.coalesce(id.cast("long"), F.lit(0)).bitwiseXOR(F.lit(FLOOR))), 16, "0")
    return F.concat(F.when(id.isNull(), "0").otherwise("1"), place, F.md5(text))


def place_in(bounds: list[str], key: str) -> Column:
    """How many of the rising bounds are less than the key: first by steps of their square root, then inside a step."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    less = lambda c: F.size(F.filter(c, lambda b: b < F.col(key)))
    coarse = F.array(*[F.lit(p[-1]) for p in parts])
    fine = F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts])
    passed = less(coarse)
    return F.when(passed >= len(parts), len(bounds)).otherwise(passed * step + less(F.get(fine, passed)))


def with_following(rows: DataFrame, id: str, text: str, name: str) -> DataFrame:
    """``id``, ``text`` and ``name``: the text of the next row in descending order of the id.

    Rows that are repeated whole are one row while they are ordered, and as many again at the end: all of
    them but one are followed by their own text.
    """
    rows = rows.select(F.col(id).alias("__id"), F.col(text).alias("__text"), order_key(F.col(id), F.col(text)).alias("__key"))
    keys = stage(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")), "sketch-keys")
    ranges = max(1, min(RANGES, -(-keys.count() // RANGE_ROWS)))
    dealt = keys.select("__key").repartitionByRange(ranges, "__key").groupBy(F.spark_partition_id().alias("part"))
    bounds = sorted(r["last"] for r in dealt.agg(F.max("__key").alias("last")).collect())  # a key for each range
    repeated = stage(keys.filter("__n > 1"), "sketch-repeated")
    unique = rows.withColumn("__n", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        many = rows.join(repeated, "__key").groupBy("__key").agg(F.first("__id").alias("__id"), F.first("__text").alias("__text"), F.first("__n").alias("__n"))
        unique = unique.join(repeated.select("__key"), "__key", "left_anti").unionByName(many)
    if not bounds:
        return unique.select(F.col("__id").alias(id), F.col("__text").alias(text), F.col("__text").alias(name))
    last = F.col("__key").isin(bounds) if len(bounds) <= 10 else F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("__key"))
    placed = unique.withColumns({"__part": place_in(bounds, "__key"), "__last": last})
    own = F.struct(F.col("__part").alias("part"), F.lit(1).alias("own"))
    sent = F.struct(((F.col("__part") + 1) % len(bounds)).alias("part"), F.lit(0).alias("own"))
    copies = placed.withColumn("__to", F.explode(F.when(F.col("__last"), F.array(own, sent)).otherwise(F.array(own))))
    order = Window.partitionBy("__to.part").orderBy("__to.own", "__key")
    led = copies.withColumn("__following", F.lag("__text").over(order)).filter("__to.own = 1")
    following = F.array("__following")
    if not repeated.isEmpty():
        following = F.concat(following, F.array_repeat("__text", (F.col("__n") - 1).cast("int")))
    return led.select(F.col("__id").alias(id), F.col("__text").alias(text), F.explode(following).alias(name))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The sketches of every whole text and of its edited text, and how alike they are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_following(rows, "doc_id", "text", "next_text")
    counted = led.withColumns({"n_chars": F.length("text").cast("long"), "__k": F.expr("length(text) div 3").cast("int")})
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("__k")).cast("int")), F.substring("next_text", F.lit(1), F.col("__k")))
    made = counted.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    for text, name in (("text", "sketch"), ("next_text", "next_sketch"), ("edited", "edited_sketch")):
        made = with_sketch(made, text, name)
    made = with_likeness(made, "sketch", "edited_sketch", "near_edited", ("text", "edited"))
    made = with_likeness(made, "sketch", "next_sketch", "near_next", ("text", "next_text"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("sketch").alias("fingerprint"),
        shown("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
