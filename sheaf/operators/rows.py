"""Searching, sorting and limiting the rows of a committed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import constants as C
from sheaf.plans.staging import stage


def display_text(df: DataFrame, name: str) -> Column:
    """A column as the text that a relational client shows: whole doubles without a fraction."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def search(df: DataFrame, query: str | None) -> DataFrame:
    """Rows of which any column's text holds the query, case aside. ``%``, ``_`` and ``\\`` keep their LIKE meaning."""
    if not query:
        return df
    hits = [F.coalesce(display_text(df, c).ilike(f"%{query}%"), F.lit(False)) for c in df.columns]
    return df.filter(reduce(Column.__or__, hits))


def order_of(df: DataFrame, sort: str | None = None, direction: str = "asc") -> Column:
    """The sort column if the table has it, else ``document`` (or the first column); nulls last either way."""
    name = sort if sort in df.columns else "document" if "document" in df.columns else df.columns[0]
    c = F.col(f"`{name}`")
    return c.desc_nulls_last() if sort in df.columns and direction.lower() == "desc" else c.asc_nulls_last()


def rows(df: DataFrame | None, query: str | None = None, sort: str | None = None, direction: str = "asc", limit: int | None = None) -> DataFrame | None:
    """Filtered, ordered, limited; a table that isn't committed (None) has no rows."""
    if df is None:
        return None
    n = C.ROWS_DEFAULT if limit is None else max(0, min(C.ROWS_CAP, int(limit)))
    return search(df, query).orderBy(order_of(df, sort, direction)).limit(n)


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Numbers a whole table from 1 in an order, range by range: no task sees more than its range.

    Ranges are dealt by a sample of the order; each is numbered by itself, and the rows of the ranges
    before it, one number a range, are added.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "placed")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = dealt.withColumn(name, own).join(F.broadcast(bases), "__part")
    return numbered.withColumn(name, (F.col(name) + F.col("__base")).cast("long")).drop("__part", "__base")


def reviewed(df: DataFrame) -> DataFrame:
    """Rows of a committed table that nothing is left to review in."""
    return df.filter("_needs_review = 0")


def total(df: DataFrame, query: str | None = None) -> int:
    return search(df, query).count()


def columns(df: DataFrame) -> list[tuple[str, str]]:
    """(name, type) by ordinal."""
    return list(df.dtypes)
