"""A pile derived from order tables: one document per order, its priority standing for the vendor.

Each vendor writes dates and totals its own way, so the value and review operators meet every rendering
at any scale. Columns: document, ord, field, source_label, raw, confidence, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: priority, date label, date pattern, total label, what stands before and after the total
VENDORS = (
    ("1-URGENT", "Invoice Date", "dd/MM/yyyy", "Total Due", "Rs ", ""),
    ("2-HIGH", "DATE", "MM/dd/yyyy", "TOTAL", "$", ""),
    ("3-MEDIUM", "Issued", "yyyy-MM-dd", "Amount Payable", "INR ", ""),
    ("4-NOT SPECIFIED", "Date of Issue", "dd MMM yyyy", "Grand Total", "(", ")"),
    ("5-LOW", "Raised on", "MMM dd, yyyy", "Balance Due", "£", ""),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_vendor(pick) -> Column:
    chain = F
    for v in VENDORS:
        chain = chain.when(F.col("o_orderpriority") == v[0], pick(v))
    return chain


def order_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells per order: its date and its total as the vendor writes them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    amount = F.col("o_totalprice").cast("decimal(16,2)").cast("string")
    cell = lambda n, name, label, raw: F.struct(
        F.lit(n).alias("ord"), F.lit(name).alias("field"), label.alias("source_label"), raw.alias("raw"), F.lit(0.5 + n / 4).cast("double").alias("confidence")
    )
    dates = cell(0, "date", _by_vendor(lambda v: F.lit(v[1])), _by_vendor(lambda v: F.date_format("o_orderdate", v[2])))
    totals = cell(1, "total", _by_vendor(lambda v: F.lit(v[3])), _by_vendor(lambda v: F.concat(F.lit(v[4]), amount, F.lit(v[5]))))
    cells = o.select("o_orderkey", "o_custkey", F.explode(F.array(dates, totals)).alias("c"))
    return cells.select(
        F.col("o_orderkey").cast("string").alias("document"), "o_orderkey", "o_custkey", "c.*", F.lit("unreviewed").alias("status")
    )


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field candidates drawn from line items: a label per status, a position per quantity and price.

    ``place`` is a line's place in the table, for line numbers are not unique in an order.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit(0).alias("kind"),
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.col("l_linenumber").alias("ord"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("label"),
        F.col("l_quantity").cast("int").cast("string").alias("value"),
        F.col("l_returnflag").alias("type"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 100).alias("y"),
        F.lit(595.0).alias("page_width"),
        F.lit(842.0).alias("page_height"),
        F.lit(0.5).alias("confidence"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("place"),
    )
