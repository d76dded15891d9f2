from pyspark.sql import functions as F

from sheaf.operators import review
from sheaf.operators.review import Signature, classify


def test_classify():
    assert classify("INR 10.00", "10.00") == Signature("strip_prefix", "INR ")
    assert classify("10.00 (net)", "10.00") == Signature("strip_suffix", " (net)")
    assert classify("<<10>>", "10") == Signature("strip_both", "<<", ">>")
    assert classify("04/05/2026", "2026-04-05") == Signature("date_convention", "dmy", "mdy")
    assert classify("04/05/2026", "2026-05-04") == Signature("date_convention", "mdy", "dmy")
    for before, after in (("$10", "10"), ("abc", "xyz"), ("", "a"), ("a", "a"), ("x10yy", "10"), ("05/13/2026", "2026-05-13")):
        assert classify(before, after) == review.MANUAL
    assert classify("04/05/2026", "2026-04-05").key == "date:dmy->mdy"
    assert Signature("strip_both", "a", "b").describe() == 'remove "a" and "b"'


def test_preview_refuses_what_would_be_lost(spark):
    rows = [("1", "INR 5.00"), ("2", "INR "), ("3", "INR abc"), ("4", "USD 5.00"), ("5", None), ("6", "INR 7"), ("7", "INR INV-1")]
    cells = spark.createDataFrame([(i, "d", raw) for i, raw in rows], "cell_id string, document string, raw string")
    got = {r["cell_id"]: r["after"] for r in review.preview(Signature("strip_prefix", "INR "), cells, "6").collect()}
    assert got == {"1": "5.00", "3": "abc", "7": "INV-1"}
    dates = spark.createDataFrame([("1", "d", "04/05/2026"), ("2", "d", "05/13/2026"), ("3", "d", "09 Feb 2026")], "cell_id string, document string, raw string")
    assert {r["cell_id"]: r["after"] for r in review.preview(Signature("date_convention", "dmy", "mdy"), dates).collect()} == {"1": "2026-04-05"}
    assert review.preview(review.MANUAL, dates).count() == 0


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "status string, confidence double")
    assert review.summary(empty).first()["total"] == 0


def test_last_event_wins(spark):
    base = spark.createDataFrame([("a", "unreviewed", 0.5), ("b", "empty", 0.0)], "cell_id string, status string, confidence double")
    events = spark.createDataFrame([("a", 1, "confirmed", None, 1.0), ("a", 2, "corrected", "x", 0.95)], review.EVENTS)
    got = {r["cell_id"]: tuple(r)[1:] for r in review.current_cells(base, events).select("cell_id", "status", "confidence", "corrected_to").collect()}
    assert got == {"a": ("corrected", 0.95, "x"), "b": ("empty", 0.0, None)}
    assert F is not None


def test_queue_deals_no_cells_out_by_field(spark):
    """All cells of a field would come to one task."""
    from pyspark.sql import functions as F

    from sheaf.operators import cells as cell_ops

    cells = spark.createDataFrame([(f"d{i}", "date", 0.1 * i, "unreviewed") for i in range(9)], "document string, field string, confidence double, status string")
    fields = spark.createDataFrame([("date", 0, True), ("total", 1, False)], "field string, position int, included boolean")
    for made in (review.queue(cells, fields), review.summary_of_fields(cells, fields)):
        assert "hashpartitioning(field" not in made._jdf.queryExecution().executedPlan().toString()
    assert [r["document"] for r in review.queue(cells, fields).collect()] == [f"d{i}" for i in range(8)]
    # what is seen first is kept in a hash table, not in a sort of each task's cells
    seen = cells.withColumn("n", F.length("document")).groupBy("field").agg(cell_ops.first_seen(cells.withColumn("n", F.length("document")), ["n"]))
    assert "SortAggregate" not in seen._jdf.queryExecution().executedPlan().toString()
