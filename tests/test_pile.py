"""The generated pile end to end, through the store: kinds, fields, cells, review, commit, rows, deletion."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators import review, rows
from sheaf.operators.cells import accuracy
from sheaf.plans.ingest import ingest
from sheaf.sources import corpus
from sheaf.sources.store import Store
from sheaf.streaming.progress import STAGES


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    tokens, pages, truth = corpus.pile(spark)
    store = Store(spark, f"file://{root}", "demo")
    records = list(ingest(store, tokens, pages))
    return store, records, truth


def test_progress_and_status(stored):
    store, records, _ = stored
    assert tuple(r["stage"] for r in records) == STAGES
    assert store.status() in ("discovered", "committed")


def test_kinds_and_fields(stored):
    store, _, _ = stored
    kinds = {r["kind"]: (r["name"], r["documents"], r["fields"]) for r in store.overview().collect()}
    assert sorted(kinds.values()) == [("Account Statements", 2, 2), ("Invoices", 31, 7), ("Receipts", 5, 2), ("Unstructured documents", 2, 0)]
    fields = {r["name"]: r for r in store.fields().filter("kind = 0").collect()}
    sets = {frozenset([n, *r["aliases"]]): r["coverage"] for n, r in fields.items()}
    assert sets[frozenset(["INVOICE NUMBER", "Inv. Number", "Invoice", "Invoice No.", "Reference"])] == 1
    assert frozenset(["VAT", "VAT @ 20%", "GST (18%)", "SALES TAX", "Tax"]) in sets
    assert sum(c >= 0.5 for c in sets.values()) == 7 and sum(c == 1 for c in sets.values()) == 6
    assert any(r["rationale"] for r in fields.values())


def test_every_invoice_value_is_right(stored, spark):
    store, _, truth = stored
    names = {"Invoice No.": "invoice_number", "Invoice Date": "invoice_date", "Bill To": "customer", "Subtotal": "subtotal", "Total Due": "total"}
    tax = store.fields().filter("kind = 0 and array_contains(concat(array(name), aliases), 'VAT')").first()["name"]
    names[tax] = "tax"
    known = spark.createDataFrame(list(names.items()), "name string, field string")
    cells = store.cells().filter("kind = 0").withColumnRenamed("field", "fid")
    cells = cells.join(store.fields().select(F.col("field").alias("fid"), "name"), "fid").join(known, "name")
    got = {r["field"]: (r["checked"], r["correct"], r["missing"]) for r in accuracy(cells, truth.filter("kind = 'invoice'")).collect()}
    assert got == {f: (31, 31, 0) for f in names.values()}


def test_review_then_commit_then_rows(stored, spark):
    store, _, _ = stored
    cell = store.cells().filter("kind = 0 and source_label = 'Issued'").orderBy("cell_id").first()
    store.confirm(cell["cell_id"])
    money = store.cells().filter("kind = 0 and source_label = 'Amount Payable' and status = 'unreviewed'").orderBy("cell_id").first()
    signature, shown = store.correct(money["cell_id"], money["raw"].removeprefix("INR "))
    assert signature == review.Signature("strip_prefix", "INR ")
    candidates = shown.select("cell_id", "after").collect()
    assert len(candidates) == 5 and money["cell_id"] not in {c["cell_id"] for c in candidates}
    first = spark.createDataFrame([tuple(c) for c in candidates[:2]] + [(cell["cell_id"], "no")], "cell_id string, after string")
    assert store.approve(first) == 2
    state = {r["cell_id"]: (r["status"], r["confidence"]) for r in store.cells().collect()}
    assert state[cell["cell_id"]] == ("confirmed", 1.0) and state[candidates[0]["cell_id"]] == ("corrected", 0.95)
    field = store.fields().filter("kind = 0 and name = 'Bill To'").first()["field"]
    store.patch_field(field, name="Customer")
    table, df = store.commit(0)
    assert (table, df.count(), df.columns[0], df.columns[-1]) == ("extract_invoices_demo", 31, "document", "_needs_review")
    assert "customer" in df.columns and dict(df.dtypes)["total_due"] == "decimal(16,2)" and dict(df.dtypes)["invoice_date"] == "date"
    assert df.filter("invoice_date is null or total_due is null").count() == 0
    assert rows.total(df, "alderbrook") == 7
    top = rows.rows(df, sort="total_due", direction="desc", limit=3).collect()
    assert [r["total_due"] for r in top] == sorted((r["total_due"] for r in df.collect()), reverse=True)[:3]
    assert store.status() == "committed" and store.table_of(0).count() == 31 and store.table_of(1) is None
    store.delete()
    assert not store.exists("cells") and not spark.catalog.tableExists(table)
