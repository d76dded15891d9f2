from pyspark.sql import functions as F

from sheaf.functions import labels


def over(spark, texts, column):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_tokens(spark):
    cases = ["Inv. Number", "Invoice #", "VAT @ 20%", "GST (18%)", "Date of Issue", "Ref No", "the of"]
    assert over(spark, cases, labels.label_tokens) == [
        ["invoice", "number"], ["invoice", "number"], ["vat"], ["gst"], ["date", "issue"], ["reference", "number"], [],
    ]


def test_similarity(spark):
    df = spark.createDataFrame([("Invoice", "Invoice Number"), ("Payment Due", "Due Date"), ("Total", "Tax"), ("of", "Tax")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(labels.label_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.75, round(1 / 3, 4), 0.0, 0.0]


def test_names(spark):
    assert over(spark, ["Inv. Number", "18% Tax", "**", "x" * 80], labels.column_name) == ["inv_number", "f_18_tax", "field", "x" * 55]
    assert labels.distinct_names(["a", "a_2", "a", "a"]) == ["a", "a_2", "a_3", "a_4"]
    assert [labels.column_base(x) for x in ("Inv. Number", "18% Tax", "**")] == ["inv_number", "f_18_tax", "field"]
    assert over(spark, ["Account Statements", "A__b!"], labels.table_name) == ["extract_account_statements", "extract_a_b"]
    assert over(spark, ["INVOICE", "Policy", "Box", "Invoices", "eBay NOTE", "Day"], lambda c: labels.pluralise(labels.title_case(c))) == [
        "Invoices", "Policies", "Boxes", "Invoices", "eBay Notes", "Days",
    ]
    assert over(spark, [" Invoice #: ", "Total："], labels.normalise_label) == ["Invoice", "Total"]
