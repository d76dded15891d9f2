"""Value typing: tables of cases, and the Column form against the plain one on random texts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import scalars, values

TYPED = {
    "INV-2026-01042": "identifier", "2026-02-18": "date", "04/05/2026": "date", "09 Feb 2026": "date", "Feb 09, 2026": "date",
    "Sept 3, 2026": "date", "31 Foo 2026": "identifier", "13/13/2026": "identifier", "+91 98765 43210": "phone", "1234567.89": "phone",
    "$1,234.56": "money", "Rs.100": "money", "Rs. 100": "identifier", "INR 171120.70": "money", "(5)": "money", "-$5.00": "text",
    "42": "integer", "1,234": "integer", "3.14159": "number", "a.b@c.io": "email", "yes": "boolean", "N": "boolean", "": "text",
    "Halcyon Retail Pvt Ltd": "text", "2026-13-45": "date", " 42﻿": "integer", "12\n": "integer", "R0400217": "identifier",
}
MONEY = {
    "(1,234.56)": (-1234.56, None), "$5": (5.0, "USD"), "5€": (5.0, "EUR"), "Rs 10.5": (10.5, "INR"), "usd 3": (3.0, "USD"), "7.00": (7.0, None), "7": None,
    "7.123": None, "abc": None,
}


def collect(spark, texts, column):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [r[0] for r in df.select(column(F.col("raw"))).collect()]


def test_typing_table(spark):
    df = values.with_value(spark.createDataFrame([(t,) for t in TYPED], "raw string"), F.col("raw"))
    got = {r["raw"]: r["value"]["type"] for r in df.collect()}
    assert got == TYPED
    assert {t: scalars.type_of(t)[0] for t in TYPED} == TYPED


def test_null_is_empty_text(spark):
    row = values.with_value(spark.createDataFrame([(None,)], "raw string"), F.col("raw")).first()["value"]
    assert (row["type"], row["text"], row["confidence"]) == ("text", None, 0.0)


def test_money(spark):
    for text, got in zip(MONEY, collect(spark, MONEY, values.parse_money)):
        assert (got and (got["amount"], got["currency"])) == MONEY[text]
        plain = scalars.parse_money(text)
        assert (plain and plain[:2]) == MONEY[text]


def test_dates_take_the_style_they_are_given(spark):
    cases = ["04/05/2026", "13/05/2026", "05/13/2026", "13/13/2026", "9 February 2026", "Feb 30, 2026", "32 Feb 2026"]
    for style in ("unknown", "dmy", "mdy"):
        for text, got in zip(cases, collect(spark, cases, lambda c, s=style: values.parse_date(c, s))):
            plain = scalars.parse_date(text, style)
            assert (None if got is None else (got["iso"], got["confidence"], got["style"], got["ambiguous"])) == plain
    assert scalars.parse_date("04/05/2026", "mdy") == ("2026-04-05", 0.85, "mdy", False)
    assert scalars.parse_date("04/05/2026")[0::3] == ("2026-05-04", True)


def test_shape(spark):
    cases = {" INV-2026-01042 ": "A+-9+-9+", "KES-2026-01006": "A+-9+-9+", "A1": "A9", "": "", "é9": "é9"}
    assert collect(spark, cases, values.shape_of) == list(cases.values())


TEXT = st.text(alphabet="0123456789/.-, $£()RsINabFeJ@yn: \t", max_size=18)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=20, max_size=60))
def test_column_form_equals_the_plain_form(spark, texts):
    df = values.with_value(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string"), F.col("raw"))
    got = {r["i"]: (r["value"]["type"], r["value"]["confidence"]) for r in df.collect()}
    assert got == {i: scalars.type_of(t) for i, t in enumerate(texts)}


def test_typing_stays_small_enough_for_the_compiler(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes."""
    import re

    from pyspark.sql import functions as F

    from sheaf.functions import values

    values.with_value(spark.range(9).select(F.col("id").cast("string").alias("raw")), F.col("raw"), "v", proof="p").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000, sizes
