"""Printed figures and what they mean."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions.finance import parse_values, register
from folioflow.functions.text import furniture_key, normal, numbering_depth

# text, num, currency, unit, style, dash, footnotes
CASES = [
    ("1,234", 1234.0, None, None, None, False, []),
    ("1 234 567", 1234567.0, None, None, None, False, []),
    ("(1,234)", -1234.0, None, None, "parentheses", False, []),
    ("$(1,234)", -1234.0, "USD", "currency", "parentheses", False, []),
    ("€1.234", 1.234, "EUR", "currency", None, False, []),
    ("1,234€", 1234.0, "EUR", "currency", None, False, []),
    ("(4.5)%", -4.5, None, "percent", "parentheses", False, []),
    ("1,234 (1)", 1234.0, None, None, None, False, ["1"]),
    ("(1,234) (2)", -1234.0, None, None, "parentheses", False, ["2"]),
    ("-12", -12.0, None, None, "minus", False, []),
    ("１２．５", 12.5, None, None, None, False, []),
    ("—", None, None, None, None, True, []),
    ("n/a", None, None, None, None, True, []),
    ("(12)", -12.0, None, None, "parentheses", False, []),
    ("$-5", -5.0, "USD", "currency", "minus", False, []),
]


@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_values(spark, scale):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["value"] for r in parse_values(df, F.col("t"), F.lit(scale)).collect()}
    for i, (text, num, currency, unit, style, dash, notes) in enumerate(CASES):
        v = got[i]
        assert (v["num"], v["currency"], v["unit"], v["negative_style"], v["is_dash"], v["footnote_refs"]) == (num, currency, unit, style, dash, notes), text
        if num is not None:
            assert v["scaled"] == (num if unit == "percent" else num * scale)


def test_no_figures(spark):
    texts = ["", "   ", None, "2019 vs 2018", "1,2,3,4x", "-$5", "$(567)", "1d", "NaN", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["value"] for r in parse_values(df, F.col("t")).collect()] == [None] * len(texts)


def test_table_currency(spark):
    df = spark.createDataFrame([("5",), ("—",), ("3%",)], "t string")
    got = [r["value"] for r in parse_values(df, F.col("t"), currency=F.lit("EUR")).collect()]
    assert [(v["currency"], v["unit"]) for v in got] == [("EUR", "currency"), ("EUR", "currency"), ("EUR", "percent")]


def test_text_forms(spark):
    row = spark.createDataFrame([("Page  12 of ß",)], "t string").select(furniture_key(F.col("t")).alias("k"), normal(F.lit("Ａ – b")).alias("n")).first()
    assert (row["k"], row["n"]) == ("page # of ss", "a - b")


def test_numbering(spark):
    texts = [("12.3.1 A", 3), ("12.3 A", 2), ("12. A", 1), ("(a) A", 3), ("NOTE 4 x", 1), ("Item IV", 1), ("12 A", None), ("Plain", None)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r[0] for r in df.select(numbering_depth(F.col("t"))).collect()] == [d for _, d in texts]
    register(spark)
    df.createOrReplaceTempView("headings_seen")
    assert [r[0] for r in spark.sql("SELECT numbering_depth(t) FROM headings_seen").collect()] == [d for _, d in texts]
