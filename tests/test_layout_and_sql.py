import pytest
from pyspark.sql import functions as F

from foliant.functions.register import register
from foliant.operators import layout


def test_rows_and_segments(spark):
    words = [("p", 0.0, 20.0, 0.0, 10.0, "Heat"), ("p", 24.0, 40.0, 0.5, 10.4, "flows"), ("p", 90.0, 99.0, 0.0, 10.0, "7"), ("p", 0.0, 30.0, 14.0, 24.0, "down"), ("p", None, 1.0, 1.0, 1.0, "x"), ("q", 0.0, 9.0, 0.0, 10.0, "one")]
    df = spark.createDataFrame(words, "page string, x0 double, x1 double, y0 double, y1 double, word string")
    got = [(r.page, r.text) for r in layout.word_rows(df, ["page"]).orderBy("page", "row", "segment").collect()]
    assert got == [("p", "Heat flows"), ("p", "7"), ("p", "down"), ("q", "one")]


LINES = "page string, x0 double, x1 double, y0 double, y1 double, size double, text string"


def test_pieces_and_paragraphs(spark):
    pieces = spark.createDataFrame([("p", 50.0, 90.0, 0.2, 10.0, 10.0, "flows down"), ("p", 0.0, 45.0, 0.0, 10.2, 10.0, "Heat"), ("p", 0.0, 45.0, 20.0, 30.0, 14.0, "Head")], LINES)
    assert [(r.text, r.size) for r in layout.merged_pieces(pieces, ["page"]).orderBy("line").collect()] == [("Heat flows down", 10.0), ("Head", 14.0)]
    lines = [("Heat", 0, 40, 0, 16.0), ("Heat flows down and", 0, 100, 20, 10.0), ("on to the sample.", 0, 60, 32, 10.0), ("Then it stops at", 0, 98, 44, 10.0), ("the wall.", 0, 30, 56, 10.0), ("q = m c", 0, 30, 68, 10.0), ("1. First point", 0, 40, 80, 10.0)]
    df = spark.createDataFrame([("p", float(a), float(b), float(y), y + 10.0, s, t) for t, a, b, y, s in lines], LINES)
    assert [r.paragraph for r in layout.paragraph_breaks(df, ["page"]).orderBy("y0").collect()] == [1, 2, 2, 3, 3, 4, 5]


@pytest.mark.parametrize(
    ("a", "b", "whole", "compound", "want"),
    [("the reac-", "tion", 5, 0, "the reaction"), ("steady-", "state", 0, 9, "steady-state"), ("reac­", "tion", 0, 0, "reaction"), ("水的", "密度", 0, 0, "水的密度"), ("heat", "flows", 0, 0, "heat flows"), ("x-", "Ray", 0, 0, "x- Ray"), ("new-", "word", None, None, "newword")],
)
def test_joined_lines(spark, a, b, whole, compound, want):
    df = spark.createDataFrame([(a, b, whole, compound)], "a string, b string, w int, c int")
    assert df.select(layout.joined_lines(*[F.col(c) for c in "abwc"]).alias("x")).first().x == want


def test_sizes_of_recognised_lines(spark):
    rows = [("p", 0.0, 9.0, 10.0 * i, 10.0 * i + 5, None, "a line of body text that goes on") for i in range(5)] + [("p", 0.0, 9.0, 90.0, 99.0, None, "Heading")]
    got = [(r.size, r.heading) for r in layout.recognised_sizes(spark.createDataFrame(rows, LINES), ["page"]).orderBy("y0").collect()]
    assert got == [(10.0, False)] * 5 + [(18.0, True)]


def test_functions_in_sql(spark):
    register(spark)
    row = spark.sql("SELECT match_key('Speciﬁc HEAT'), unit_value('mL'), unit_value('florps'), calc_value('2[m] * 3[m]'), calc_value('2[m] + 1[s]'), window_ratio('abcdef', 'abcdef'), match_key(NULL)").first()
    assert tuple(row) == ("specificheat", pytest.approx(1e-6), None, 6.0, None, 1.0, None)
    got = [(r.kind, r.id, r.field_no, r.key, r.value) for r in spark.sql("SELECT * FROM note_fields('::: concept T-1\nterm: Heat\nwhy: it\nflows\n:::\n::: question\nask: x')").collect()]
    assert got == [("concept", "T-1", 0, "term", "Heat"), ("concept", "T-1", 1, "why", "it\nflows"), ("question", None, 0, "ask", "x")]
