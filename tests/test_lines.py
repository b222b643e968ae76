from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.operators import lines


def anchored(tops):
    starts, anchor = [], -999.0
    for i, t in enumerate(tops):
        if abs(t - anchor) > 2.0:
            starts.append(i)
            anchor = t
    return starts


def test_anchor_does_not_move(spark):
    df = spark.createDataFrame([([0.0, 1.5, 2.0, 3.4, 3.9, 4.1, 9.0],)], "t array<double>")
    assert df.select(lines.row_starts(F.col("t"))).first()[0] == [0, 3, 6]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 60).map(lambda x: x / 2), max_size=30).map(sorted), min_size=1, max_size=20))
def test_rows_against_a_loop(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "k int, t array<double>")
    got = {r.k: r.s for r in df.select("k", lines.row_starts(F.col("t")).alias("s")).collect()}
    assert got == {k: anchored(t) for k, t in enumerate(pages)}


def test_body_lines(spark):
    words = spark.createDataFrame(
        [
            ("d", 0, 0, "мир", 50.0, 10.4, 20.0, "Arial", 12.0), ("d", 0, 1, "Привет", 10.0, 11.9, 20.0, "Arial-BOLD", 14.0),
            ("d", 0, 2, "ab", 0.0, 30.0, 40.0, "A", 10.0), ("d", 0, 3, "cd", 9.0, 30.0, 40.0, "B-Bold", 11.0), ("d", 0, 4, " ", 0.0, 60.0, 70.0, "A", 10.0),
        ],
        "doc_id string, page_idx int, word_idx int, text string, x0 double, top double, bottom double, fontname string, size double",
    )
    got = [(r.text, r.bold, r.size, r.font) for r in lines.body_lines(words).orderBy("line_no").collect()]
    # the font with most characters, on ties the first from the left; rows without text are left out
    assert got == [("Привет мир", True, 13.0, "Arial-BOLD"), ("ab cd", False, 10.5, "A")]


def test_page_classes(spark):
    rows = [("d", p, i, t) for p, ts in enumerate([["a..... 1", "b..... 2", "c..... 3"], ["Оглавление", "x"], ["1 a 2", "2 b 3", "3 c 4"], ["a..... 1", "b"], ["Содержание глав"]]) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id string, page_idx int, line_no int, text string")
    assert [r.fmt for r in lines.toc_class(df).orderBy("page_idx").collect()] == ["A", "B", "B", "", "B"]
    assert [r.is_toc for r in lines.body_toc_pages(df).orderBy("page_idx").collect()] == [True, True, True, False, False]
