import pytest
from pyspark.sql import functions as F

from foliomill.operators import tables as T

YES_NO = [["№", "Критерии", "Оценка"], ["1", "Выполнен осмотр", "да/нет"], ["2", "Назначено", "да/нет"], ["3", "Проведено", "да/нет"]]
WRAPPED = [["№", "Критерии каче-\nства", "УУР", "УДД"], ["1", "a", "A", "1"], ["2", "b", "B", "2"], ["3", "c", "C", "3"]]
GOOD = [["Степень", "Описание"], ["Лёгкая", "a"], ["Средняя", "b"], ["Тяжёлая", "c"]]
FIRST = [["текст один", None], ["текст два", ""], ["текст три", None], ["текст четыре", "x"]]
SECOND = [[None, "текст один"], ["", "текст два"], [None, "текст три"], ["y", "текст четыре"]]


def flags(spark, rows):
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    r = F.col("rows")
    return df.select(T.is_checklist(r).alias("check"), T.is_legend(r).alias("legend"), T.is_artifact(r).alias("artifact"), T.is_wrapped_text(r).alias("wrap"), T.is_skipped(r).alias("skip")).first()


@pytest.mark.parametrize(
    "rows, kind",
    [
        (YES_NO, "check"), (WRAPPED, "check"), ([["УУР", "Расшифровка"]] * 4, "legend"), ([["УДД", "x"]] * 4, "legend"),
        ([["4", "Несравнительные исследования"], ["5", "мнение"], ["a", "b"]], "legend"), ([["a"]], "artifact"), ([["a", "b"], ["c", "d"]], "artifact"),
        ([], "artifact"), (FIRST, "wrap"), (SECOND, "wrap"), ([["", ""]] * 3, "wrap"),
        ([["a", "b", "c", "d"] + [""] * 6, [""] * 10, [""] * 10], "artifact"),
        ([["к.м.н. Иванов", "ФГБУ НИИ"], ["a", "b"], ["c", "d"]], "check"),
    ],
)
def test_left_out(spark, rows, kind):
    got = flags(spark, rows)
    assert got[kind] and got.skip


@pytest.mark.parametrize("rows", [GOOD, [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"], ["j", "k", "l"]]])
def test_kept(spark, rows):
    assert not flags(spark, rows).skip


def test_seven_of_ten_is_wrapped_and_rows_may_be_ragged(spark):
    assert flags(spark, [["a"]] * 4 + [["a", "b"]] * 3).wrap
    assert not flags(spark, [["a"]] * 3 + [["a", "b"]] * 3).wrap


def test_single_column_needs_a_diagnostic_header(spark):
    df = spark.createDataFrame([([["Критерии диагноза"], ["a"], ["b"]],), ([["Прочее"], ["a"], ["b"]],), ([["a", "b"]],)], "rows array<array<string>>")
    assert [r[0] for r in df.select(T.keeps_width(F.col("rows"))).collect()] == [True, False, True]


def test_captions(spark):
    box = "bbox struct<x0:double,top:double,x1:double,bottom:double>"
    tables = spark.createDataFrame([("d", 0, 0, (0.0, 100.0, 1.0, 200.0)), ("d", 0, 1, (0.0, 300.0, 1.0, 400.0))], f"doc_id string, page_idx int, table_idx int, {box}")
    words = spark.createDataFrame(
        [("d", 0, 0, "1.", 50.0, 90.2, 100.0), ("d", 0, 1, "Таблица", 10.0, 89.9, 99.0), ("d", 0, 2, "далеко", 0.0, 70.0, 80.0), ("d", 0, 3, "низко", 0.0, 99.0, 105.0), ("d", 0, 4, "текст", 0.0, 290.0, 299.0)],
        "doc_id string, page_idx int, word_idx int, text string, x0 double, top double, bottom double",
    )
    assert [(r.table_idx, r.caption) for r in T.captions(tables, words).collect()] == [(0, "Таблица 1.")]
