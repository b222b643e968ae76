import pytest
from pyspark.sql import functions as F

from foliomill.operators import lists


def found(spark, content, heading=""):
    rows = spark.createDataFrame([(content, heading)], "content string, heading string")
    return lists.with_lists(rows).first().lists


def test_bullets(spark):
    got = found(spark, "Причины: • дефицит железа при рождении; • алиментарный дефицит; • повышенные потребности организма.", "Этиология")
    assert [(x.type, x.topic, len(x["items"])) for x in got] == [("bullet", "этиология", 3)]
    assert got[0]["items"][0] == "дефицит железа при рождении"


def test_dashes_with_semicolons(spark):
    got = found(spark, "Формы: - экзема истинная; - экзема микробная; - экзема себорейная; - экзема детская.")
    assert len(got) == 1 and len(got[0]["items"]) == 4


@pytest.mark.parametrize(
    "content",
    [
        "Холецистит – воспаление ЖП. Острый холецистит – острое воспаление. Хронический холецистит – хроническое.",
        "ОРВИ – самая частая инфекция. Дети до 5 лет переносят 6-8 эпизодов в год.",
        "1. Иванов А.А. // Вестник. 2020; Vol. 5: 10-15. 2. Smith B. et al. doi:10.1/abc. 2019. 3. Петров // Ж. 2021. pp. 20-25.",
        "", "   ", None, "Рекомендуется: • только один пункт в этом тексте.",
    ],
)
def test_no_list(spark, content):
    assert found(spark, content) == []


def test_numbers_and_mixed(spark):
    got = found(spark, "На основании: 1) анализа жалоб; 2) анамнестических данных; 3) физикального обследования.")
    assert [x.type for x in got] == ["numbered"] and len(got[0]["items"]) == 3
    got = found(spark, "Признаки: • анемический синдром; • желтуха и бледность; • темная моча. Далее: 1) клинически; 2) лабораторно; 3) инструментально.")
    assert [x.type for x in got] == ["bullet", "numbered"]


def test_dash_threshold(spark):
    rows = spark.createDataFrame([(["a;", "b;", "c;", "d"], ["a;", "b", "c"], ["a;", "b"], ["a;"])], "a array<string>, b array<string>, c array<string>, d array<string>")
    assert list(rows.select(*[lists.is_dash_list(F.col(c)) for c in "abcd"]).first()) == [True, False, True, False]


def test_adjacent_markers(spark):
    rows = spark.createDataFrame([("• • zzz",)], "c string")
    from foliomill.functions import regex as R

    assert rows.select(lists.segments(F.col("c"), R.BULLET)).first()[0] == ["", "zzz"]
