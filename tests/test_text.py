import pytest
from pyspark.sql import functions as F

from foliomill.functions import regex as R
from foliomill.functions import text as T


def apply(spark, fn, *values):
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return rows.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "fn, value, expected",
    [
        (T.normalize_line, "3. 3Хирургическое", "3.3Хирургическое"),
        (T.normalize_line, "1. 4. 2 Диагностика", "1.4.2 Диагностика"),
        (T.normalize_line, "1. Введение", "1. Введение"),
        (T.normalize_line, "2. 10 мг", "2.10 мг"),
        (T.normalize_number, " 1.1. ", "1.1"),
        (T.strip_dots, "Эпидемиология.............23", "Эпидемиология"),
        (T.strip_dots, "Эпидемиология.", "Эпидемиология."),
        (T.strip_dots, "Foo 15", "Foo 15"),
        (T.strip_dots, "Foo  12", "Foo"),
        (T.strip_page, "состояния, 15", "состояния,"),
        (T.strip_page, "Foo 12345", "Foo 12345"),
        (T.collapse, " a \t b ", "a b"),
        (T.clean_item, "  экзема  истинная ; ", "экзема истинная"),
        (T.clean_cell, None, ""),
        (T.clean_cell, "a\nb   c ", "a b c"),
        (T.unwrap, "убедитель- ности", "убедительности"),
        (T.normal_heading, " ЛЕЧЕНИЕ,  общее! ", "лечение общее"),
        (T.topic, "Хирургическое лечение", "хирургическое_лечение"),
        (T.topic, "Лабораторные диагностические исследования", "лабораторная_диагностика"),
        (T.topic, "Классификация заболевания", "классификация"),
        (T.topic, "КЛАССИФИКАЦИЯ болезни", "кодирование"),
        (T.topic, "Критерии оценки", "прочее"),
        (T.topic, None, "прочее"),
    ],
)
def test_functions(spark, fn, value, expected):
    assert apply(spark, fn, value) == expected


@pytest.mark.parametrize(
    "line, fmt, expected",
    [
        ("1.1.Эпидемиология.............23", "A", ("1.1", "Эпидемиология")),
        ("3.3Хирургическое лечение ... 40", "A", ("3.3", "Хирургическое лечение")),
        ("2020 Рекомендации", "B", ("2020", "Рекомендации")),
        ("12345", "B", None),
        ("1.1", "B", None),
        ("Приложение А1 12", "B", None),
    ],
)
def test_toc_entry(spark, line, fmt, expected):
    got = apply(spark, T.toc_entry, line, fmt)
    assert (got and tuple(got)) == expected


def test_case_and_blanks_are_unicode(spark):
    assert apply(spark, lambda c: c.rlike(R.SKIPPED), "СПИСОК ЛИТЕРАТУРЫ")
    assert apply(spark, lambda c: c.rlike(R.DIAGNOSTIC), "КРИТЕРИИ ДИАГНОЗА")
    assert not apply(spark, lambda c: c.rlike(R.TABLE_ENTRY), "3.3Хирургическое")


def test_fragment_of_a_heading(spark):
    assert apply(spark, T.is_fragment, "состояний)…………7", "Краткая информация (группе состояний)")
    assert not apply(spark, T.is_fragment, ".....", "Краткая")


#: For each pattern lines that it finds something in, and lines in which it finds nothing.
EXAMPLES = {
    "TOC_LEADER": (["Введение....5", "Введение . . . 5", "Введение……5"], ["1.1. Введение", "т. е."]),
    "BODY_LEADER": (["Введение....5", "Введение……"], ["Введение . . . 5", "конец."]),
    "PAGE_NUMBER": (["7", "1234"], ["12345", "7 ", "стр. 7", ""]),
    "PLAIN_ENTRY": (["1.1 Эпидемиология 12", "2. Лечение 40"], ["Эпидемиология 12", "1.1 Эпидемиология", "1.1 Эпидемиология 12345"]),
    "SKIPPED": (["Оглавление", "СПИСОК  СОКРАЩЕНИЙ", "Термины и определения", "Приложение А", "Критерии оценки"], ["1. Оглавление", "Список таблиц", "Приложений нет"]),
    "APPENDIX": (["Приложение А1. Состав", "  приложения 2", "Приложений 1 к рекомендациям"], ["Приложение", "См. приложение А"]),
    "TOC_HEADER": (["Оглавление", " СОДЕРЖАНИЕ "], ["Содержание работы", "Оглавление 3"]),
    "TOC_HEADER_OPEN": (["Содержание работы", "Оглавление 3"], ["1 Содержание"]),
    "BULLET": (["• один", "текст; ● два"], ["a•b", "- один"]),
    "DASH": (["- один", "текст – два"], ["-один", "6-8 мг", "- 5 мг"]),
    "NUMBERED": (["1) один", "итог 12. Далее", "2. второй"], ["123) много", "1.Один", "5. 7 мг", "1. one"]),
    "CITATION": (["2020; 5", "Vol. 5", "Ivanov et al", "pp. 20-25", "DOI:10.1", "А. // Б"], ["в 2020 году", "стр. 20"]),
    "ENDS_SEMICOLON": (["один;", "один; "], ["один; два", "один"]),
    "CREDENTIALS": (["к.м.н. Иванов", "доктор медицинских наук"], ["Иванов И.И.", "кмн"]),
    "INSTITUTION": (["гбу москвы", "при минздрав рф"], ["минздрава", "фгбуз"]),
    "DIAGNOSTIC": (["Критерии", "Степени тяжести", "шкала оценки", "признаки воспаления"], ["Показатель", "степень", "шкала боли"]),
    "CAPTION": (["Таблица 1. Общая", "табл 3", "Table 2", "ТАБЛИЦА"], ["Рисунок 1"]),
    "HYPHEN_WRAP": (["убедитель- ности"], ["научно-практический"]),
}


def test_patterns_on_lines(spark):
    cases = [(name, line, want) for name, both in EXAMPLES.items() for want, lines in zip((True, False), both) for line in lines]
    rows = spark.createDataFrame([(k, line) for k, (_, line, _) in enumerate(cases)], "k int, line string")
    found = {r.k: r for r in rows.select("k", *[F.col("line").rlike(getattr(R, n)).alias(n) for n in EXAMPLES]).collect()}
    assert [(n, line, found[k][n]) for k, (n, line, _) in enumerate(cases)] == cases


def test_every_topic(spark):
    headings = {
        "определение": "Определение заболевания", "этиология": "Патогенез", "эпидемиология": "Эпидемиология", "кодирование": "Особенности кодирования по МКБ",
        "классификация": "Классификация", "симптомы": "Клиническая картина", "лабораторная_диагностика": "Лабораторные исследования",
        "инструментальная_диагностика": "Инструментальные исследования", "диагностика": "Физикальное обследование", "хирургическое_лечение": "Хирургическое вмешательство",
        "лечение": "Консервативная терапия", "реабилитация": "Санаторно-курортный этап", "профилактика": "Диспансерное наблюдение",
        "организация": "Организация оказания помощи", "дополнительная_информация": "Дополнительная информация", "осложнения": "Осложнения", "прогноз": "Исходы",
        "прочее": "Состав рабочей группы",
    }
    rows = spark.createDataFrame(list(headings.items()), "topic string, heading string").select("topic", T.topic(F.col("heading")).alias("got"))
    assert all(r.topic == r.got for r in rows.collect()) and {t for t, _ in R.TOPICS} | {R.OTHER_TOPIC} == set(headings)
