import random

import pytest

from foliomill.operators import quality, sections, toc

LINES = "doc_id string, page_idx int, line_no int, text string, bold boolean, size double"


def headings(spark, *numbers, titles=None):
    rows = [("d", i, f"H{n.count('.') + 1}", n.count(".") + 1, n, (titles or {}).get(n, f"Глава {n}")) for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "doc_id string, pos int, level string, depth int, number string, text string")


def body(spark, *lines):
    rows = [("d", 5, i, x if isinstance(x, str) else x[0], not isinstance(x, str), 11.0) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, LINES)


def opened(spark, toc_numbers, lines, titles=None):
    got = sections.sections(body(spark, *lines), headings(spark, *toc_numbers, titles=titles)).orderBy("sec_pos").collect()
    return {r.number: r.content for r in got}, [r.number for r in got]


TOC = ("1", "1.1", "1.2", "2", "2.1")


@pytest.mark.parametrize(
    "order, expected",
    [
        (("1", "1.1", "2", "1.2", "2", "2.1"), ["1", "1.1", "1.2", "2", "2.1"]),
        (("1", "1.1", "2.1", "2"), ["1", "1.1", "2.1", "2"]),
        (("2", "1"), ["1"]),
    ],
)
def test_tracker(spark, order, expected):
    assert opened(spark, TOC, [f"{n} Заголовок" for n in order])[1] == expected


def test_running_header_is_content_and_keeps_the_tail(spark):
    got, _ = opened(spark, TOC, [("1 Глава",), ("2 Раздел",), ("Глава 1",), "текст", ("Глава 1",)])
    assert got == {"1": "2 Раздел текст Глава 1"}


def test_text_match_needs_a_heading_font(spark):
    titles = {"3.1": "Консервативное лечение"}
    assert opened(spark, ("3", "3.1"), ["3 Лечение", ("3.4 Консервативное лечение",)], titles)[1] == ["3", "3.1"]
    got, order = opened(spark, ("3", "3.1"), ["3 Лечение", "3.4 Консервативное лечение"], titles)
    assert order == ["3"] and got["3"] == "3.4 Консервативное лечение"


def test_wrapped_heading_lines_go_and_later_bold_stays(spark):
    got, _ = opened(spark, ("1",), ["1 Краткая информация", ("по заболеванию",), ("Важно",), ("по заболеванию",)], {"1": "Краткая информация по заболеванию"})
    assert got == {"1": "Важно по заболеванию"}


def loop(toc_numbers, lines):
    """A straight reading of the tracker's rules for lines that are bare numbers in a plain font."""
    left, cur, out = list(dict.fromkeys(toc_numbers)), 0, []
    place = {n: i for i, n in enumerate(toc_numbers)}
    for n in lines:
        if n not in left:
            continue
        if "." not in n and place[n] > cur and any(m in left for m in toc_numbers[cur : place[n]]):
            continue
        left.remove(n)
        cur = place[n] + 1
        out.append(n)
    return out


def test_tracker_against_a_loop(spark):
    rng = random.Random(4)
    for _ in range(6):
        numbers = [f"{c}" if s == 0 else f"{c}.{s}" for c in range(1, 4) for s in range(rng.randint(1, 3))]
        lines = [rng.choice(numbers) for _ in range(15)]
        assert opened(spark, numbers, [f"{n} слово" for n in lines])[1] == loop(numbers, lines)


def toc_of(spark, *pages):
    rows = [("d", p, i, t) for p, ts in enumerate(pages) for i, t in enumerate(ts)]
    got = toc.headings(spark.createDataFrame(rows, "doc_id string, page_idx int, line_no int, text string")).orderBy("pos").collect()
    return [(r.number, r.text) for r in got]


def test_wrapped_entry_ends_with_its_leaders(spark):
    got = toc_of(spark, ["Оглавление", "1. Краткая информация (группе", "состояний) ............6", "1.1 Определение ..... 7", "1.2 Этиология ..... 8", "лишнее"])
    # leaders of the entry's own line do not close it
    assert got == [("1", "Краткая информация (группе состояний)"), ("1.1", "Определение"), ("1.2", "Этиология лишнее")]


def test_appendix_ends_the_contents(spark):
    head = ["Оглавление", "1 Введение 5"]
    assert toc_of(spark, [*head, "Приложение А1", "2 Лечение 9"]) == [("1", "Введение")]
    # an appendix line that is met within an entry discards it
    assert toc_of(spark, [*head, "2 Лечение", "Приложений 1", "3 Прогноз 9"]) == [("1", "Введение")]


def test_contents_end_at_a_page_without_format(spark):
    toc_page = ["1 Введение 5", "2 Лечение 9", "3 Прогноз 11"]
    assert [n for n, _ in toc_of(spark, ["обложка"], toc_page, ["текст"], ["4 Иное 1", "5 Иное 2", "6 Иное 3"])] == ["1", "2", "3"]


def test_dedup_and_outline(spark):
    h = headings(spark, "1", "1.1", "1", "1.1")
    assert [r.line for r in toc.outline(toc.deduplicated(h)).orderBy("pos").collect()] == ["[H1]  1. Глава 1", "  [H2]  1.1. Глава 1.1"]


def test_page_sections_carry_on(spark):
    rows = [("d", 0, 0, "обложка", True, 11.0), ("d", 1, 0, "1 Глава", True, 11.0), ("d", 2, 0, "текст", False, 11.0), ("d", 3, 0, "1.1 Глава", True, 11.0), ("d", 3, 1, "1.2Глава", True, 11.0)]
    got = sections.page_sections(spark.createDataFrame(rows, LINES), headings(spark, "1", "1.1", "1.2")).orderBy("page_idx").collect()
    assert [r.number for r in got] == [None, "1", "1", "1.1"]


def test_checks(spark):
    h = headings(spark, "1", "1.1", "2")
    rows = [("d", 0, "2", "h", "a"), ("d", 1, "1", "h", None), ("d", 2, "1", "h....", "b"), ("d", 3, "9", "h", " ... c")]
    s = spark.createDataFrame(rows, "doc_id string, sec_pos int, number string, heading string, content string")
    pos = lambda df: sorted(r.sec_pos for r in df.collect())
    assert pos(quality.duplicate_numbers(s)) == [2]
    assert pos(quality.order_violations(s, h)) == [1]
    assert pos(quality.leader_bleed(s)) == [2, 3]
    assert pos(quality.null_contents(s)) == [1]
    assert pos(quality.not_in_contents(s, h)) == [3]
    checks = spark.createDataFrame([("d", "1", "B"), ("d", "9", "zz")], "doc_id string, section string, phrase string")
    assert {(r.section, r.found) for r in quality.phrase_found(s, checks).collect()} == {("1", True), ("9", False)}
