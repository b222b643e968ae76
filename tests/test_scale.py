"""What lets the document queries grow with their input: texts are shuffled before they are rendered, and nothing is computed twice."""

import random
import re

import pytest
from conftest import DATA

from foliomill import queries
from foliomill.functions import regex as R
from foliomill.functions import text as T
from pyspark.sql import functions as F


EDGES = r"(?Ud)^\s+|\s+\z"


def plan(spark, name, optimized=False):
    q = queries.QUERIES[name](spark, DATA)._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.executedPlan()).toString().splitlines()


def below(lines, at):
    """The lines of the subtree under a node."""
    depth = lambda x: len(re.match(r"[\s:+\-]*", x).group())
    rest = lines[at + 1 :]
    ends = (i for i, x in enumerate(rest) if re.match(r"[\s:]*[+:]-", x) and depth(x) <= depth(lines[at]))
    return rest[: next(ends, len(rest))]


@pytest.mark.parametrize("name", ["line_predicates", "outline", "section_previews", "page_sections", "list_totals", "dq_list_phrases"])
def test_texts_are_dealt_before_they_are_rendered(spark, name):
    lines = plan(spark, name)
    shuffles = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert shuffles and all(not any("Generate" in x for x in below(lines, i)) for i in shuffles)


@pytest.mark.parametrize("name", ["word_rows", "body_lines", "table_captions"])
def test_words_are_not_shuffled(spark, name):
    """Lines are, by page; each split into words lies above that shuffle."""
    lines = plan(spark, name)
    shuffles = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert shuffles and not any("page_idx" in lines[i] and re.search(r"Generate posexplode.* AS own|Generate posexplode\((split\(line|CASE)", x) for i in shuffles for x in below(lines, i))
    assert not any(x.strip(" :+-").startswith("Sort ") and "word" in x for x in lines)


def test_lists_are_computed_once(spark):
    for name in ("dq_list_phrases", "list_items", "list_totals"):
        assert sum(x.count("•●○▪■►") for x in plan(spark, name, optimized=True)) == 1, name


def test_parts_grow_with_the_files(spark, monkeypatch):
    monkeypatch.setattr("foliomill.plans.rendered.PART_BYTES", 10_000)
    assert queries.QUERIES["list_totals"](spark, DATA).count() > 0
    assert queries.line_trailers(spark, DATA).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("name", ["outline", "section_previews", "section_tables", "page_sections", "line_predicates", "line_trailers", "list_items", "body_lines"])
def test_generated_methods_are_short_enough_to_be_compiled(spark, name):
    """Java leaves methods of more than 8,000 bytes uncompiled; one of 10,041 took 4.6 s for lines that one of 6,693 renders in 1.0 s."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(executed))]
    assert sizes and max(sizes) < 8000


def same(spark, values, *pairs):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for ours, pattern in pairs:
        wrong = df.where(~ours(F.col("s")).eqNullSafe(pattern(F.col("s")))).limit(3).collect()
        assert not wrong, wrong


def test_cheap_tests_agree_with_the_patterns(spark):
    """Over every character of the basic plane, and over random pieces of what the patterns hold."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    odd = [f"{c}х{c}" for c in chars] + chars
    cites = [f"{a}{c}{b}" for c in ("ı", "İ", "ſ", "i", "S", "K") for a in ("do", "", "I") for b in (":", "bn", "SBN")]
    rng = random.Random(3)
    bits = ["1", "12", "1234", "٣", ".", "..", "...", "…", "……", " ", "  ", "\t", "\xa0", "\n", ";", "а", "b", "Слово", "pp.", "P. 3", "Vol.", "et al", "// ", "DOI:", "isbn", "Таблица", "ᲄабл.", "TABLE", "диагноз", "Оглавление", "ПРИЛОЖЕНИЕ", "Список сокращений", "1.2", "3. 4", ";", "- ", " – Да", "1) ", " 12. Шаг", "٣) b", "\n"]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(30_000)]
    stripped = lambda f: lambda s: f(T.strip(s))
    regex_strip = lambda s: F.regexp_replace(s, EDGES, "")
    collapsed = lambda s: regex_strip(F.regexp_replace(s, R.SPACE, " "))
    like = lambda p: lambda s: regex_strip(s).rlike(p)
    lines = T.stripped(spark.createDataFrame([(v,) for v in [*odd, *mixed]], "text string"))
    assert lines.where(F.col("s") != regex_strip(F.col("text"))).count() == 0
    same(spark, [*odd, *mixed, "", None, *cites],
        (T.strip, regex_strip), (T.collapse, collapsed), (T.is_leader, lambda s: s.rlike(R.BODY_LEADER)), (T.is_page_number, lambda s: s.rlike(R.PAGE_NUMBER)),
        (T.strip_dots, lambda s: regex_strip(F.regexp_replace(s, R.TRAILER_DOTS, ""))), (T.strip_page, lambda s: regex_strip(F.regexp_replace(s, R.TRAILER_PAGE, ""))),
        (T.clean_item, lambda s: regex_strip(F.regexp_replace(collapsed(s), R.LAST_SEMICOLON, ""))),
        *[(lambda s, p=p: F.split(s, p, -1), lambda s, q=q: F.split(s, q, -1)) for p, q in ((R.DASH_FIRST, R.DASH), (R.DIGIT_FIRST, R.NUMBERED))],
        *[(stripped(queries.TESTED[n]), like(p)) for n, p in queries.PREDICATES.items()],
    )
