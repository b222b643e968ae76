"""Paginated guideline documents rendered from the plain test tables, in SQL that Spark and DuckDB both run.

The test tables hold no contents pages, list marks or table grids. Each text becomes a document: a cover, a table of
contents with an entry for every line of the text, and body pages on which every line follows its heading. Words get
positions and fonts, orders become table grids. Only the views that split texts or build arrays differ by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = (
    "Определение", "Этиология и патогенез", "Эпидемиология", "Кодирование по МКБ", "Классификация", "Клиническая картина", "Лабораторные исследования",
    "Инструментальные исследования", "Диагностика", "Хирургическое лечение", "Лечение", "Реабилитация", "Профилактика", "Организация помощи",
    "Дополнительная информация", "Осложнения", "Прогноз",
)

_SPARK_LINES = r"""
doc_lines AS (
  SELECT doc_id, i, line, substring_index(line, ' ', 3) AS lead, substr(substring_index(line, ' ', 6), length(substring_index(line, ' ', 3)) + 2) AS mid, n
  FROM (SELECT doc_id, l, size(l) AS n FROM (SELECT doc_id, split(coalesce(text, ''), '\n') AS l FROM documents WHERE doc_id IS NOT NULL))
  LATERAL VIEW posexplode(l) t AS i, line
)"""
_DUCK_LINES = r"""
doc_lines AS (
  SELECT doc_id, CAST(i AS INT) AS i, line, array_to_string(string_split(line, ' ')[1:3], ' ') AS lead, array_to_string(string_split(line, ' ')[4:6], ' ') AS mid, n
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i, len(l) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL))
)"""
# lines are dealt by page before they are split: their words, many times as large, are not
_SPARK_WORDS = r"""
page_lines AS (
  SELECT /*+ REPARTITION(PARTS, doc_id, page_idx) */ * FROM (SELECT doc_id, CAST((i - i % 5) / 5 AS INT) AS page_idx, i, line FROM doc_lines)
)"""
_DUCK_WORDS = r"""
doc_words AS (
  SELECT * FROM (SELECT doc_id, i, unnest(l) AS word, CAST(generate_subscripts(l, 1) - 1 AS INT) AS w
                 FROM (SELECT doc_id, i, string_split(line, ' ') AS l FROM doc_lines)) WHERE word <> ''
)"""

_KEYWORD = "CASE (doc_id + i) % 17 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(KEYWORDS)) + " END"

ENTRIES = f"""
entries AS (
  SELECT doc_id, i, n, line, lead, mid, CAST((i - i % 4) / 4 AS INT) + 1 AS ch, i % 4 AS sub,
         CASE WHEN i % 4 = 0 THEN CAST(CAST((i - i % 4) / 4 AS INT) + 1 AS STRING)
              ELSE CAST(CAST((i - i % 4) / 4 AS INT) + 1 AS STRING) || '.' || CAST(i % 4 AS STRING) END AS number,
         {_KEYWORD} || ' ' || lead AS title, (doc_id + i) % 3 = 0 AND mid <> '' AS wrapped
  FROM doc_lines
)"""

_TOC_PAGE, _BODY_PAGE = "1 + CAST((i - i % 24) / 24 AS INT)", "1000 + CAST((i - i % 5) / 5 AS INT)"
_TOC_LINE, _BODY_LINE = "(i % 24) * 4", "(i % 5) * 10"
_PAGE_NO = "CAST(i + 5 AS STRING)"
#: Lines that an entry gives rise to: page, place on the page, text, bold, size, and when.
_RENDERED = (
    ("0", "0", "'Клинические рекомендации'", "TRUE", "16.0", "i = 0"),
    ("0", "1", "lead", "FALSE", "11.0", "i = 0"),
    ("1", "0", "'Оглавление'", "TRUE", "14.0", "i = 0"),
    ("1", "1", "'Список сокращений ............ 3'", "FALSE", "11.0", "i = 0"),
    (
        _TOC_PAGE, f"10 + {_TOC_LINE}",
        "CASE WHEN i % 7 = 3 AND sub > 0 THEN CAST(ch AS STRING) || '. ' || CAST(sub AS STRING) ELSE number END"
        " || CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE ' ' END || title"
        f" || CASE WHEN wrapped THEN '' WHEN doc_id % 2 = 0 THEN ' ............ ' || {_PAGE_NO} ELSE ' ' || {_PAGE_NO} END",
        "FALSE", "11.0", "TRUE",
    ),
    (_TOC_PAGE, f"11 + {_TOC_LINE}", f"mid || CASE WHEN doc_id % 2 = 0 THEN ' ........... ' ELSE ' ' END || {_PAGE_NO}", "FALSE", "11.0", "wrapped"),
    (_TOC_PAGE, f"12 + {_TOC_LINE}", f"number || ' ' || title || ' ...... ' || {_PAGE_NO}", "FALSE", "11.0", "doc_id % 10 = 0 AND i % 24 = 1"),
    (
        _TOC_PAGE, "200", "CASE WHEN doc_id % 4 = 1 THEN 'Приложений 1 к рекомендациям' ELSE 'Приложение А1. Состав рабочей группы' END",
        "FALSE", "11.0", "i = n - 1",
    ),
    (_BODY_PAGE, "0", "CAST(ch AS STRING) || '. Раздел ' || CAST(ch AS STRING)", "TRUE", "9.0", "i % 5 = 0 AND doc_id % 3 = 1"),
    (
        _BODY_PAGE, f"10 + {_BODY_LINE}",
        "CASE WHEN doc_id % 11 = 0 AND i % 5 = 2 THEN '99.9 ' WHEN doc_id % 2 = 0 THEN number || '. ' ELSE number || ' ' END || title",
        "i % 6 <> 1", "14.0", "TRUE",
    ),
    (_BODY_PAGE, f"11 + {_BODY_LINE}", "mid", "TRUE", "14.0", "wrapped"),
    (_BODY_PAGE, f"12 + {_BODY_LINE}", "line", "FALSE", "11.0", "TRUE"),
    (_BODY_PAGE, f"13 + {_BODY_LINE}", "'.......... 12'", "FALSE", "11.0", "i % 9 = 4"),
    (_BODY_PAGE, f"14 + {_BODY_LINE}", "'1) ' || lead", "FALSE", "11.0", "i % 6 = 5"),
    (_BODY_PAGE, f"15 + {_BODY_LINE}", "mid", "TRUE", "11.0", "i % 4 = 2 AND mid <> ''"),
    (_BODY_PAGE, "90", _PAGE_NO, "FALSE", "11.0", "i % 5 = 0"),
)
_FIELDS = ("page_idx", "ord", "text", "bold", "size")


def _by_kind(field: int) -> str:
    """A field of each kind of line; equal neighbours share a branch, which keeps the generated method short enough to be compiled."""
    values = [f"CAST({x[field]} AS DOUBLE)" if field == 4 else x[field] for x in _RENDERED]
    last = [k for k in range(len(values)) if k + 1 == len(values) or values[k + 1] != values[k]]
    return "CASE " + " ".join(f"WHEN kind <= {k} THEN {values[k]}" for k in last[:-1]) + f" ELSE {values[-1]} END"


# one pass over the entries in Spark, which makes the text of the kinds that apply only; a branch for each kind of line in DuckDB
_SPARK_RAW = f"""
raw_lines AS (
  SELECT doc_id, {", ".join(f"{_by_kind(k)} AS {n}" for k, n in enumerate(_FIELDS))}
  FROM entries LATERAL VIEW explode(array({", ".join(map(str, range(len(_RENDERED))))})) t AS kind WHERE {_by_kind(5)}
)"""
_DUCK_RAW = f"""
raw_lines AS ({" UNION ALL ".join(f"SELECT doc_id, {', '.join(f'{v} AS {n}' for n, v in zip(_FIELDS, x))} FROM entries WHERE {x[5]}" for x in _RENDERED)})"""
LINES = """
text_lines AS (
  SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY ord) - 1 AS INT) AS line_no,
         text, bold, CAST(size AS DOUBLE) AS size FROM raw_lines
)"""

_DUCK_PLACED = """
words AS (
  SELECT doc_id, CAST((i - i % 5) / 5 AS INT) AS page_idx, (i % 5) * 100000 + w AS word_idx, word AS text,
         CAST(7 * w - 10 * (w % 3) AS DOUBLE) AS x0, CAST(14 * (i % 5) AS DOUBLE) + CAST(0.7 AS DOUBLE) * (w % 4) AS top,
         CAST(14 * (i % 5) AS DOUBLE) + CAST(0.7 AS DOUBLE) * (w % 4) + 10 AS bottom,
         CASE WHEN (i + w) % 5 < 3 THEN 'TimesNewRoman' ELSE 'TimesNewRoman-BoldMT' END AS fontname, CAST(10.5 AS DOUBLE) + (i + w) % 4 AS size
  FROM doc_words
  UNION ALL
  SELECT doc_id, CAST((i - i % 5) / 5 AS INT), i % 5 * 100000 + 99998 + k, CASE WHEN k = 0 THEN 'Таблица' ELSE CAST(i + 1 AS STRING) || '.' END,
         CAST(k * 40 - 100 AS DOUBLE), CAST(14 * (i % 5) AS DOUBLE) + 1, CAST(14 * (i % 5) AS DOUBLE) + 11, 'TimesNewRoman-BoldMT', CAST(11 AS DOUBLE)
  FROM doc_lines CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) q WHERE i % 10 = 2
)"""
# one pass over the lines: the two words of a caption, where k >= 0, follow a line's own
_SPARK_PLACED = """
words AS (
  SELECT doc_id, page_idx, CASE WHEN k < 0 THEN (i % 5) * 100000 + w ELSE i % 5 * 100000 + 99998 + k END AS word_idx, word AS text,
         CASE WHEN k < 0 THEN CAST(7 * w - 10 * (w % 3) AS DOUBLE) ELSE CAST(k * 40 - 100 AS DOUBLE) END AS x0,
         CAST(14 * (i % 5) AS DOUBLE) + CASE WHEN k < 0 THEN CAST(0.7 AS DOUBLE) * (w % 4) ELSE 1 END AS top,
         CASE WHEN k < 0 THEN CAST(14 * (i % 5) AS DOUBLE) + CAST(0.7 AS DOUBLE) * (w % 4) + 10 ELSE CAST(14 * (i % 5) AS DOUBLE) + 11 END AS bottom,
         CASE WHEN k < 0 AND (i + w) % 5 < 3 THEN 'TimesNewRoman' ELSE 'TimesNewRoman-BoldMT' END AS fontname,
         CASE WHEN k < 0 THEN CAST(10.5 AS DOUBLE) + (i + w) % 4 ELSE CAST(11 AS DOUBLE) END AS size
  FROM (
    SELECT doc_id, page_idx, i, w, word, w - m AS k
    FROM (SELECT doc_id, page_idx, i, size(split(line, ' ')) AS m, split(line, ' ') AS own FROM page_lines)
    LATERAL VIEW posexplode(CASE WHEN i % 10 = 2 THEN concat(own, array('Таблица', CAST(i + 1 AS STRING) || '.')) ELSE own END) t AS w, word
    WHERE w >= m OR word <> ''
  )
)"""

CONTENT = """
content AS (
  SELECT doc_id, i AS sec, title AS heading,
    CASE doc_id % 8
      WHEN 0 THEN 'Причины: • ' || line || '; • ' || title || '; • ' || mid || ' ' || lead || '.'
      WHEN 1 THEN 'Формы: - ' || line || '; - ' || title || '; - ' || lead || ' ' || mid || '.'
      WHEN 2 THEN 'На основании: 1) ' || line || '; 2) ' || title || '; 3) ' || mid || '.'
      WHEN 3 THEN title || ' – ' || line || '. ' || title || ' – ' || lead || '.'
      WHEN 4 THEN '1. Автор А. // ' || line || '. 2020; Vol. 5. 2. Автор Б. doi:10.1/' || lead || ' 3. Автор В. 2021. pp. 20-25.'
      WHEN 5 THEN 'Признаки: • ' || line || '; • ' || lead || ' ' || mid || '. Далее: 1) ' || title || '; 2) ' || line || '.'
      WHEN 6 THEN '1. Шаг ' || line || ' 2. Шаг ' || title || ' 3. Шаг ' || lead
      ELSE line END AS content
  FROM entries
)"""

GRID = """
cells AS (
  SELECT o_orderkey AS k, 0 AS r,
    CASE o_orderkey % 8 WHEN 0 THEN 'Критерий' WHEN 1 THEN 'УУР' WHEN 2 THEN 'Критерии диагноза' WHEN 3 THEN 'Уровень' WHEN 5 THEN 'Критерии каче- ства' ELSE 'Показатель' END AS a,
    CASE o_orderkey % 8 WHEN 0 THEN 'да/нет' WHEN 1 THEN 'Расшифровка' WHEN 5 THEN 'УУР' ELSE 'Значение  ' || o_orderpriority END AS b, o_orderstatus AS c
  FROM orders
  UNION ALL
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 8 = 6 AND l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag || '-' || CAST(l_linenumber AS STRING) END,
    CASE WHEN l_orderkey % 8 = 4 THEN '' WHEN l_orderkey % 8 = 7 AND l_linenumber > 2 THEN NULL ELSE ' ' || l_linestatus || '  ' || CAST(l_partkey AS STRING) END,
    CASE WHEN l_orderkey % 8 IN (3, 6) THEN '' ELSE CAST(l_suppkey AS STRING) END
  FROM lineitem
)"""
_SPARK_GRID = """
grids AS (
  SELECT k, transform(array_sort(collect_list(struct(r, x))), y -> y.x) AS rows FROM (
    SELECT k, r, CASE WHEN k % 8 = 2 THEN array(a) WHEN k % 8 IN (1, 4) THEN array(a, b) WHEN k % 8 = 7 AND r % 2 = 1 THEN array(a, b) ELSE array(a, b, c) END AS x FROM cells
  ) GROUP BY k
)"""
_DUCK_GRID = """
grids AS (
  SELECT k, list(CASE WHEN k % 8 = 2 THEN [a] WHEN k % 8 IN (1, 4) THEN [a, b] WHEN k % 8 = 7 AND r % 2 = 1 THEN [a, b] ELSE [a, b, c] END ORDER BY r, a NULLS FIRST, b NULLS FIRST, c NULLS FIRST) AS rows
  FROM cells GROUP BY k
)"""

#: Grid k belongs to the document whose number is k modulo the number of documents ``DOCS`` (these count from 0), and goes
#: round its pages.
PLACED = """
slots AS (SELECT doc_id, max(CAST((i - i % 5) / 5 AS INT)) + 1 AS pages FROM doc_lines GROUP BY doc_id),
dealt AS (SELECT k, rows, k % DOCS AS r, CAST((k - k % DOCS) / DOCS AS BIGINT) AS q FROM grids),
placed AS (
  SELECT s.doc_id, CAST(d.q % s.pages AS INT) AS page_idx, CAST((d.q - d.q % s.pages) / s.pages AS INT) AS table_idx, CAST(43.5 AS DOUBLE) AS top, d.k, d.rows
  FROM dealt d JOIN slots s ON s.doc_id % DOCS = d.r
)"""

#: The views that each view stands on, in order.
NEEDS = {
    "entries": ("lines", "ENTRIES"),
    "text_lines": ("lines", "ENTRIES", "raw", "LINES"),
    "words": ("lines", "words", "placing"),
    "content": ("lines", "ENTRIES", "CONTENT"),
    "grids": ("GRID", "grid"),
    "placed": ("lines", "GRID", "grid", "PLACED"),
}


def _parts(view: str, spark: bool) -> list[str]:
    own = {"lines": (_DUCK_LINES, _SPARK_LINES), "raw": (_DUCK_RAW, _SPARK_RAW), "words": (_DUCK_WORDS, _SPARK_WORDS), "grid": (_DUCK_GRID, _SPARK_GRID), "placing": (_DUCK_PLACED, _SPARK_PLACED)}
    common = {"ENTRIES": ENTRIES, "LINES": LINES, "CONTENT": CONTENT, "GRID": GRID, "PLACED": PLACED}
    return [own[p][spark] if p in own else common[p] for p in NEEDS[view]]


def duck(*views: str) -> str:
    """The views as common table expressions in DuckDB's dialect (without ``WITH``)."""
    parts: list[str] = []
    for v in views:
        parts += [p for p in _parts(v, False) if p not in parts]
    return ",".join(parts).replace("DOCS", "(SELECT count(*) FROM slots)")


#: Views whose texts are dealt by document before they are rendered, so nothing of theirs that goes by document is shuffled later.
DEALT = ("text_lines", "content")
#: Bytes of the documents' files for each part, whose rendered lines or words a task sorts in memory.
PART_BYTES = 4 << 20


def _parts_of(spark: SparkSession, documents: DataFrame) -> int:
    """Parts into which texts are dealt: they grow with the files, whatever the setting."""
    files = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files // PART_BYTES))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rendered view over the whole tables at ``sf_dir``."""
    sql = f"WITH {','.join(_parts(name, True))} SELECT * FROM {name}"
    if "DOCS" in sql:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id").distinct().count()
        sql = sql.replace("DOCS", str(max(1, docs)))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "orders", "lineitem") if f" {t}" in sql}
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    if name in DEALT:
        tables["documents"] = tables["documents"].where("doc_id is not null").select("doc_id", "text").repartition(_parts_of(spark, tables["documents"]), "doc_id")
    if "PARTS" in sql:
        sql = sql.replace("PARTS", str(_parts_of(spark, tables["documents"])))
    return spark.sql(sql, **tables)


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables on body pages: every grid lands on one page."""
    boxes = F.struct(F.lit(0.0).alias("x0"), F.lit(43.5).alias("top"), F.lit(500.0).alias("x1"), F.lit(90.0).alias("bottom"))
    return view(spark, sf_dir, "placed").select("doc_id", "page_idx", "table_idx", boxes.alias("bbox"), "rows")
