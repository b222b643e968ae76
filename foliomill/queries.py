"""Registered queries of the document operators over rendered views of whole tables; outputs are flat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import regex as R
from .functions import text as T
from .operators import lines, lists, quality, sections, tables, toc
from .plans import rendered


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


KEY = ("doc_id", "page_idx", "line_no")


def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    s = T.normalize_line(T.strip(F.col("text")))
    rows = rendered.view(spark, sf, "text_lines").withColumn("line", s).where(F.col("line").rlike(R.BODY_ENTRY))
    rows = rows.withColumn("number", T.normalize_number(F.regexp_extract("line", R.BODY_ENTRY, 1)))
    return rows.select(*_long(*KEY), "line", "number", T.depth(F.col("number")).cast("long").alias("depth"), T.level(F.col("number")).alias("level"))


def line_trailers(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return rendered.view(spark, sf, "text_lines").select(*_long(*KEY), T.strip_dots(t).alias("without_dots"), T.strip_page(t).alias("without_page"), T.collapse(t).alias("clean"))


PREDICATES = {
    "toc_leader": R.TOC_LEADER, "body_leader": R.BODY_LEADER, "page_number": R.PAGE_NUMBER, "plain_entry": R.PLAIN_ENTRY, "skipped": R.SKIPPED,
    "appendix": R.APPENDIX, "toc_header": R.TOC_HEADER, "citation": R.CITATION, "diagnostic": R.DIAGNOSTIC, "caption": R.CAPTION,
}
#: The same as functions of a stripped line, with cheaper tests before the patterns.
TESTED = {
    "toc_leader": T.is_toc_leader, "body_leader": T.is_leader, "page_number": T.is_page_number, "plain_entry": T.is_plain_entry, "skipped": T.is_skipped_line,
    "appendix": T.is_appendix, "toc_header": T.is_toc_header, "citation": T.is_citation, "diagnostic": T.is_diagnostic, "caption": T.is_caption,
}


def line_predicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.stripped(rendered.view(spark, sf, "text_lines"))
    return rows.select(*_long(*KEY), *[test(F.col("s")).cast("long").alias(n) for n, test in TESTED.items()])


def heading_entries(spark: SparkSession, sf: str) -> DataFrame:
    s = T.strip(F.col("text"))
    rows = rendered.view(spark, sf, "text_lines").withColumn("s", s)
    part = lambda p, k: F.regexp_extract("s", p, k)
    return rows.where(F.col("s").rlike(r"(?Ud)^\d")).select(
        *_long(*KEY), part(R.TOC_ENTRY, 1).alias("toc_number"), part(R.TOC_ENTRY, 2).alias("toc_rest"), part(R.BODY_ENTRY, 2).alias("body_rest"),
        part(R.TABLE_ENTRY, 1).alias("table_number"), part(R.TABLE_ENTRY, 2).alias("table_rest"), T.normal_heading(part(R.BODY_ENTRY, 2)).alias("normal"),
    )


def topics(spark: SparkSession, sf: str) -> DataFrame:
    rows = rendered.view(spark, sf, "content")
    return rows.select(*_long("doc_id", "sec"), T.topic(F.col("heading")).alias("topic"))


def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.word_rows(rendered.view(spark, sf, "words"))
    return rows.select(*_long("doc_id", "page_idx", "word_idx", "row_no"), "text")


def body_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.body_lines(rendered.view(spark, sf, "words"))
    return rows.select(*_long(*KEY), "text", F.col("bold").cast("long").alias("bold"), "size", "font")


def page_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = rendered.view(spark, sf, "text_lines")
    both = lines.toc_class(rows).join(lines.body_toc_pages(rows), ["doc_id", "page_idx"])
    return both.select(*_long("doc_id", "page_idx"), "fmt", F.col("is_toc").cast("long").alias("is_toc"))


def _headings(spark: SparkSession, sf: str) -> DataFrame:
    return toc.headings(rendered.view(spark, sf, "text_lines"), dealt=True)


def headings(spark: SparkSession, sf: str) -> DataFrame:
    return _headings(spark, sf).select(*_long("doc_id", "pos", "depth"), "level", "number", "text")


def unique_headings(spark: SparkSession, sf: str) -> DataFrame:
    return toc.deduplicated(_headings(spark, sf)).select(*_long("doc_id", "pos", "depth"), "level", "number", "text")


def level_summary(spark: SparkSession, sf: str) -> DataFrame:
    return toc.level_summary(_headings(spark, sf)).select(*_long("doc_id", "n"), "level")


def outline(spark: SparkSession, sf: str) -> DataFrame:
    return toc.outline(toc.deduplicated(_headings(spark, sf))).select(*_long("doc_id", "pos"), "line")


def _body(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = rendered.view(spark, sf, "text_lines")
    return rows, toc.deduplicated(toc.headings(rows, dealt=True))


def section_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    rows, found = _body(spark, sf)
    return sections.boundaries(rows, found, dealt=True).select(*_long("doc_id", "seq"), "kind", "number")


def section_contents(spark: SparkSession, sf: str) -> DataFrame:
    rows, found = _body(spark, sf)
    return sections.sections(rows, found, dealt=True).select(*_long("doc_id", "sec_pos", "depth"), "level", "number", "heading", "content")


def section_previews(spark: SparkSession, sf: str) -> DataFrame:
    rows, found = _body(spark, sf)
    return sections.previews(sections.sections(rows, found, dealt=True)).select(*_long("doc_id", "sec_pos"), "line", "preview")


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return lists.with_lists(rendered.view(spark, sf, "content"))


def list_items(spark: SparkSession, sf: str) -> DataFrame:
    # outer, and filtered afterwards: else the optimizer would compute the lists once more for a filter of its own
    each = _lists(spark, sf).select("doc_id", "sec", F.posexplode_outer("lists").alias("list_no", "l")).where("list_no is not null")
    each = each.select("doc_id", "sec", "list_no", F.col("l.type").alias("kind"), F.col("l.topic").alias("topic"), F.posexplode("l.items").alias("item_no", "item"))
    return each.select(*_long("doc_id", "sec", "list_no", "item_no"), "kind", "topic", "item")


def list_totals(spark: SparkSession, sf: str) -> DataFrame:
    return lists.list_totals(_lists(spark, sf)).select(*_long("doc_id", "n_lists", "n_items"))


def table_classes(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("rows")
    flags = {"artifact": tables.is_artifact(r), "checklist": tables.is_checklist(r), "legend": tables.is_legend(r), "wrapped": tables.is_wrapped_text(r), "skipped": tables.is_skipped(r)}
    flags["kept"] = ~tables.is_skipped(r) & tables.keeps_width(tables.clean_rows(r))
    return rendered.view(spark, sf, "grids").select(*_long("k"), *[v.cast("long").alias(n) for n, v in flags.items()])


def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = rendered.view(spark, sf, "grids").select("k", F.posexplode(tables.clean_rows(F.col("rows"))).alias("row", "c"))
    return rows.select("k", "row", F.posexplode("c").alias("col", "cell")).select(*_long("k", "row", "col"), "cell")


def table_captions(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.captions(rendered.page_tables(spark, sf), rendered.view(spark, sf, "words"))
    return found.select(*_long("doc_id", "page_idx", "table_idx"), "caption")


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sections.page_sections(*_body(spark, sf), dealt=True).select(*_long("doc_id", "page_idx"), "number")


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with lists and tables; the body's pages are moved onto the tables' page numbers, so words stay where they are."""
    rows, found = _body(spark, sf)
    body = rows.withColumn("page_idx", F.col("page_idx") - 1000)
    return lists.with_lists(tables.annotated(body, found, rendered.page_tables(spark, sf), rendered.view(spark, sf, "words"), dealt=True))


def section_tables(spark: SparkSession, sf: str) -> DataFrame:
    each = _annotated(spark, sf).select("doc_id", "sec_pos", "number", F.posexplode_outer("tables").alias("table_no", "t")).where("table_no is not null")
    cells = F.size(F.flatten("t.rows"))
    return each.select(*_long("doc_id", "sec_pos", "table_no"), "number", F.col("t.caption").alias("caption"), F.size("t.rows").cast("long").alias("n_rows"), cells.cast("long").alias("n_cells"))


def table_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table_totals(_annotated(spark, sf)).select(*_long("doc_id", "n_tables"))


def _toc_as_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _headings(spark, sf).withColumnsRenamed({"pos": "sec_pos", "text": "heading"}).withColumn("content", F.col("heading"))


def _entries_as_sections(spark: SparkSession, sf: str) -> DataFrame:
    e = rendered.view(spark, sf, "entries")
    return e.select("doc_id", F.col("i").alias("sec_pos"), "number", F.col("title").alias("heading"), F.when((F.col("line") != "") & (F.col("i") % 13 != 7), F.concat(F.when(F.col("i") % 9 == 4, " ..... ").otherwise(""), "line")).alias("content"))


def dq_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_numbers(_toc_as_sections(spark, sf)).select(*_long("doc_id", "sec_pos"), "number")


def dq_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth document's sections stand in reverse."""
    found = _toc_as_sections(spark, sf).withColumn("sec_pos", F.when(F.col("doc_id") % 5 == 0, -F.col("sec_pos")).otherwise(F.col("sec_pos")))
    rows = quality.order_violations(found, _headings(spark, sf))
    return rows.select(*_long("doc_id", "sec_pos", "pos", "ahead"), "number")


def dq_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return quality.leader_bleed(_entries_as_sections(spark, sf)).select(*_long("doc_id", "sec_pos"), "number")


def dq_null_contents(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_contents(_entries_as_sections(spark, sf)).select(*_long("doc_id", "sec_pos"), "number")


def dq_not_in_contents(spark: SparkSession, sf: str) -> DataFrame:
    return quality.not_in_contents(_entries_as_sections(spark, sf), _headings(spark, sf)).select(*_long("doc_id", "sec_pos"), "number")


def dq_phrases(spark: SparkSession, sf: str) -> DataFrame:
    e = rendered.view(spark, sf, "entries").where("lead <> ''")
    checks = e.select("doc_id", F.col("ch").cast("string").alias("section"), F.col("lead").alias("phrase")).distinct()
    found = quality.phrase_found(_entries_as_sections(spark, sf), checks)
    return found.select(*_long("doc_id"), "section", "phrase", F.col("found").cast("long").alias("found"))


def dq_leaked_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every grid as the one table of a section, with no filter before."""
    one = F.array(F.struct(F.lit(None).cast("string").alias("caption"), F.col("rows").alias("rows")))
    rows = rendered.view(spark, sf, "grids").select(F.col("k").alias("doc_id"), F.lit(0).alias("sec_pos"), one.alias("tables"))
    return quality.leaked_tables(rows).select(*_long("doc_id", "sec_pos", "n"))


def dq_list_phrases(spark: SparkSession, sf: str) -> DataFrame:
    # null without lists, and filtered afterwards: a filter of the lists would compute them once more
    found = F.when(F.size("lists") > 0, F.struct(quality.phrase_in_lists(F.col("lists"), F.col("heading")).cast("long").alias("found")))
    rows = _lists(spark, sf).select("doc_id", "sec", F.explode(F.array(found)).alias("x")).where("x is not null")
    return rows.select(*_long("doc_id", "sec"), "x.found")


def dq_table_phrases(spark: SparkSession, sf: str) -> DataFrame:
    one = F.array(F.struct(F.lit(None).cast("string").alias("caption"), tables.clean_rows(F.col("rows")).alias("rows")))
    return rendered.view(spark, sf, "grids").select(*_long("k"), quality.phrase_in_tables(one, F.lit("ДИАГНОЗ")).cast("long").alias("found"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        line_numbers, line_trailers, line_predicates, heading_entries, topics, word_rows, body_lines, page_classes, headings, unique_headings,
        level_summary, outline, section_boundaries, section_contents, section_previews, list_items, list_totals, table_classes, table_cells,
        table_captions, page_sections, section_tables, table_totals, dq_duplicates, dq_order, dq_leaders, dq_null_contents, dq_not_in_contents,
        dq_phrases, dq_leaked_tables, dq_list_phrases, dq_table_phrases,
    )
}
