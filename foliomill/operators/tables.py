"""Raw tables: classes to leave out, cleaned cells, captions, and the section that each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import regex as R
from ..functions import text as T
from .sections import page_sections, sections_with

CAPTION_GAP, CAPTION_SLACK = 22.0, 4.0


def _flat_cell(c: Column) -> Column:
    return T.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def flat_text(rows: Column) -> Column:
    """All cells in one lower-case line; an empty cell leaves its blank."""
    return F.lower(F.array_join(F.transform(F.flatten(rows), _flat_cell), " "))


def first_cells(rows: Column) -> Column:
    """Cells of the first row with any text."""
    first = F.get(F.filter(rows, lambda r: F.exists(r, lambda c: _flat_cell(c) != "")), 0)
    return F.coalesce(F.transform(first, _flat_cell), F.array().cast("array<string>"))


def is_checklist(rows: Column) -> Column:
    """Quality checklists, and rosters of authors."""
    return T.let(T.unwrap(flat_text(rows)), _checklist_marks)


def _checklist_marks(flat: Column) -> Column:
    # fixed values: the phrases below decide results
    any_of = lambda flat, *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(flat, w))

    return (
        any_of(flat, "да/нет", "да / нет")
        | (F.contains(flat, F.lit("критерии качества")) & any_of(flat, "убедительности", "достоверности", "уур", "выполнения"))
        | any_of(flat, "рабочей группы", "рабочая группа", "члены рабочей")
        | (flat.rlike(R.CREDENTIALS) & flat.rlike(R.INSTITUTION))
    )


def is_legend(rows: Column) -> Column:
    """Explanations of evidence levels."""
    return T.let(_flat_and_first(rows), _legend_marks)


def _flat_and_first(rows: Column) -> Column:
    first = T.strip(F.lower(F.coalesce(F.get(first_cells(rows), 0), F.lit(""))))
    return F.struct(T.unwrap(flat_text(rows)).alias("flat"), first.alias("first"))


def _legend_marks(x: Column) -> Column:
    # fixed values: the phrases below decide results
    has = lambda w: F.contains(x["flat"], F.lit(w))
    return (
        x["first"].isin("ууr", "уур", "удд")
        | (has("сильная рекомендация") & has("уур"))
        | has("уровень убедительности рекомендаций")
        | has("несравнительные исследования")
        | has("описание клинического случая")
        | has("обоснование механизма действия")
        | (x["first"].rlike(r"(?d)^[1-5]$") & (has("систематический обзор") | has("рандомизированн")))
    )


def _filled(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) != ""


def is_artifact(rows: Column) -> Column:
    """At most two rows, or almost all cells empty."""
    cells = F.flatten(rows)
    sparse = (F.size(cells) > 0) & (F.size(F.filter(cells, _filled)) / F.size(cells) < F.lit(0.15))
    return (F.size(rows) <= 2) | sparse


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def is_wrapped_text(rows: Column) -> Column:
    """One column holds at least 70 % of what the table holds; rows may differ in length."""
    columns = F.sequence(F.lit(0), F.greatest(width(rows), F.lit(1)) - 1)
    counts = F.transform(columns, lambda k: F.size(F.filter(rows, lambda r: _filled(F.get(r, k)))))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    dominant = lambda c: (total(c) == 0) | (F.array_max(c) / F.greatest(total(c), F.lit(1)) >= F.lit(0.70))
    return (width(rows) >= 2) & T.let(counts, dominant)


def is_skipped(rows: Column) -> Column:
    # the flat text is made once for both, and last
    return is_artifact(rows) | is_wrapped_text(rows) | T.let(_flat_and_first(rows), lambda x: _checklist_marks(x["flat"]) | _legend_marks(x))


def clean_rows(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, T.clean_cell))


def is_diagnostic(c: Column) -> Column:
    return T.is_diagnostic(c)


def keeps_width(cleaned: Column) -> Column:
    """Two columns, or one that starts with a diagnostic header."""
    return (width(cleaned) >= 2) | T.let(F.coalesce(F.get(F.get(cleaned, 0), 0), F.lit("")), is_diagnostic)


def captions(tables: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_idx, table_idx, caption): the words just above a table, if they read like a caption.

    A range join within the page: tops from 22 points above the table's top to it, bottoms at most 4 below it. Tables of
    a page at one height share their words, which are streamed past the heights and not sorted for the join.
    """
    heights = tables.groupBy("doc_id", "page_idx", F.col("bbox.top").alias("t_top")).agg(F.collect_set("table_idx").alias("ids"))
    w = words.select("doc_id", "page_idx", "word_idx", "text", "x0", "top", "bottom")
    near = (F.col("top") >= F.col("t_top") - CAPTION_GAP) & (F.col("top") <= F.col("t_top")) & (F.col("bottom") <= F.col("t_top") + CAPTION_SLACK)
    hits = w.join(heights.hint("shuffle_hash"), ["doc_id", "page_idx"]).where(near)
    entry = F.struct(F.rint("top").alias("r"), "x0", "word_idx", "text")
    lines = hits.groupBy("doc_id", "page_idx", "t_top").agg(F.array_sort(F.collect_list(entry)).alias("w"), F.first("ids").alias("ids"))
    lines = lines.withColumn("line", F.array_join(F.transform("w", lambda x: x["text"]), " ")).withColumn("caption", T.strip(F.col("line")))
    return lines.where(T.is_caption(F.col("caption"))).select("doc_id", "page_idx", F.explode("ids").alias("table_idx"), "caption")


def kept_tables(tables: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_idx, table_idx, caption, rows) of tables worth keeping, with cleaned cells."""
    # width and first cell are those of the cleaned rows, which a filter of these would clean once more
    first = T.clean_cell(F.get(F.get("rows", F.lit(0)), F.lit(0)))
    wide = (width(F.col("rows")) >= 2) | T.let(first, is_diagnostic)
    good = tables.where(~is_skipped(F.col("rows")) & wide).withColumn("rows", clean_rows(F.col("rows")))
    # captions of all tables: their places alone are known without judging the rows a second time
    found = captions(tables, words)
    return good.select("doc_id", "page_idx", "table_idx", "rows").join(found, ["doc_id", "page_idx", "table_idx"], "left").select("doc_id", "page_idx", "table_idx", "caption", "rows")


def with_tables(sections: DataFrame, tables: DataFrame, words: DataFrame, body: DataFrame, headings: DataFrame) -> DataFrame:
    """Sections with their ``tables`` by place; a table goes to the section open at the end of its page.

    Of sections that share a number the last gets them. An earlier column ``tables`` is replaced.
    """
    placed = kept_tables(tables, words).join(page_sections(body, headings).where("number is not null"), ["doc_id", "page_idx"])
    last = sections.groupBy("doc_id", "number").agg(F.max("sec_pos").alias("sec_pos"))
    placed = placed.join(last, ["doc_id", "number"])
    entry = F.struct("page_idx", "table_idx", "caption", "rows")
    per = placed.groupBy("doc_id", "sec_pos").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    per = per.select("doc_id", "sec_pos", F.transform("t", lambda x: F.struct(x["caption"].alias("caption"), x["rows"].alias("rows"))).alias("tables"))
    out = sections.drop("tables").join(per, ["doc_id", "sec_pos"], "left")
    return out.withColumn("tables", F.coalesce("tables", F.array().cast(schema.TABLES)))


def annotated(body: DataFrame, headings: DataFrame, tables: DataFrame, words: DataFrame, dealt: bool = False) -> DataFrame:
    """Sections with their ``tables``, as ``with_tables`` over ``sections`` gives them, from one pass over the body."""
    entry = F.struct("page_idx", "table_idx", "caption", "rows")
    placed = kept_tables(tables, words).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    out = sections_with(body, headings, placed, dealt)
    return out.withColumn("tables", F.col("tables").cast(schema.TABLES))


def table_totals(sections: DataFrame) -> DataFrame:
    """(doc_id, n_tables)."""
    return sections.groupBy("doc_id").agg(F.sum(F.size("tables")).alias("n_tables"))
