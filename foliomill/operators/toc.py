"""Tables of contents to headings: window functions over one shuffle by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regex as R
from ..functions import text as T


def headings(text_lines: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, pos, level, depth, number, text) of every document's table of contents.

    Pages with a format are read from the first on, until a page without one after the first heading, or until an
    appendix line. An entry takes the lines that follow it up to a blank, a page number, a line with a meaning of its
    own or a new entry; a line with leaders is its last. An appendix line met within an entry discards that entry.
    ``dealt`` lines lie by document already and are not shuffled.
    """
    page = Window.partitionBy("doc_id", "page_idx")
    rows = T.stripped(text_lines if dealt else text_lines.repartition("doc_id"))
    rows = rows.withColumn("leader", T.is_toc_leader(F.col("s")))
    leaders, plain = F.count_if(F.col("leader")).over(page), F.count_if(T.is_plain_entry(F.col("s"))).over(page)
    header = F.max((F.col("line_no") < 5) & T.is_toc_header(F.col("s"), whole=False)).over(page)
    rows = rows.withColumn("fmt", F.when(leaders >= 3, "A").when(header | (plain >= 3), "B").otherwise(""))
    # the next page without a format, for the page on which headings begin
    ahead = Window.partitionBy("doc_id").orderBy("page_idx").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("gap", F.min(F.when(F.col("fmt") == "", F.col("page_idx"))).over(ahead)).where("fmt <> ''")
    rows = rows.withColumns({"whole": T.normalize_line(F.col("s")), "appendix": T.is_appendix(F.col("s")), "skipped": T.is_skipped_line(F.col("s"))})
    # toc_entry of the whole line, each part a column of its own
    rows = rows.withColumn("rest", F.when(T.is_toc_entry(F.col("whole")), F.regexp_extract("whole", R.TOC_ENTRY, 2)))
    rows = rows.withColumn("title", T.toc_title(F.col("rest"), F.col("fmt")))
    rows = rows.withColumn("entry", T.toc_named(F.col("whole"), F.col("title")))
    starts = F.when(F.col("whole") == F.col("s"), F.col("entry").isNotNull()).otherwise(T.toc_entry(F.col("s"), F.col("fmt")).isNotNull())
    stop = (F.col("s") == "") | T.is_page_number(F.col("s")) | F.col("skipped") | F.col("appendix") | starts
    rows = rows.withColumns({"stop": stop, "silent": F.col("appendix") & ~F.col("skipped")})
    order = page.orderBy("line_no")
    rows = rows.withColumn("group", F.sum(F.col("stop").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("`group` > 0")
    own = Window.partitionBy("doc_id", "page_idx", "group").orderBy("line_no")
    last = F.col("leader") & ~F.col("stop")
    closed = F.coalesce(F.max(last).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    piece = F.when(F.col("fmt") == "A", T.strip_dots(F.col("s"))).otherwise(T.strip_page(F.col("s")))
    rows = rows.withColumn("piece", F.when(~F.col("stop") & ~closed & (piece != ""), piece))
    # a group is the line that stops the one before, and what follows it: that line stands for all
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = rows.withColumns({"ended": F.max(last).over(every), "pieces": F.collect_list("piece").over(every)}).where("stop")
    following = Window.partitionBy("doc_id", "page_idx").orderBy("group")
    lost = ~F.col("ended") & F.coalesce(F.lead("silent").over(following), F.lit(False))
    groups = groups.withColumn("heading", F.col("entry").isNotNull() & ~F.col("appendix") & ~lost)
    # where each document's table of contents ends
    doc = Window.partitionBy("doc_id")
    first = F.min(F.when(F.col("heading"), F.struct("page_idx", "gap"))).over(doc)
    groups = groups.withColumns({"stop_page": first["gap"], "end": F.min(F.when(F.col("appendix"), F.struct("page_idx", "line_no"))).over(doc)})
    found = groups.where("heading and (stop_page is null or page_idx < stop_page)")
    found = found.where(F.col("end").isNull() | (F.struct("page_idx", "line_no") < F.col("end")))
    joined = F.array_join(F.concat(F.array(F.col("entry.title")), "pieces"), " ")
    place = Window.partitionBy("doc_id").orderBy("page_idx", "group")
    number = F.col("entry.number")
    return found.select(
        "doc_id", (F.row_number().over(place) - 1).alias("pos"), T.level(number).alias("level"), T.depth(number).alias("depth"),
        number.alias("number"), T.let(joined, T.collapse).alias("text"),
    )


def deduplicated(found: DataFrame) -> DataFrame:
    """The first of headings with equal number and text in a document, numbered anew."""
    same = Window.partitionBy("doc_id", "number", "text").orderBy("pos")
    first = found.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)


def level_summary(found: DataFrame) -> DataFrame:
    """(doc_id, level, n), also for sections."""
    return found.groupBy("doc_id", "level").agg(F.count("*").alias("n"))


def outline(found: DataFrame) -> DataFrame:
    """(doc_id, pos, line): one display line for each heading, indented by depth."""
    indent = F.repeat(F.lit(" "), F.when(F.col("depth") <= 5, 2 * (F.col("depth") - 1)).otherwise(10))
    return found.select("doc_id", "pos", F.concat(indent, F.lit("["), "level", F.lit("]  "), "number", F.lit(". "), "text").alias("line"))
