"""Words to visual lines, and classes of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex as R
from ..functions import text as T

#: Words whose tops differ from the first word of a row by no more than this share the row.
TOLERANCE = 2.0


def row_starts(tops: Column) -> Column:
    """Positions (from 0) at which a new row starts, for an array of tops in reading order.

    A fold: a row's anchor is the top of its first word and does not move, which no gap window can express.
    """
    state = F.struct(F.lit(-999.0).alias("anchor"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, top: Column) -> Column:
        same = F.abs(top - acc["anchor"]) <= TOLERANCE
        return F.struct(
            F.when(same, acc["anchor"]).otherwise(top).alias("anchor"),
            (acc["at"] + 1).alias("at"),
            F.when(same, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"]))).alias("starts"),
        )

    return F.aggregate(tops, state, step, lambda acc: acc["starts"])


def word_rows(words: DataFrame) -> DataFrame:
    """Every word with ``row_no``, its row from the top of the page; one shuffle by page."""
    fields = [c for c in words.columns if c not in ("doc_id", "page_idx")]
    entry = F.struct(F.rint("top").alias("_r"), F.col("x0").alias("_x"), F.col("word_idx").alias("_i"), *fields)
    page = words.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(entry)).alias("w"))
    page = page.withColumn("starts", row_starts(F.transform("w", lambda x: x["top"])))
    rows = F.transform(
        F.sequence(F.lit(0), F.size("starts") - 1),
        lambda k: F.struct(
            k.alias("row_no"),
            F.slice("w", F.get("starts", k) + 1, F.coalesce(F.get("starts", k + 1), F.size("w")) - F.get("starts", k)).alias("w"),
        ),
    )
    rows = page.select("doc_id", "page_idx", F.explode(rows).alias("r"))
    return rows.select("doc_id", "page_idx", "r.row_no", F.explode("r.w").alias("x")).select("doc_id", "page_idx", "row_no", *[F.col(f"x.{c}") for c in fields])


def body_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page_idx, line_no, text, bold, size): rows of words from left to right with their dominant font.

    The dominant font has most characters, on ties the one seen first from the left; size is the mean word size.
    Rows without visible text are left out.
    """
    rows = word_rows(words)
    entry = F.struct("x0", F.rint("top").alias("r"), "word_idx", "text", "fontname", "size")
    lines = rows.groupBy("doc_id", "page_idx", "row_no").agg(F.array_sort(F.collect_list(entry)).alias("w"), F.avg("size").alias("size"))
    fonts = F.array_distinct(F.transform("w", lambda x: x["fontname"]))
    share = lambda f: F.aggregate(F.filter("w", lambda x: x["fontname"].eqNullSafe(f)), F.lit(0), lambda a, x: a + F.length(x["text"]))
    ranked = F.transform(fonts, lambda f, i: F.struct((-share(f)).alias("n"), i.alias("i"), f.alias("font")))
    lines = lines.withColumn("font", F.array_min(ranked)["font"])
    text = T.strip(F.array_join(F.transform("w", lambda x: x["text"]), " "))
    lines = lines.select("doc_id", "page_idx", F.col("row_no").alias("line_no"), text.alias("text"), T.is_bold(F.col("font")).alias("bold"), "size", "font")
    return lines.where("text <> ''")


def toc_class(lines: DataFrame) -> DataFrame:
    """(doc_id, page_idx, fmt): 'A' with leaders, 'B' plain, '' for other pages, from text lines."""
    s = T.strip(F.col("text"))
    header = F.max((F.col("line_no") < 5) & F.col("text").rlike(R.TOC_HEADER_OPEN))
    page = lines.groupBy("doc_id", "page_idx").agg(
        F.count_if(s.rlike(R.TOC_LEADER)).alias("leaders"), F.count_if(s.rlike(R.PLAIN_ENTRY)).alias("plain"), header.alias("header")
    )
    fmt = F.when(F.col("leaders") >= 3, "A").when(F.col("header") | (F.col("plain") >= 3), "B").otherwise("")
    return page.select("doc_id", "page_idx", fmt.alias("fmt"))


def body_toc_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_idx, is_toc): body pages that are tables of contents and so no body."""
    s = T.strip(F.col("text"))
    page = lines.groupBy("doc_id", "page_idx").agg(
        F.count_if(F.col("text").rlike(R.BODY_LEADER)).alias("leaders"),
        F.count_if(s.rlike(R.PLAIN_ENTRY)).alias("plain"),
        F.max((F.col("line_no") < 5) & s.rlike(R.TOC_HEADER)).alias("header"),
    )
    return page.select("doc_id", "page_idx", ((F.col("leaders") >= 3) | F.col("header") | (F.col("plain") >= 3)).alias("is_toc"))
