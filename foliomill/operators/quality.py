"""Data-quality checks over headings and sections, one row for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regex as R
from . import tables as T


def duplicate_numbers(sections: DataFrame) -> DataFrame:
    """Sections whose number an earlier section of the document has."""
    n = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("sec_pos"))
    return sections.withColumn("_n", n).where("_n > 1").select("doc_id", "sec_pos", "number")


def order_violations(sections: DataFrame, headings: DataFrame) -> DataFrame:
    """Sections placed in the contents before the section ahead of them."""
    places = headings.groupBy("doc_id", "number").agg(F.max("pos").alias("pos"))
    placed = sections.select("doc_id", "sec_pos", "number").join(places, ["doc_id", "number"])
    ahead = F.lag("pos").over(Window.partitionBy("doc_id").orderBy("sec_pos"))
    return placed.withColumn("ahead", ahead).where("pos < ahead").select("doc_id", "sec_pos", "number", "pos", "ahead")


def leader_bleed(sections: DataFrame) -> DataFrame:
    """Sections with leaders in the heading or at the start of the content."""
    starts = F.coalesce("content", F.lit("")).rlike(rf"(?Ud)^\s*(?:{R.BODY_LEADER.removeprefix('(?Ud)')})")
    return sections.where(F.col("heading").rlike(R.BODY_LEADER) | starts).select("doc_id", "sec_pos", "number")


def null_contents(sections: DataFrame) -> DataFrame:
    return sections.where("content is null").select("doc_id", "sec_pos", "number")


def not_in_contents(sections: DataFrame, headings: DataFrame) -> DataFrame:
    return sections.select("doc_id", "sec_pos", "number").join(headings.select("doc_id", "number"), ["doc_id", "number"], "left_anti").select("doc_id", "sec_pos", "number")


def phrase_found(sections: DataFrame, checks: DataFrame) -> DataFrame:
    """(doc_id, section, phrase, found) for checks (doc_id, section, phrase): in the section or any section below it."""
    # a section stands in itself and in all sections above it, so checks meet only what they read
    parts = F.split("number", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    own = sections.where("number is not null").select("doc_id", F.explode(above).alias("section"), F.struct("sec_pos", F.coalesce("content", F.lit("")).alias("content")).alias("_c"))
    joined = checks.join(own, ["doc_id", "section"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_c")), lambda x: x["content"]), " ")
    per = joined.groupBy("doc_id", "section", "phrase").agg(text.alias("_t"))
    return per.select("doc_id", "section", "phrase", F.contains(F.lower("_t"), F.lower("phrase")).alias("found"))


def phrase_in_tables(tables: Column, phrase: Column) -> Column:
    cells = F.flatten(F.transform(tables, lambda t: F.flatten(t["rows"])))
    return F.exists(cells, lambda c: F.contains(F.lower(c), F.lower(phrase)))


def phrase_in_lists(lists: Column, phrase: Column) -> Column:
    return F.exists(F.flatten(F.transform(lists, lambda x: x["items"])), lambda i: F.contains(F.lower(i), F.lower(phrase)))


def leaked_tables(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, n) where tables of a class that should be left out are attached."""
    n = F.size(F.filter("tables", lambda t: T.is_checklist(t["rows"]) | T.is_legend(t["rows"])))
    return sections.withColumn("n", n).where("n > 0").select("doc_id", "sec_pos", "n")
