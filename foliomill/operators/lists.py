"""Bulleted and numbered lists within a section's text: built-in expressions only, one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import regex as R
from ..functions import text as T

LEAST_LENGTH, LEAST_ITEMS = 8, 2
#: One of these stands in every match of a pattern.
MARKS = {R.BULLET: "•●○▪■►", R.DASH_FIRST: "-–—", R.DIGIT_FIRST: ")."}
ONE = schema.LISTS.removeprefix("array<").removesuffix(">")


def segments(content: Column, pattern: str) -> Column:
    """What follows each match, up to the next one; no match, no segments. A text without the pattern's marks is not split."""
    parts = T.let(F.split(content, pattern, -1), lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.when(T.any_of(content, *MARKS[pattern]), parts).otherwise(F.array().cast("array<string>"))


def items(parts: Column) -> Column:
    return F.filter(F.transform(parts, T.clean_item), lambda x: F.length(x) >= LEAST_LENGTH)


def is_dash_list(parts: Column) -> Column:
    """At least two segments, two fifths of them (and one) ending with a semicolon."""
    ends = F.size(F.filter(parts, lambda x: x.rlike(R.ENDS_SEMICOLON)))
    return (F.size(parts) >= LEAST_ITEMS) & (ends >= F.greatest(F.lit(1.0), F.size(parts) * F.lit(0.4)))


def is_citation_list(found: Column) -> Column:
    return (F.size(found) > 0) & (F.size(F.filter(found, T.is_citation)) >= F.size(found) * F.lit(0.4))


def lists_of(content: Column, heading: Column) -> Column:
    """Array of (type, topic, items): marked bullets, dashes, numbers, each at most once."""
    c = F.coalesce(content, F.lit(""))
    good = lambda x: (F.size(x) >= LEAST_ITEMS) & ~is_citation_list(x)
    differ = lambda a, b: F.array_sort(F.array_distinct(a)) != F.array_sort(F.array_distinct(b))

    def chosen(p: Column) -> Column:
        one = lambda ok, kind, x: F.when(ok, F.struct(F.lit(kind).alias("type"), p["topic"].alias("topic"), x.alias("items"))).cast(ONE)
        every = F.array(
            one(good(p["bullets"]), "bullet", p["bullets"]),
            one(is_dash_list(p["parts"]) & good(p["dashes"]) & ((F.size(p["bullets"]) == 0) | differ(p["dashes"], p["bullets"])), "bullet", p["dashes"]),
            one(good(p["numbers"]), "numbered", p["numbers"]),
        )
        return F.filter(every, lambda x: x.isNotNull())

    # each split and the topic are computed once
    found = T.let(segments(c, R.DASH_FIRST), lambda parts: F.struct(
        items(segments(c, R.BULLET)).alias("bullets"), parts.alias("parts"), items(parts).alias("dashes"),
        items(segments(c, R.DIGIT_FIRST)).alias("numbers"), T.topic(heading).alias("topic"),
    ))
    return F.when(T.strip(c) == "", F.array().cast(schema.LISTS)).otherwise(T.let(found, chosen))


def with_lists(sections: DataFrame) -> DataFrame:
    """Sections with their ``lists``; an earlier column of that name is replaced."""
    return sections.withColumn("lists", lists_of(F.col("content"), F.col("heading")))


def list_totals(sections: DataFrame) -> DataFrame:
    """(doc_id, n_lists, n_items)."""
    n_items = F.aggregate("lists", F.lit(0), lambda a, x: a + F.size(x["items"]))
    return sections.groupBy("doc_id").agg(F.sum(F.size("lists")).alias("n_lists"), F.sum(n_items).alias("n_items"))
