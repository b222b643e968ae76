"""The whole run: lines, words and raw tables of many documents to headings and annotated sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import lines, lists, tables, toc


@dataclass
class Result:
    headings: DataFrame
    sections: DataFrame


def parse(text_lines: DataFrame, words: DataFrame, raw_tables: DataFrame, body: DataFrame | None = None, dedup: bool = True, caption_words: DataFrame | None = None) -> Result:
    """Headings of every document, and its sections with lists and tables.

    ``body`` (lines with bold and size) is derived from the words unless given; captions are read from the words too, unless
    they have ``caption_words`` of their own. All plans are lazy; a document without
    headings has no sections. Nothing of one document depends on another.
    """
    found = toc.headings(text_lines)
    found = toc.deduplicated(found) if dedup else found
    body = lines.body_lines(words) if body is None else body
    out = tables.annotated(body, found, raw_tables, words if caption_words is None else caption_words)
    out = lists.with_lists(out)
    return Result(found, out.select(*[c for c in out.columns if c != "tables"], "tables"))
