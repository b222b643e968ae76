"""Sources: PDF folders through a pluggable decoder, and the JSON files of earlier runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

#: A decoder takes a file's bytes and yields (page_idx, text, words, tables) for each page: the page's text, word tuples
#: (text, x0, top, bottom, fontname, size) and table tuples (x0, top, x1, bottom, rows). A fifth item may hold the words
#: that captions are read from, as tuples (text, x0, top, bottom) that no change of font has split.
Decoder = Callable[[bytes], Iterable[tuple]]

#: What the names of sections files end with, before ``.json``.
CONTENT = "_content"
PAGES = (
    "doc_id string, page_idx int, text string, "
    "words array<struct<text:string,x0:double,top:double,bottom:double,fontname:string,size:double>>, "
    "tables array<struct<x0:double,top:double,x1:double,bottom:double,rows:array<array<string>>>>, "
    "plain array<struct<text:string,x0:double,top:double,bottom:double>>, error string"
)


def stem(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, content) of a folder's files, not below it; an empty folder gives no rows, a missing one raises."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return raw.select(stem(F.col("path")).alias("doc_id"), "content")


def pdfplumber_decoder(content: bytes) -> Iterator[tuple]:
    """Decodes with pdfplumber where it is installed."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for k, page in enumerate(pdf.pages):
            words = [tuple(w[x] for x in ("text", "x0", "top", "bottom", "fontname", "size")) for w in page.extract_words(extra_attrs=["fontname", "size"])]
            grids = [(*map(float, t.bbox), rows) for t, rows in zip(page.find_tables(), page.extract_tables())]
            plain = [tuple(w[x] for x in ("text", "x0", "top", "bottom")) for w in page.extract_words()] if grids else []
            yield k, page.extract_text() or "", words, grids, plain


def decoded(docs: DataFrame, decoder: Decoder = pdfplumber_decoder) -> DataFrame:
    """One row for each page, decoded once; a document that fails gives one row with its ``error`` and nothing else."""
    import pandas as pd

    word_names = ("text", "x0", "top", "bottom", "fontname", "size")
    table_names = ("x0", "top", "x1", "bottom", "rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    pages = [
                        (doc_id, k, text, [dict(zip(word_names, w)) for w in words], [dict(zip(table_names, t)) for t in grids], [dict(zip(word_names, w)) for w in (plain[0] if plain else words)], None)
                        for k, text, words, grids, *plain in decoder(bytes(content))
                    ]
                except Exception as e:  # one bad file must not end the run
                    pages = [(doc_id, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(pages, columns=["doc_id", "page_idx", "text", "words", "tables", "plain", "error"])

    return docs.select("doc_id", "content").mapInPandas(run, PAGES)


def relations(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text_lines, words, raw_tables) of decoded pages; empty pages have no lines."""
    good = pages.where("error is null")
    lines = good.where("text <> ''").select("doc_id", "page_idx", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    words = good.select("doc_id", "page_idx", F.posexplode("words").alias("word_idx", "w")).select("doc_id", "page_idx", "word_idx", "w.*")
    grids = good.select("doc_id", "page_idx", F.posexplode("tables").alias("table_idx", "t"))
    box = F.struct("t.x0", "t.top", "t.x1", "t.bottom").alias("bbox")
    return lines, words, grids.select("doc_id", "page_idx", "table_idx", box, F.col("t.rows").alias("rows"))


def caption_words(pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx, word_idx, text, x0, top, bottom): the words that table captions are read from."""
    each = pages.where("error is null and size(tables) > 0").select("doc_id", "page_idx", F.posexplode("plain").alias("word_idx", "w"))
    return each.select("doc_id", "page_idx", "word_idx", "w.*")


def _parsed(spark: SparkSession, path: str, fields: str, content: bool) -> DataFrame:
    """(doc_id, items) of the JSON files at a path or in a folder; ``items`` is null where a file is no such array."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    # file names arrive percent-encoded
    name = stem(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))))
    rows = raw.select(name.alias("name"), "value").where(F.endswith("name", F.lit(CONTENT)) == content)
    doc_id = F.regexp_replace("name", f"{CONTENT}$", "").alias("doc_id")
    return rows.select(doc_id, F.from_json("value", f"array<struct<{_struct(fields)}>>").alias("items"))


def _json(spark: SparkSession, path: str, fields: str, content: bool) -> DataFrame:
    return _parsed(spark, path, fields, content).select("doc_id", F.posexplode("items").alias("pos", "x"))


def broken_json(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(doc_id, error) of headings (or sections) files that hold no JSON array; their documents have no rows otherwise."""
    bad = _parsed(spark, path, schema.SECTION_JSON if content else schema.HEADING_JSON, content).where("items is null")
    return bad.select("doc_id", F.lit("not a JSON array of objects").alias("error"))


def _struct(fields: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in _split(fields))


def _split(fields: str) -> list[str]:
    """Top-level commas only: types may hold commas of their own."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[start:i])
            start = i + 1
    return [*out, fields[start:]]


def headings_json(spark: SparkSession, path: str) -> DataFrame:
    """Headings of ``<stem>.json`` files (an array of objects each) at a path or in a folder, in file order."""
    return _json(spark, path, schema.HEADING_JSON, False).select("doc_id", "pos", "x.*")


def sections_json(spark: SparkSession, path: str) -> DataFrame:
    """Sections of ``<stem>_content.json`` files at a path or in a folder; a missing ``lists`` or ``tables`` is null."""
    return _json(spark, path, schema.SECTION_JSON, True).select("doc_id", F.col("pos").alias("sec_pos"), "x.*")
