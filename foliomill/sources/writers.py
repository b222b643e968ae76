"""Sinks: JSON arrays by document, or Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def _documents(rows: DataFrame, order: str, item: Column) -> DataFrame:
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("a"))
    return held.select("doc_id", F.to_json(F.transform("a", lambda e: e["x"]), KEEP_NULLS).alias("json"))


def headings_documents(headings: DataFrame) -> DataFrame:
    """(doc_id, json): each document's headings as one array of objects."""
    return _documents(headings, "pos", F.struct("level", "depth", "number", "text"))


def sections_documents(sections: DataFrame) -> DataFrame:
    """(doc_id, json): each document's sections as one array of objects; null captions are kept as null."""
    return _documents(sections, "sec_pos", F.struct("level", "depth", "number", "heading", "content", "lists", "tables"))


def write_json(documents: DataFrame, folder: str, suffix: str = "") -> None:
    """One file ``<doc_id><suffix>.json`` in ``folder`` for each document with an id; a file of that name is replaced.

    The cluster writes whole files aside, then each is renamed into place: one request a document from the driver and
    no data. Corpora of very many documents go to ``write_parquet``.
    """
    spark = documents.sparkSession
    aside = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    documents.where("doc_id is not null").write.partitionBy("doc_id").text(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    fs = path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for one in fs.listStatus(path(aside)):
            at = one.getPath()
            if not one.isDirectory():
                continue
            stem = names.unescapePathName(at.getName().removeprefix("doc_id="))
            target = path(path(folder), f"{stem}{suffix}.json".replace("/", "%2F"))
            for part in fs.listStatus(at):
                if part.getPath().getName().startswith("part-"):
                    fs.delete(target, False)
                    if not fs.rename(part.getPath(), target):
                        raise OSError(f"cannot write {target}")
    finally:
        fs.delete(path(aside), True)


def write_parquet(rows: DataFrame, folder: str) -> None:
    """Headings or sections as Parquet, for later steps."""
    rows.write.mode("overwrite").parquet(folder)
