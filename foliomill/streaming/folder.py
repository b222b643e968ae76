"""A folder of documents as a stream: every micro-batch goes through the batch plan.

Documents stand alone, so no state or watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.pipeline import parse
from ..sources.readers import Decoder, caption_words, decoded, pdfplumber_decoder, relations, stem
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def parse_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, decoder: Decoder = pdfplumber_decoder, pattern: str = "*.pdf"):
    """Starts a query that appends headings and sections of new files to Parquet below ``out``; each file once."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)

    def batch(files: DataFrame, epoch: int) -> None:
        pages = decoded(files.select(stem(F.col("path")).alias("doc_id"), "content"), decoder).persist()
        result = parse(*relations(pages), caption_words=caption_words(pages))
        # an epoch that runs again replaces what it wrote
        result.headings.write.mode("overwrite").parquet(f"{out}/headings/epoch={epoch}")
        result.sections.write.mode("overwrite").parquet(f"{out}/sections/epoch={epoch}")
        pages.where("error is not null").select("doc_id", "error").write.mode("overwrite").parquet(f"{out}/errors/epoch={epoch}")
        pages.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
