"""Mixing sources to target weights by systematic sampling.

A source's weight gives its share of all words; a share above ``most`` times the source's size is cut there and the
excess goes to the others by weight. Every document of a source expects ``target / source_size`` copies. Its expected
copies are prefix-summed within the source (smallest documents first), one random offset is added to all sums, and a
document is emitted once for each whole number that its interval crosses. Ordered by size, the words taken from a
source miss the target by less than about the size of one document.

All of it is DataFrame work. No window runs over a whole source: ranks come from counts per (source, size, slice). Ties
of size are ordered by an md5 of doc_id and text, so a slice is a range of md5s (their first digits), as many as keep a
slice at about ``SLICE_ROWS`` rows whatever the ids are (more only where a table has more than ``SLICES`` times as
many, so that the table of slices stays small). Sources are numbered and filled by aggregates; the driver sees sums.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS, SLICES = 500, 100_000
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Sources that one task numbers.
SOURCES = 100_000


def offset(seed: int) -> float:
    """The one random offset of a run, from 0 to 1."""
    return random.Random(seed).random()


def place(doc_id: Column, text: Column) -> Column:
    """Where a row stands among rows of one size: an md5, spread evenly whatever the ids are."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, scratch: common.Scratch, weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """(source, size, target) for each row (source, size); weights repeat over the sources by code point, null last.

    Water-filling: a source whose share would pass ``most`` times its size stops there, and what is left is dealt again
    by weight among the rest until none is above. Each round is one aggregate; only sums reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    count, total = sizes.agg(F.count("*"), F.sum("size")).first()
    words_all = share * float(total or 0)
    rows = sizes.repartitionByRange(max(1, min(4096, count // SOURCES)), *order).withColumn("p", F.spark_partition_id())
    rows = scratch.keep(rows.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(*order))))
    before = 0
    number = F.col("i")
    for r in sorted(rows.groupBy("p").agg(F.count("*").alias("n")).collect()):  # one row a partition
        number = F.when(F.col("p") == r.p, F.col("i") + before).otherwise(number)
        before += r.n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = scratch.keep(rows.select("source", "size", weight.alias("w")))
    top = most * F.col("size")
    left, free, full = words_all, None, F.lit(False)
    while True:
        # a full source stays full, as the level only rises
        r = rows.agg(F.sum(F.when(~full, F.col("w"))).alias("w"), F.sum(F.when(full, top)).alias("t")).first()
        left = words_all - (r.t or 0.0)
        if r.w == free:
            break
        free = r.w
        if not free:
            break
        full = left * F.col("w") / free > top
    return rows.select("source", "size", F.when(full, top).otherwise(left * F.col("w") / (free or 1.0)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0, seed: int = 7, keep_text: bool = False) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size) to every row.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text, 0 for a null text. A null source is a source
    of its own. Ids may be of any type that can be written as text, null too; ties of size are ordered by an md5 of doc_id
    and text, and wholly equal rows share their copies in any order. Documents of a source without words expect no
    copies. The same rows and seed give the same result. Columns of ``docs`` with the names of result columns are
    replaced; an empty table gives an empty table. The text goes through the shuffle only with ``keep_text``.
    """
    spark, made = docs.sparkSession, ("size", "source_size", "target", "copies", "taken")
    rows = docs.drop(*made, "_h").withColumns({"size": words(F.col("text")), "_h": place(F.col("doc_id"), F.col("text"))})
    kept = [c for c in rows.columns if c not in ("size", "_h")]
    keys = rows.select(F.col("source").alias("_s"), F.col("size").alias("_n"), "_h")
    scratch = common.Scratch(spark, "mix")
    groups = scratch.keep(keys.groupBy("_s", "_n").agg(F.count("*").alias("_c")))
    plan = targets(groups.groupBy(F.col("_s").alias("source")).agg(F.sum(F.col("_n") * F.col("_c")).alias("size")), scratch, weights, most, share)
    every = groups.agg(F.sum("_c")).first()[0] or 0
    # digits of the md5 that name a slice of a (source, size) group, so that order by (size, slice) is order by (size, md5)
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_c") / F.lit(max(SLICE_ROWS, every // SLICES))) / 4)).cast("int")
    groups = groups.select("_s", "_n", digits.alias("_k"))
    own = lambda df: df.select(*[F.col(c).alias(f"b{c}") for c in df.columns])

    def sliced(df: DataFrame) -> DataFrame:
        g = own(groups).hint("merge")  # never broadcast: it grows with the corpus, and compressed files hide its size
        return df.join(g, df["_s"].eqNullSafe(g["b_s"]) & (df["_n"] == g["b_n"])).withColumn("_b", F.substr("_h", F.lit(1), F.col("b_k"))).drop(*g.columns)

    counts = sliced(keys).groupBy("_s", "_n", "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_s").orderBy("_n", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_from", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(own(plan), F.col("_s").eqNullSafe(F.col("bsource")))
    starts = own(starts.select("_s", "_n", "_b", "_from", F.col("bsize").alias("source_size"), F.col("btarget").alias("target")))
    work = sliced((rows if keep_text else rows.drop("text")).withColumns({"_s": F.col("source"), "_n": F.col("size")}))
    ranked = work.withColumn("_i", F.row_number().over(Window.partitionBy("_s", "_n", "_b").orderBy("_h")))
    ranked = ranked.join(starts.hint("merge"), ranked["_s"].eqNullSafe(starts["b_s"]) & (ranked["_n"] == starts["b_n"]) & (ranked["_b"] == starts["b_b"]))
    each = F.when(F.col("bsource_size") > 0, F.col("btarget") / F.col("bsource_size")).otherwise(F.lit(0.0))
    u, i = F.lit(offset(seed)), F.col("_i") + F.col("b_from")
    copies = (F.floor(i * each + u) - F.floor((i - 1) * each + u)).cast("long")
    return ranked.withColumn("copies", copies).select(
        *[c for c in kept if keep_text or c != "text"], "size", F.col("bsource_size").alias("source_size"), F.col("btarget").alias("target"),
        "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _oracle() -> str:
    """The same mix in DuckDB SQL; the water-filling is a recursion over rounds."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         CAST([5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS DOUBLE) AS w
  FROM d GROUP BY source
), fill AS (
  SELECT 0 AS round, source, n, w, CAST(NULL AS DOUBLE) AS target,
         CAST(sum(n) OVER () AS DOUBLE) AS free, sum(w) OVER () AS ws FROM s
  UNION ALL
  SELECT round + 1, source, n, w, t,
         CAST((SELECT sum(n) FROM s) AS DOUBLE) - coalesce(sum(t) OVER (), 0), sum(CASE WHEN t IS NULL THEN w ELSE 0 END) OVER ()
  FROM (SELECT *, CASE WHEN target IS NOT NULL THEN target WHEN free * w / ws > 3.0 * n THEN 3.0 * n END AS t FROM fill) q
  WHERE round < 60
), t AS (
  SELECT source, n, coalesce(target, free * w / nullif(ws, 0)) AS target FROM fill WHERE round = 60
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, h) AS i FROM d
)
SELECT doc_id, size, t.n AS source_size, t.target AS target,
       CASE WHEN t.n = 0 THEN 0 ELSE
       CAST(floor(i * (t.target / t.n) + {offset(7)!r}::DOUBLE) - floor((i - 1) * (t.target / t.n) + {offset(7)!r}::DOUBLE) AS BIGINT) * size END AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""


OP7_SQL = _oracle()
