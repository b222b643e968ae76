"""Exact top-k inner products over norm-sorted vectors with rotated partial sums.

Vectors are cut into blocks by descending length. A rotation (right singular vectors of all rows) moves most of a
vector's length into its first coordinates, so that ``q.x <= head(q).head(x) + |rest(q)| |rest(x)|`` (Cauchy-Schwarz)
is tight early. Queries meet the blocks from the longest vectors on, in steps of ``GROWTH`` times as many, and each step
raises every query's threshold. A pair of blocks whose longest vectors cannot reach the lowest threshold of the queries
is never formed; within a pair only vectors whose length can still reach it are looked at, then those whose partial sum
plus residual bound can, and the rest is multiplied out exactly. A bound equal to the threshold is kept, so that ties
are resolved by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, QUERY_BLOCK = 4096, 512
#: Blocks in a step for each block in the step before it, and partitions that blocks are written in at most.
GROWTH, PARTS = 16, 4096
PAIR_SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of each component as double; null or non-finite vectors are left out."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(False)))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Rows of ``v``, shorter ones filled with zeros."""
    col = batch.column(batch.schema.get_field_index("v"))
    flat, at = np.asarray(col.flatten(), np.float64), np.asarray(col.offsets, np.int64)
    at = at - at[0]
    n = np.diff(at)
    out = np.zeros((len(n), d))
    if len(flat):
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(flat)) - at[:-1][row]] = flat
    return out


def _gram(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of outer products over all rows: d * d numbers, added up in the cluster."""

    def part(batches):
        total = np.zeros((d, d))
        for b in batches:
            m = _matrix(b, d)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "x"])

    out = np.zeros(d * d)
    for r in rows.select("v").mapInArrow(part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(d, d)


def _blocks(rows: DataFrame, d: int, size: int, parts: int) -> DataFrame:
    """Vectors by descending length, packed into blocks of at most ``size`` rows."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    spread = rows.withColumn("n2", norm).repartitionByRange(parts, F.desc("n2"), F.col("vec_id")).sortWithinPartitions(F.desc("n2"), "vec_id")

    def pack(batches):
        ids, mats, held = [], [], 0

        def flush():
            nonlocal ids, mats, held
            i, m = np.concatenate(ids), np.concatenate(mats)
            ids, mats, held = [], [], 0
            for a in range(0, len(i), size):
                x = m[a : a + size]
                longest = float(np.sqrt((x[0] * x[0]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([longest]), pa.array([len(x)], pa.int64()), pa.array([i[a : a + size].astype("<i8").tobytes()]), pa.array([x.astype("<i8").tobytes()])],
                    names=["longest", "rows", "ids", "vecs"],
                )

        for b in batches:
            if b.num_rows:
                ids.append(np.asarray(b.column(b.schema.get_field_index("vec_id")), np.int64))
                mats.append(_matrix(b, d))
                held += b.num_rows
            if held >= size:
                yield from flush()
        if held:
            yield from flush()

    return spread.select("vec_id", "v").mapInArrow(pack, "longest double, rows long, ids binary, vecs binary")


def _search(pairs: DataFrame, d: int, k: int, basis: np.ndarray, head: int) -> DataFrame:
    """Best ``k`` of each query in each pair of blocks: rows with q_ids, q_vecs, floors (thresholds) and ids, vecs."""
    shared = pairs.sparkSession.sparkContext.broadcast(basis)  # d * d numbers

    def kernel(batches):
        rot = shared.value
        for b in batches:
            for r in b.to_pylist():
                qi, ci = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q_whole, c_whole = (np.frombuffer(r[x], "<i8").reshape(-1, d) for x in ("q_vecs", "vecs"))
                q, c = q_whole.astype(np.float64), c_whole.astype(np.float64)
                floor = np.frombuffer(r["floors"], "<f8") if r["floors"] is not None else np.full(len(qi), -np.inf)
                qn, cn = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
                largest = qn.max(initial=0) * cn.max(initial=0)
                slack = 1e-9 * (1 + largest)
                small = largest < 2**52  # doubles hold these sums exactly; others need 64-bit integers
                # lengths: each query sees a prefix of the block
                reach = np.where(np.isinf(floor) | (floor <= 0), len(c), [np.searchsorted(-cn, -(f - slack) / max(n, 1e-300), "right") for f, n in zip(floor, qn)])
                most = int(reach.max(initial=0))
                if not most:
                    continue
                qr, cr = q @ rot, c[:most] @ rot
                qrest, crest = (np.sqrt(np.maximum((x[:, head:] ** 2).sum(1), 0)) for x in (qr, cr))
                bound = qr[:, :head] @ cr[:, :head].T + qrest[:, None] * crest[None, :] + slack
                live = (bound >= floor[:, None]) & (np.arange(most)[None, :] < reach[:, None]) & (qi[:, None] != ci[None, :most])
                out_q, out_c, out_s = [], [], []
                for i in np.flatnonzero(live.any(1)):
                    at = np.flatnonzero(live[i])
                    s = (c[at] @ q[i]).astype(np.int64) if small else c_whole[at] @ q_whole[i]
                    keep = s >= (floor[i] if small else floor[i] - slack)  # a larger threshold may have been rounded
                    at, s = at[keep], s[keep]
                    best = np.lexsort((ci[at], -s))[:k]
                    out_q.append(np.full(len(best), qi[i]))
                    out_c.append(ci[at[best]])
                    out_s.append(s[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_q, out_c, out_s)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(kernel, PAIR_SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, head: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products of every query row with all other rows.

    Equal scores go to the smaller vec_id; with fewer than ``k`` other vectors all are returned. Vectors that are null
    or hold null or non-finite components, and rows without vec_id, take no part. Shorter vectors count as filled with
    zeros. Rows with the query's own vec_id are not its candidates; wholly equal rows count once. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "topk")
    rows = quantised(vectors, scale).dropDuplicates(["vec_id", "v"])
    rows = scratch.keep(rows)
    d, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    if not n or not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = rows.where(is_query)
    _, basis = np.linalg.eigh(_gram(rows, d))
    basis = basis[:, ::-1].copy()
    head = head or max(1, d // 4)
    c, edges = _numbered(_blocks(rows, d, BLOCK, max(1, min(PARTS, -(-n // BLOCK)))), "c", scratch)
    q, own = _numbered(_blocks(queries, d, QUERY_BLOCK, max(1, min(PARTS, -(-queries.count() // QUERY_BLOCK)))), "q", scratch)
    if not own:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q = q.select("q", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    best, first, step = None, 1, 1
    while first <= edges[-1][0]:
        last = min(edges[-1][0], first + step - 1)
        pairs = block_pairs(q, best, edges, first, last, k)
        payload = c.where(F.col("c").between(first, last)).select("c", "ids", "vecs")
        met = pairs.join(payload, "c").join(q.select("q", "q_ids", "q_vecs"), "q")
        found = _search(met.repartition(max(1, min(PARTS, (last - first + 1) * own[-1][0])), "q", "c"), d, k, basis, head)
        earlier, best = best, scratch.keep(_best(found if best is None else best.select(*found.columns).unionByName(found), k))
        if earlier is not None:
            scratch.drop(earlier)
        first, step = last + 1, step * GROWTH
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _numbered(blocks: DataFrame, name: str, scratch: common.Scratch) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(blocks numbered from 1 in order, for each partition its last number and longest vector): at most ``PARTS`` rows on the driver."""
    kept = scratch.keep(blocks.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    each = sorted(kept.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.max("longest").alias("longest")).collect())
    before, edges, number = 0, [], F.lit(0).cast("long")
    offsets = []
    for r in each:
        offsets += [F.lit(r.p), F.lit(before)]
        before += r.n
        edges.append((before, r.longest))
    if each:
        number = F.element_at(F.create_map(*offsets), part) + F.col("m").bitwiseAND((1 << 33) - 1) + 1
    return kept.withColumn(name, number.cast("long")).drop("m"), edges


def block_pairs(q: DataFrame, best: DataFrame | None, edges: list[tuple[int, float]], first: int, last: int, k: int) -> DataFrame:
    """(q, c, floors) of the pairs with blocks ``first`` to ``last`` that can still change a query's best ``k``."""
    if best is None:
        return q.select("q", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("c"), F.lit(None).cast("binary").alias("floors"))
    floors = best.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
    ids = q.select("q", "q_ids", "q_vecs").mapInArrow(_unpack, "q long, at int, query_id long, norm double")
    ids = ids.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-(2**62))).cast("double"))
    # the length below which no candidate reaches a query's threshold; none for thresholds up to 0
    needed = F.when(F.col("floor") > 0, F.col("floor") / F.col("norm")).otherwise(F.lit(-1.0))
    packed = ids.groupBy("q").agg(F.min(needed).alias("low"), F.array_sort(F.collect_list(F.struct("at", F.col("floor").alias("f")))).alias("f"))
    packed = packed.select("q", "low", F.transform("f", lambda x: x["f"]).alias("f")).mapInArrow(_pack_floors, "q long, low double, floors binary")
    # blocks come by descending length: those that a query block must meet are a prefix, known to within a partition
    ends = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(longest).alias("longest")) for n, longest in edges if n >= first])
    able = F.filter(ends, lambda e: e["longest"] * (1 + 1e-9) + 1e-6 >= F.col("low"))
    upto = F.least(F.coalesce(F.array_max(F.transform(able, lambda e: e["n"])), F.lit(0).cast("long")), F.lit(last).cast("long"))
    rows = packed.withColumn("upto", upto).where(F.col("upto") >= first)
    return rows.select("q", F.explode(F.sequence(F.lit(first).cast("long"), F.col("upto"))).alias("c"), "floors")


def _unpack(batches):
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["q_ids"], "<i8")
            norm = np.sqrt((np.frombuffer(r["q_vecs"], "<i8").reshape(len(ids), -1).astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), r["q"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), pa.array(norm)], names=["q", "at", "query_id", "norm"]
            )


def _pack_floors(batches):
    for b in batches:
        rows = b.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["q"] for r in rows], pa.int64()), pa.array([r["low"] for r in rows], pa.float64()), pa.array([np.asarray(r["f"], "<f8").tobytes() for r in rows], pa.binary())],
            names=["q", "low", "floors"],
        )


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return topk(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
