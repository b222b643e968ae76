"""Exact substring dedup: bytes covered by a string of ``least`` bytes that starts more than once in the corpus.

Where equal windows of ``least`` bytes can meet is found by content: each window names the smallest hash among its
``SEED``-byte strings (leftmost on ties), so equal windows name equal seeds. Windows in a row with one seed form a
context. Contexts with a seed that occurs once are done; equal contexts collapse to one with a count, before any of their
bytes move. What is left (different contexts around one seed) goes, a few megabytes at a time, through interval
expansion on the Burrows-Wheeler transform of the contexts (``bwt.py``), which finds every repeated window exactly.

A seed with very many different contexts (a passage that thousands of documents share) would be one task's work. Its
windows are split by content instead, level by level: into cells of ``WIDTHS`` window starts by their distance from the
seed. All windows of a cell hold one core, so only equal cores can hold equal windows: a core that occurs once is done,
equal cells collapse to a count, and only different cells with one core (at the passage's borders) are split further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .bwt import MOST, repeated, shared

SEED = 32
#: Window starts looked at together; a longer text is cut into such stretches that overlap by a window.
STRETCH = 1 << 20
#: Bytes hashed together.
HASHED = 1 << 16
#: Bytes of contexts in one transform, different contexts of one seed that go together.
TEXT, GROUP = 1 << 20, 512
#: Window starts in a cell, from level to level.
WIDTHS = (96, 24, 6, 1)
#: Distances before a seed whose windows are looked at together, before any transform.
CELL = 48
RUN = "least int, ah long, dg long, s0 int, s1 int, seed int"
#: An odd factor and its inverse modulo 2**64, for digests that do not depend on the place.
_FACTOR = 0x9FB21C651E98DF25
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: list[np.ndarray] = []
_BYTES = common.mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51_7C_C1_B7))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes; width is a power of two. Parts are small enough for a core's cache."""
    if len(data) > HASHED + width:
        return np.concatenate([_hashes(data[a : a + HASHED + width - 1], width) for a in range(0, len(data) - width + 1, HASHED)])
    h = _BYTES[data]
    n = 1
    with np.errstate(over="ignore"):
        while n < width:
            h = h[:-n] * np.uint64(0x9E3779B97F4A7C15) + (h[n:] ^ (h[n:] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            n *= 2
    return h


def _factors(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, from 0 on; kept for the worker's next texts."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, f, np.uint64)])) for f in (_FACTOR, _INVERSE)]
    return _powers


def contexts(data: np.ndarray, ends: np.ndarray, leasts: Sequence[int]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """For each length of windows (rising) the runs of windows with one seed, of all texts that ``data`` joins.

    ``ends`` are the texts' ends. A run has its text's number, seed hash, digest of its bytes, first and last window start and the
    seed's place, all from the text's start. Windows never leave their text. A digest is a polynomial in the hashes of all
    32-byte strings of the run.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    longest = leasts[-1]
    for base in range(0, len(data) - leasts[0] + 1, STRETCH):
        part = data[base : base + STRETCH + longest - 1]
        if len(part) < leasts[0]:
            break
        h = _hashes(part, SEED)
        up, down = _factors(len(h) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * down[: len(h)])])
        low, n = (h >> np.uint64(23) << np.uint64(23)) | np.arange(len(h), dtype=np.uint64), 1
        inner = np.clip(ends - base, 0, min(STRETCH, len(part)))
        of = np.repeat(np.arange(len(ends)), np.diff(inner, prepend=0))
        for least in leasts:
            width, many = least - SEED + 1, min(STRETCH, len(part) - least + 1)
            if many <= 0:
                break
            while 2 * n <= width:
                low = np.minimum(low[:-n], low[n:])
                n *= 2
            smallest = low[:many] if width == n else np.minimum(low[:many], low[width - n : width - n + many])
            seed = (smallest & np.uint64((1 << 23) - 1)).astype(np.int64)
            inside = np.flatnonzero(ends[of[:many]] - base - np.arange(many) >= least)
            if not len(inside):
                continue
            own = seed[inside]
            cut = np.flatnonzero((own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)) + 1
            s0, s1 = inside[np.concatenate([[0], cut])], inside[np.concatenate([cut, [len(inside)]]) - 1]
            k, to = seed[s0], s1 + least - SEED + 1
            with np.errstate(over="ignore"):
                dg = common.mix64((total[to] - total[s0]) * up[s0] + (to - s0).astype(np.uint64))
            text = of[s0]
            shift = base - starts[text]
            yield least, {"text": text, "ah": h[k].view(np.int64), "dg": dg.view(np.int64), "s0": s0 + shift, "s1": s1 + shift, "seed": k + shift}


def cells(data: bytes, first: int, lo: int, hi: int, seed: int, width: int, least: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first and last window start, digest of the core, digest of the cell) of windows ``lo`` to ``hi``, by distance from the seed.

    ``data`` holds the bytes from place ``first`` on.
    """
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    at = lo
    while at <= hi:
        far = (seed - at) // width * width  # the cell's windows start from far to far + width - 1 before the seed
        end = min(hi, seed - far)
        farthest = min(far + width - 1, least - SEED)
        core = digest(b"%d:" % far + data[seed - far - first : seed - farthest + least - first])
        yield at, end, core, digest(b"%d:" % (seed - at) + data[at - first : end + least - first])
        at = end + 1


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in common.texts(batch)]


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one array of bytes, and the end of each; null counts as empty."""
    column = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at[1:] - at[0]


def _runs(docs: DataFrame, leasts: Sequence[int]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {"ah": pa.int64(), "dg": pa.int64(), "s0": pa.int32(), "s1": pa.int32(), "seed": pa.int32()}

    def make():
        def kernel(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for least, x in contexts(*_joined(batch), leasts):
                cols = [batch.column(c).take(pa.array(x["text"])) for c in ("doc_id", "th")]
                cols += [pa.array(np.full(len(x["text"]), least, np.int32)), *(pa.array(x[k].astype(t.to_pandas_dtype())) for k, t in types.items())]
                out.append(pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "least", *types]))
            return out

        return kernel

    return common.map_arrow(docs, make, f"doc_id {kind}, th long, {RUN}")


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, th, text, runs): the wanted runs (ah, dg, s0, s1, seed) of each document, with its text read again."""
    per_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("ah", "dg", "s0", "s1", "seed", "hot")).alias("runs"))
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "runs")
    return docs.join(per_doc, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "th", "text", "runs")


def _cut(rows: DataFrame, least: int) -> DataFrame:
    """(doc_id, th, ah, dg, s0, seed, hot, bytes) of each wanted context."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = {"ah": pa.int64(), "dg": pa.int64(), "s0": pa.int32(), "seed": pa.int32(), "hot": pa.bool_()}

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, out, held = [], {k: [] for k in types}, []
            for i, (b, runs) in enumerate(zip(_bytes(batch), batch.column(batch.schema.get_field_index("runs")).to_pylist())):
                for r in runs:
                    at.append(i)
                    for k in types:
                        out[k].append(r[k])
                    held.append(b[r["s0"] : r["s1"] + least])
            cols = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in ("doc_id", "th")]
            cols += [*(pa.array(out[k], t) for k, t in types.items()), pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", *types, "bytes"])

        return kernel

    return common.map_arrow(rows, make, f"doc_id {kind}, th long, ah long, dg long, s0 int, seed int, hot boolean, bytes binary")


def _meeting(group: list[dict], least: int) -> list[dict]:
    """The contexts of one seed that another one may share a window with, and no fewer; rows repeated as a whole go.

    Equal windows stand equally far before the seed. So they hold one core of those that ``CELL`` distances in a row
    have in common, and a context whose cores are all its own has no window that occurs elsewhere.
    """
    seen: set[int] = set()
    group = [r for r in group if r["dg"] not in seen and not seen.add(r["dg"])]
    if len(group) < 2:
        return []
    holders: dict[tuple[int, bytes], list[int]] = {}
    for i, r in enumerate(group):
        b, k = r["bytes"], r["seed"] - r["s0"]
        for far in range(max(0, k - len(b) + least) // CELL * CELL, k + 1, CELL):
            holders.setdefault((far, b[k - far : k - min(far + CELL - 1, least - SEED) + least]), []).append(i)
    meet = {i for x in holders.values() if len(x) > 1 for i in x}
    return [r for i, r in enumerate(group) if i in meet]


def _expanded(cut: DataFrame, least: int, keep_first: bool = False, across: bool = False) -> DataFrame:
    """(doc_id, th, lo, hi): stretches of windows to remove, by interval expansion over whole seeds.

    With ``across`` (doc_id, th) of the texts that share a window with another text.
    """
    kind = cut.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(cut.schema["doc_id"].dataType)
    rows = cut.repartition("ah").sortWithinPartitions("ah", "doc_id", "th", "s0")

    def solve(held: list[dict]) -> pa.RecordBatch:
        # one piece for each context; the corpus order decides which of equal windows is the first
        held.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["th"], r["s0"]))
        pieces = [r["bytes"] for r in held]
        if across:
            texts: dict[tuple, int] = {}
            owner = [texts.setdefault((r["doc_id"], r["th"]), len(texts)) for r in held]
            names = [k for k, hit in zip(texts, shared(pieces, owner, least)) if hit]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in names], id_type), pa.array([k[1] for k in names], pa.int64())], names=["doc_id", "th"])
        at, lo, hi = [], [], []
        for i, (r, g) in enumerate(zip(held, repeated(pieces, least, keep_first)[0])):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))) + r["s0"]
            at += [i] * (len(edge) // 2)
            lo += edge[::2].tolist()
            hi += (edge[1::2] - 1).tolist()
        cols = [pa.array([held[i]["doc_id"] for i in at], id_type), pa.array([held[i]["th"] for i in at], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc_id", "th", "lo", "hi"])

    def run(batches):
        held: list[dict] = []
        size = 0
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, lambda r: r["ah"]):
            own = _meeting(list(group), least)
            held += own
            size += sum(len(r["bytes"]) + 1 for r in own)
            if size > TEXT:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    schema = f"doc_id {kind}, th long" + ("" if across else ", lo int, hi int")
    return rows.select("ah", "dg", "doc_id", "th", "s0", "seed", "bytes").mapInArrow(run, schema)


def _cells(work: DataFrame, width: int, least: int) -> DataFrame:
    """(doc_id, th, s0, lo, hi, core, own): cells of the open ranges of each context."""
    kind = work.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [
                (i, *c)
                for i, r in enumerate(batch.select(["s0", "seed", "bytes", "ranges"]).to_pylist())
                for x in r["ranges"]
                for c in cells(r["bytes"], r["s0"], x["lo"], x["hi"], r["seed"], width, least)
            ]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("doc_id", "th", "s0")]
            cols += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "s0", "lo", "hi", "core", "own"])

    return work.mapInArrow(run, f"doc_id {kind}, th long, s0 int, lo int, hi int, core binary, own binary")


def _crossed(hot: DataFrame, scratch: common.Scratch, least: int, keep_first: bool = False, across: bool = False) -> DataFrame:
    """(doc_id, th, lo, hi) for the contexts of hot seeds, by cells that get narrower until they are single windows.

    With ``across`` only windows that several texts hold.
    """
    whole = F.array(F.struct(F.col("s0").alias("lo"), (F.col("s0") + F.octet_length("bytes") - least).alias("hi")))
    work, out = hot.withColumn("ranges", whole), None
    for width in WIDTHS:
        each = scratch.keep(_cells(work, width, least))
        same = scratch.keep(each.groupBy("core", "own").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi", "s0")).alias("lead"), F.max(F.struct("doc_id", "th")).alias("last")))
        equal = same.where(~F.struct("lead.doc_id", "lead.th").eqNullSafe(F.col("last")) if across else F.col("n") > 1).select(F.col("core").alias("_c"), F.col("own").alias("_o"), "lead")
        marks = each.join(equal, (F.col("core") == F.col("_c")) & (F.col("own") == F.col("_o")))
        if keep_first:
            marks = marks.where(~F.struct("doc_id", "th", "lo").eqNullSafe(F.struct("lead.doc_id", "lead.th", "lead.lo")))
        marks = marks.select("doc_id", "th", "lo", "hi")
        out = marks if out is None else out.unionByName(marks)
        mixed = same.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select(F.col("core").alias("_c"))
        open_ = same.join(mixed, F.col("core") == F.col("_c")).select("lead.*")
        open_ = open_.groupBy("doc_id", "th", "s0").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
        open_ = open_.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("s0").alias("_s"), "ranges")
        work = hot.join(open_, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("s0") == F.col("_s"))).drop("_d", "_t", "_s")
    return out


PLACE = ("doc_id", "th", "s0", "s1", "seed")


def _distinct(runs: DataFrame, *more: Column) -> DataFrame:
    """Different contexts, each with a place where it stands: any one, the same row for all of ``PLACE``."""
    return runs.groupBy("ah", "dg").agg(*[F.first(c).alias(c) for c in PLACE], *more)


def _passages(runs: DataFrame, slim: DataFrame, scratch: common.Scratch, least: int) -> DataFrame:
    """(doc_id, th) of the texts that hold a string of ``least`` bytes which another text holds too.

    Most of them show by a context that several texts have. Only for the others do the contexts of their seeds go
    through interval expansion.
    """
    distinct = _distinct(runs, F.max(F.col("doc_id").isNull()).alias("no_id"), *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("doc_id", "th")])
    spread = ~(F.col("lo_doc_id").eqNullSafe(F.col("hi_doc_id")) & (F.col("lo_th") == F.col("hi_th"))) | F.col("lo_doc_id").isNotNull() & F.col("no_id")
    distinct = scratch.keep(distinct.select("ah", "dg", *PLACE, spread.alias("spread")))
    several = distinct.where("spread").select(F.col("ah").alias("_a"), F.col("dg").alias("_g"))
    sure = runs.select("doc_id", "th", "ah", "dg").join(several, (F.col("ah") == F.col("_a")) & (F.col("dg") == F.col("_g")), "left_semi")
    sure = scratch.keep(sure.select("doc_id", "th").distinct())
    known = sure.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    mixed = distinct.groupBy("ah").agg(F.count("*").alias("kinds"), F.min("spread").alias("all")).where("kinds > 1 and not all").select(F.col("ah").alias("_a"), "kinds")
    work = distinct.join(mixed, F.col("ah") == F.col("_a")).drop("_a")
    lone = work.where("not spread").join(known, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")
    seeds = lone.groupBy("ah").agg(F.lit(True).alias("o")).select(F.col("ah").alias("_a"))
    work = work.join(seeds, F.col("ah") == F.col("_a"), "left_semi")
    cut = scratch.keep(_cut(_with_text(slim, work.withColumn("hot", _hot("kinds", least))), least))
    found = sure.unionByName(_expanded(cut.where("not hot"), least, across=True))
    hot = cut.where("hot")
    if not hot.isEmpty():
        found = found.unionByName(_crossed(hot, scratch, least, across=True).select("doc_id", "th"))
    return scratch.only(found.distinct())


def _hot(kinds: str, least: int) -> Column:
    return F.col(kinds) > max(1, min(GROUP, (MOST - TEXT) // (2 * least + 1)))


def find_repeats(docs: DataFrame, least: int = 400, keep_first: bool = False, whole_chars: bool = False, passage: int | None = None) -> DataFrame:
    """Adds ``spans`` (start and end byte of each maximal removed run) and ``kept`` (the other bytes) to every row.

    A byte goes if a string of ``least`` bytes that covers it starts anywhere else too, in the same document or another;
    overlaps count, strings never cross documents and are judged on the input. With ``keep_first`` the first occurrence
    in the order of (doc_id, text hash, place) is not removed. With ``whole_chars`` a run gives back the bytes of characters
    that it holds only a part of, so that ``kept`` is text again. Null texts count as empty: no spans, no bytes. Rows
    repeated as a whole are occurrences of their own; with ``keep_first`` they share one fate, so one text stays in each.
    With ``passage`` a column ``passage`` tells whether the text holds a string of so many bytes that another text holds
    too (another doc_id or other bytes); it removes nothing. Columns ``spans``, ``kept`` and ``passage`` in ``docs`` are
    replaced; an empty table stays empty.
    """
    if min(least, passage or least) < SEED:
        raise ValueError(f"strings of at least {SEED} bytes")
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "suffix")
    docs = docs.drop("spans", "kept", *(["passage"] if passage else []))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = docs.select("doc_id", text_hash.alias("th"), "text")
    runs, holding = _runs(slim, sorted({least, passage or least})), None
    if passage and passage != least:
        parts = scratch.split(runs, "least", [passage, least])
        aside = common.Scratch(spark, "passages")
        holding = _passages(parts[passage], slim, aside, passage)
        scratch.drop(parts[passage])
        runs = parts[least]
    else:
        runs = scratch.keep(runs)
        holding = _passages(runs, slim, common.Scratch(spark, "passages"), passage) if passage else None
    if keep_first:
        distinct = runs.groupBy("ah", "dg").agg(F.count("*").alias("c"), F.min(F.struct(*PLACE)).alias("lead")).select("ah", "dg", "c", "lead.*")
    else:
        distinct = _distinct(runs, F.count("*").alias("c"))
    distinct = scratch.keep(distinct)
    seeds = distinct.groupBy("ah").agg(F.count("*").alias("kinds"), F.sum("c").alias("total")).where("total > 1").drop("total")
    live = scratch.keep(distinct.join(seeds, "ah"))
    scratch.drop(distinct)
    # contexts that occur twice or more: all their windows are repeated
    twice = live.where("c > 1").select(F.col("ah").alias("_a"), F.col("dg").alias("_g"), F.col("doc_id").alias("ld"), F.col("th").alias("lt"), F.col("s0").alias("ls"))
    copies = runs.join(twice, (F.col("ah") == F.col("_a")) & (F.col("dg") == F.col("_g")))
    if keep_first:
        copies = copies.where(~(F.col("doc_id").eqNullSafe(F.col("ld")) & (F.col("th") == F.col("lt")) & (F.col("s0") == F.col("ls"))))
    marks = copies.select("doc_id", "th", F.col("s0").alias("lo"), F.col("s1").alias("hi"))
    # different contexts around one seed
    several = live.where("kinds > 1").withColumn("hot", _hot("kinds", least))
    cut = scratch.keep(_cut(_with_text(slim, several), least))
    marks = marks.unionByName(_expanded(cut.where("not hot"), least, keep_first))
    hot = cut.where("hot")
    if not hot.isEmpty():
        marks = marks.unionByName(_crossed(hot, scratch, least, keep_first))
    if passage:
        marks = marks.unionByName(holding, allowMissingColumns=True)
    mark = F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))
    per_doc = scratch.only(marks.groupBy("doc_id", "th").agg(F.collect_list(mark).alias("marks"), F.bool_or(F.col("lo").isNull()).alias("holds")))
    per_doc = per_doc.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__hash"), F.col("marks").alias("__marks"), "holds")
    rows = docs.withColumn("__own", text_hash)
    rows = rows.join(per_doc, (F.col("__own") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc", "__hash", "__own")
    rows = rows.withColumn("passage", F.coalesce("holds", F.lit(False))) if passage else rows
    rows = rows.drop("holds")
    return _applied(rows, least, whole_chars)


def _snap(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a run that is whole UTF-8 characters."""
    inside = lambda at: at < len(data) and 0x80 <= data[at] <= 0xBF
    while start < end and inside(start):
        start += 1
    while end > start and inside(end):
        end -= 1
    return start, end


def _applied(rows: DataFrame, least: int, whole_chars: bool) -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name != "__marks"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "spans array<struct<start:bigint,end:bigint>>", "kept binary"])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans, kept = [], []
            for b, own in zip(_bytes(batch), batch.column(batch.schema.get_field_index("__marks"))):
                if not own.is_valid:
                    spans.append([])
                    kept.append(b)
                    continue
                x = own.values.flatten()
                edge = np.zeros(len(b) + 1, np.int32)
                np.add.at(edge, np.asarray(x[0]), 1)
                np.add.at(edge, np.asarray(x[1]) + least, -1)
                gone = np.cumsum(edge[:-1]) > 0
                cuts = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                pairs = list(zip(cuts[::2], cuts[1::2]))
                if whole_chars:
                    pairs = [p for p in (_snap(b, *p) for p in pairs) if p[0] < p[1]]
                spans.append([{"start": a, "end": z} for a, z in pairs])
                borders = [0, *(x for p in pairs for x in p), len(b)]
                kept.append(b"".join(b[a:z] for a, z in zip(borders[::2], borders[1::2])))
            names = [f.name for f in fields]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(spans, span_type), pa.array(kept, pa.binary())], names=[*names, "spans", "kept"])

        return kernel

    return common.map_arrow(rows, make, schema)


#: Bytes of a passage of 50 words of prose, with room for short words (51 words take 300 to 400 bytes mostly).
PASSAGE = 256


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for strings of 400 bytes; ``shares_passage`` (1 or 0) for strings of ``PASSAGE`` bytes across texts."""
    found = find_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("passage").cast("int").alias("shares_passage"),
    )
