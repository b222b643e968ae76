"""N-gram Jaccard join with rare-first prefix filtering, as classes of linked documents.

A document is its set of word n-grams (64-bit hashes). Documents with equal sets collapse to one node. The n-grams of a
set are ordered rare-first by a frequency sketch over the whole corpus; two sets that are similar enough share an n-gram
among the first ``n - ceil(t n) + 1`` of each, and only those prefixes are joined. Length and positional bounds prune
within the join, a partition bound on the rest of the sets (suffix filter) prunes before the exact count, and each
pair is verified once.

Groups of near copies share all their prefixes, so joining everyone with everyone would be quadratic. Two steps avoid
it without losing a link between components: first every prefix n-gram's members meet the member that has it earliest
(the plainest copy), which is linear; then only members that are still in different components meet, by n-gram and
length class, so that the bounds exclude pairs before they are formed.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SKETCH_BITS, SKETCH_BLOCKS = 20, 256
CACHE = 400_000
#: Where sets are cut for the suffix filter: sixteen equal ranges of hashes.
CUTS = np.uint64(1 << 60) * np.arange(1, 16, dtype=np.uint64)
_MULTIPLIERS = (np.random.default_rng(20240607).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
#: Ratio of neighbouring length classes in the last join.
LENGTH_STEP = 1.03


class Shingler:
    """Sorted distinct hashes of a text's word n-grams; ASCII letters count as lower case, words end at ASCII space."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > CACHE:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        m = len(h) - k + 1
        with np.errstate(over="ignore"):
            x = h[:m] * _MULTIPLIERS[0]
            for j in range(1, k):
                x = x + h[j : j + m] * _MULTIPLIERS[j % 64] + np.uint64(j)
            return np.unique(common.mix64(x + np.uint64(k)))


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of hashed n-grams over all documents: a table of fixed size (4 MB), summed in the cluster by block."""
    width = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def emit(total: np.ndarray) -> pa.RecordBatch:
        blocks = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in total.reshape(SKETCH_BLOCKS, width)]
        return pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def count(batches):
        shingler, total = Shingler(n), np.zeros(1 << SKETCH_BITS, np.uint64)
        for b in batches:
            for part in common.slices(b):
                sets = [shingler(t) for t in common.texts(part)]
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint64)
        yield emit(total)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(zlib.decompress(x.as_py()), np.uint64)
                sums[k] = sums[k] + own if k in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros((SKETCH_BLOCKS, width), np.uint64)
    for r in rows.collect():
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), np.uint64)
    return out.ravel()


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    num: int
    den: int

    def least(self, size: np.ndarray | int):
        """Overlap that a set of this size shares with any partner: ceil(t * size)."""
        return -(-(size * self.num) // self.den)

    def need(self, a: Column, b: Column) -> Column:
        """Overlap that two sets of these sizes need: ceil(t (a + b) / (1 + t))."""
        s, top = self.num + self.den, (a + b) * self.num + (self.num + self.den - 1)
        return (top - F.pmod(top, F.lit(s))) / F.lit(s)


def _sets(docs: DataFrame, n: int, t: Threshold, counts: np.ndarray) -> DataFrame:
    """(doc_id, th, fp, n, parts, prefix): text hash, fingerprint, size and part sizes of each row's set, its rarest n-grams first."""
    # only the order of the counts matters: as ranks they fit 20 bits whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(counts, return_inverse=True)[1].astype(np.uint32))

    def make():
        table, shingler = shared.value, Shingler(n)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps, sizes, parts, prefixes = [], [], [], []
            for text in common.texts(batch):
                s = shingler(text)
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                parts.append(np.diff(np.searchsorted(s, CUTS), prepend=0, append=len(s)).astype(np.int32))
                if len(s):
                    seen = table[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                    order = np.argsort((seen << np.uint64(40)) | (s >> np.uint64(24)), kind="stable")
                    prefixes.append(s[order[: len(s) - t.least(len(s)) + 1]].view(np.int64))
                else:
                    prefixes.append(np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            cols = [batch.column("doc_id"), batch.column("th"), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int32())), lists]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "fp", "n", "parts", "prefix"])

        return kernel

    return common.map_arrow(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp binary, n long, parts array<int>, prefix array<bigint>")


def _full_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, grams): whole sets of the given nodes (node, fp, doc), read again from a document that has them."""
    wanted = nodes.select(F.col("doc").alias("_doc"), F.col("fp").alias("_fp"), "node")
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "_fp", "text")

    def make():
        shingler = Shingler(n)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, out = [], []
            for node, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch)):
                s = shingler(text).tobytes()
                if hashlib.blake2b(s, digest_size=16).digest() == fp:  # another row may have the same doc_id
                    ids.append(node)
                    out.append(s)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["node", "grams"]) if ids else None

        return kernel

    return common.map_arrow(rows, make, "node long, grams binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    num, den = t.num, t.den

    def kernel(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common_n = int((x[at] == y).sum())
                keep.append(den * common_n >= num * (both - common_n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(kernel, "a long, b long")


def linked(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links.

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of ``n``-word shingles; a text with fewer
    words is one shingle. Rows without words or text have an empty set and link with nothing: their component is their
    own doc_id. Repeated rows link with each other. Other columns of ``docs`` are ignored; an empty table gives an empty
    result. Rows without doc_id keep a null component unless they link with a row that has one.
    """
    return Join(docs, n, Threshold(num, den)).classes()


class Join:
    def __init__(self, docs: DataFrame, n: int, t: Threshold):
        self.docs, self.n, self.t = docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), n, t
        self.scratch = common.Scratch(docs.sparkSession, "ngrams")

    def classes(self, by_row: bool = False) -> DataFrame:
        """(doc_id, n_shingles, component_id), or for ``by_row`` (doc_id, th, n_shingles, label) with the class's own number."""
        keep = self.scratch.keep
        rows = keep(_sets(self.docs, self.n, self.t, sketch(self.docs, self.n)))
        full = rows.where("n > 0")
        nodes = full.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("prefix").alias("prefix"))
        nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()))
        links = self._links(nodes)
        labels = components(links, self.scratch)
        named = nodes.select("node", "fp", "doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = keep(named.select("fp", "doc", "label"))
        if by_row:
            of = named.select(F.col("fp").alias("_fp"), "label")
            return self.scratch.only(rows.select("doc_id", "th", "fp", F.col("n").alias("n_shingles")).join(of, F.col("fp") == F.col("_fp"), "left").drop("fp", "_fp"))
        smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
        of = named.join(smallest, "label").select(F.col("fp").alias("_fp"), "component_id")
        out = rows.select("doc_id", "fp", F.col("n").alias("n_shingles")).join(of, F.col("fp") == F.col("_fp"), "left")
        # the classes are small; what led to them can go
        return self.scratch.only(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))

    def _fits(self, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
        """Length and positional filter for an n-gram at places ``pa_`` and ``pb`` (from 0) of two ordered sets."""
        longer, shorter = F.greatest(na, nb), F.least(na, nb)
        return (shorter * self.t.den >= longer * self.t.num) & (F.least(na - pa_, nb - pb) >= self.t.need(na, nb))

    def _links(self, nodes: DataFrame) -> DataFrame:
        """Verified links that leave the same components as all links would."""
        keep = self.scratch.keep
        postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        several = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        shared = keep(postings.join(several, "token"))
        hubs = shared.groupBy("token").agg(F.min_by("node", "pos").alias("hub"), F.min_by("n", "pos").alias("hub_n"), F.min("pos").alias("hub_pos"))
        met = shared.join(hubs, "token")
        star = met.where((F.col("node") != F.col("hub")) & self._fits(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos")))
        star = keep(self._near(star.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct(), nodes))
        ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = keep(_full_sets(self.docs, nodes.join(ends(star), "node", "left_semi"), self.n))
        links = keep(_verified(star, sets, self.t))
        labels = components(links, self.scratch)
        rest = keep(self._near(self._apart(shared, labels).join(star, ["a", "b"], "left_anti"), nodes))
        if rest.isEmpty():
            return links
        more = ends(rest).join(sets, "node", "left_anti")
        sets = sets.unionByName(_full_sets(self.docs, nodes.join(more, "node", "left_semi"), self.n))
        return links.unionByName(_verified(rest, sets, self.t))

    def _near(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Suffix filter, before any set moves: sets cut at the same hashes differ by at least the differences of their part sizes."""
        own = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("parts").alias(f"p{k}"))
        rows = pairs.join(own("a"), "a").join(own("b"), "b")
        differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
        return rows.where(F.col("na") + F.col("nb") - differ >= 2 * self.t.need(F.col("na"), F.col("nb"))).select("a", "b")

    def _apart(self, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """Candidate pairs in different components that share a prefix n-gram and pass the length and positional bounds."""
        t = self.t
        entries = shared.select("token", "node", "n", "pos").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        entries = self.scratch.keep(entries)
        mixed = entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        entries = entries.join(mixed, "token", "left_semi")
        size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(LENGTH_STEP)) + 1e-9)
        # the shorter partner: what follows must hold the overlap that even an equally long partner needs
        x = entries.where(F.col("n") - F.col("pos") >= t.need(F.col("n"), F.col("n"))).select(
            "token", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("label").alias("lx"), size_class(F.col("n")).alias("class")
        )
        # the longer partner looks in the length classes that its place allows
        most = F.least(F.col("n"), F.floor((F.col("n") - F.col("pos")) * (t.num + t.den) / F.lit(t.num)) - F.col("n"))
        lowest = F.ceil(F.col("n") * t.num / F.lit(t.den))
        y = entries.withColumns({"most": most, "lowest": lowest}).where("most >= lowest").select(
            "token", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("label").alias("ly"),
            F.explode(F.sequence(size_class(F.greatest("lowest", F.lit(1))), size_class(F.col("most")))).alias("class"),
        )
        ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
        pairs = x.join(y, ["token", "class"]).where((F.col("lx") != F.col("ly")) & ordered & self._fits(F.col("nx"), F.col("px"), F.col("ny"), F.col("py")))
        return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest doc_id stays, null last.

    Of several texts with that doc_id the one with the smallest hash stays. Rows without words link with nothing and
    stay. Rows equal in doc_id and text count as one row. All columns stay.
    """
    docs = docs.drop("__own")
    rows = Join(docs, n, Threshold(num, den)).classes(by_row=True)
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("th").alias("t"))
    members = rows.where("n_shingles > 0")
    stays = members.groupBy("label").agg(F.min(first).alias("w"))
    goes = members.join(stays, "label").where(~first.eqNullSafe(F.col("w"))).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    again = rows.groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    same = (F.col("__own") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    left = docs.withColumn("__own", F.xxhash64("text")).join(goes, same, "left_anti")
    if again.isEmpty():  # else texts would move for nothing
        return left.drop("__own")
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).drop("__own")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"), 3, 9, 10)
