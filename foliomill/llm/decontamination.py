"""Benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

The test items are the indexed side. Long items are cut into chunks; every chunk's BM25 impacts are divided by what the
chunk scores against itself, so that one threshold serves all. Posting lists are in blocks with the largest impact of
each block. Every passage of every training text (``PASSAGE`` words, moving by half) is a query. Of every
chunk the most frequent words, up to half the threshold together, are left out of a filter index and counted in full as
the chunk's spare; a passage that finds no chunk whose filtered score and spare reach the threshold is done. For the
others WAND with block maxima finds all chunks at or above the threshold. A hit counts when the words around it hold enough of the item's question and of its answer.

The index is cut into shards of at most ``SHARD`` chunks, which bounds what is broadcast at once and what a worker holds
(``LIVE`` shards). Texts are read once for every ``LIVE`` shards: some 100,000 items. Document frequencies and lengths
are those of the whole benchmark in every shard.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+")
CHUNK, PASSAGE = 48, 96
SHARD, BLOCK, LIVE = 1 << 15, 64, 4
THRESHOLD, OVERLAP = 0.6, 0.7
K1, B = 1.2, 0.75
#: Chunks of a shard that hold a word before the filter index may leave it out.
FREQUENT = 8
LEAK = "array<struct<item_id:bigint,word:bigint,score:double,question:double,answer:double>>"
LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("word", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """(question, answer): the answer is the last sentence or line, a quarter of the words at least."""
    pieces = [words(p) for p in re.split(r"\n+|(?<=[.!?])\s+", text)]
    pieces = [p for p in pieces if p]
    every = [w for p in pieces for w in p]
    cut = min(len(every) - len(pieces[-1]), len(every) * 3 // 4) if pieces else 0
    return every[:cut], every[cut:]


def grams(tokens: list[str], n: int) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(tokens)))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def contained(part: list[str], region: list[str], n: int) -> float:
    """Share of the part's n-grams that the region holds; 1 for an empty part."""
    if not part:
        return 1.0
    n = max(1, min(n, len(part)))
    own = grams(part, n)
    return len(own & grams(region, n)) / len(own) if len(region) >= n else 0.0


@dataclass
class Index:
    """Inverted index of chunks: posting lists of (chunk, impact) by rising chunk, one after the other by term."""

    term: dict[str, int] = field(default_factory=dict)
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    impacts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: For each posting the largest impact of its term in its block of chunks.
    ceiling: np.ndarray = field(default_factory=lambda: np.zeros(0))
    highest: np.ndarray = field(default_factory=lambda: np.zeros(1))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: The filter index in the same form, and for each chunk the summed impacts of the words that it leaves out.
    filter_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    filter_chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    filter_impacts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spare: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Item id, question and answer (as terms) of each item key.
    parts: dict[int, tuple[int, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, chunks: list[tuple[int, list[str]]], parts: dict[int, tuple[int, list[str], list[str]]], whole: tuple[int, float, dict[str, int]] | None = None, spare: float = THRESHOLD / 2) -> Index:
        """``whole``: number of chunks, their mean length and how many hold each word, where there are more than ``chunks``."""
        n = len(chunks)
        total, mean, holding = whole or (n, sum(len(c) for _, c in chunks) / max(1, n), {})
        out, lengths = cls(item=np.array([i for i, _ in chunks], np.int64)), np.array([len(c) for _, c in chunks], np.float64)
        code = out.term
        terms = np.array([code.setdefault(w, len(code)) for _, c in chunks for w in c], np.int64)
        of = np.repeat(np.arange(n), lengths.astype(np.int64))
        pair, f = np.unique(terms * max(1, n) + of, return_counts=True)
        t, k = pair // max(1, n), pair % max(1, n)
        own_df = df = np.bincount(t, minlength=len(code)).astype(np.float64)
        if holding:
            df = np.array([holding.get(w, d) for w, d in zip(code, df)], np.float64)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        x = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[k] / mean))
        x = x / np.bincount(k, x, n)[k]
        out.at = np.searchsorted(t, np.arange(len(code) + 1))
        out.chunks, out.impacts = k.astype(np.int32), x
        # postings are sorted by term and chunk, so each block of a term is a run
        cell = np.flatnonzero(np.diff(t * (n // BLOCK + 1) + k // BLOCK, prepend=-1))
        if len(x):
            out.ceiling = np.repeat(np.maximum.reduceat(x, cell), np.diff(np.append(cell, len(x))))
        out.highest = np.append(np.maximum.reduceat(x, out.at[:-1]), 0.0) if len(code) else np.zeros(1)
        # frequent words first within each chunk
        by = np.lexsort((t, -own_df[t], k))
        cum = np.cumsum(x[by])
        cum -= np.repeat((cum - x[by])[np.flatnonzero(np.diff(k[by], prepend=-1))], np.bincount(k, minlength=n)) if len(x) else 0
        left_out = np.zeros(len(x), bool)
        left_out[by] = (cum <= spare) & (own_df[t[by]] >= FREQUENT)
        out.spare = np.bincount(k[left_out], x[left_out], n)
        out.filter_at = np.searchsorted(t[~left_out], np.arange(len(code) + 2))
        out.filter_chunks, out.filter_impacts = out.chunks[~left_out], x[~left_out]
        codes = lambda own: np.array([code[w] for w in own], np.int32)
        out.parts = {key: (item, codes(q), codes(r)) for key, (item, q, r) in parts.items()}
        return out

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and impacts of a term."""
        own = slice(self.at[t], self.at[t + 1])
        return self.chunks[own], self.impacts[own]

    def candidates(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Passages, of distinct pairs (passage, term), that may hold a chunk: no other one reaches the threshold."""
        span = self.filter_at[term + 1] - self.filter_at[term]
        ends = np.cumsum(span)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int64)
        at = np.arange(ends[-1]) + np.repeat(self.filter_at[term] - (ends - span), span)
        key = np.repeat(passage, span) * len(self.item) + self.filter_chunks[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        cell = np.flatnonzero(np.diff(key, prepend=-1))
        score = np.add.reduceat(self.filter_impacts[at][order], cell) + self.spare[key[cell] % len(self.item)]
        return np.unique(key[cell][score >= threshold - 1e-6] // len(self.item))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All chunks that score at least ``threshold`` for the distinct ``terms``: WAND with block maxima."""
        slack = 1e-9
        at, chunks = self.at, self.chunks
        cursors = [[int(chunks[at[t]]), t, int(at[t])] for t in terms]
        found: list[tuple[int, float]] = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _p) in enumerate(cursors):
                bound += self.highest[t]
                if bound >= threshold - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            chunk = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == chunk:
                pivot += 1
            block = chunk // BLOCK
            if sum(self._ceiling(t, p, block) for _, t, p in cursors[: pivot + 1]) < threshold - slack:
                # nothing up to the end of this block, or to the next cursor, can reach the threshold
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(goal, chunk + 1))
            elif cursors[0][0] == chunk:
                score = sum(float(self.impacts[p]) for _, _t, p in cursors[: pivot + 1])
                if score >= threshold - slack:
                    found.append((chunk, score))
                self._advance(cursors, pivot + 1, chunk + 1)
            else:
                self._advance(cursors, pivot, chunk)
        return found

    def _ceiling(self, t: int, p: int, block: int) -> float:
        """The largest impact of a term in a block, for a cursor at or before it."""
        end = int(self.at[t + 1])
        if self.chunks[p] // BLOCK < block:
            p += int(np.searchsorted(self.chunks[p:end], block * BLOCK))
        return float(self.ceiling[p]) if p < end and self.chunks[p] // BLOCK == block else 0.0

    def _advance(self, cursors: list[list[int]], upto: int, goal: int) -> None:
        """Moves the first cursors to their first chunk at or beyond ``goal``; exhausted ones go."""
        for c in cursors[:upto]:
            if c[0] < goal:
                end = int(self.at[c[1] + 1])
                c[2] += int(np.searchsorted(self.chunks[c[2] : end], goal))
                c[0] = int(self.chunks[c[2]]) if c[2] < end else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]


def cut(text: str) -> tuple[list[str], list[str], list[list[str]]]:
    """Question, answer and chunks of an item."""
    question, answer = split_item(text)
    every = question + answer
    pieces = -(-len(every) // CHUNK)
    cuts = [len(every) * k // pieces for k in range(pieces + 1)] if pieces else [0]
    return question, answer, [every[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def statistics(items: DataFrame) -> DataFrame:
    """(word, n, length): in how many chunks of all ``items`` a word stands; the row of the null word has the number of chunks and of their words."""

    def run(batches):
        for b in batches:
            for part in common.slices(b):
                held, length = Counter(), 0
                for t in common.texts(part):
                    for c in cut(t)[2]:
                        held.update({None, *c})
                        length += len(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([0 if w is not None else length for w in held], pa.int64())],
                    names=["word", "n", "length"],
                )

    return items.select("text").mapInArrow(run, "word string, n long, length long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def shards(benchmark: DataFrame, spare: float = THRESHOLD / 2) -> Iterator[Index]:
    """Indexes of at most ``SHARD`` chunks, one at a time; items are streamed to the driver. Items without words hold nothing."""
    spark = benchmark.sparkSession
    chunks: list[tuple[int, list[str]]] = []
    parts: dict[int, tuple[int, list[str], list[str]]] = {}
    counted, total, mean = None, 0, 0.0
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").dropDuplicates(["item_id", "text"])

    def build() -> Index:
        if counted is None:
            return Index.build(chunks, parts, spare=spare)
        own = spark.createDataFrame([(w,) for w in sorted({w for _, c in chunks for w in c})], "word string")
        return Index.build(chunks, parts, (total, mean, {r.word: r.n for r in counted.join(F.broadcast(own), "word").collect()}), spare)

    taken = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        question, answer, own = cut(r.text)
        if not own:
            continue
        if chunks and len(chunks) + len(own) > SHARD:
            if counted is None:
                counted = common.Scratch(spark, "leaks").keep(statistics(rows))
                whole = counted.where(F.col("word").isNull()).first()
                total, mean = whole.n, whole.length / whole.n
            yield build()
            chunks, parts = [], {}
        key = taken  # several texts may share an item_id
        taken += 1
        parts[key] = (r.item_id, question, answer)
        chunks += [(key, c) for c in own]
    if chunks:
        yield build()


def leaks_in(texts: list[list[str]], index: Index, threshold: float, overlap: float) -> list[list[tuple]]:
    """For each text (as words) its leaks (item_id, first word of the passage, score, question and answer overlap)."""
    half, get, none = PASSAGE // 2, index.term.get, len(index.term)
    out: list[list[tuple]] = [[] for _ in texts]
    ids = [np.fromiter((get(w, none) for w in tokens), np.int32, len(tokens)) for tokens in texts]
    size = np.array([len(x) for x in ids], np.int64)
    many = np.maximum(1, -(-(size - half) // half))  # passages of each text
    base = np.cumsum(many) - many
    of = np.repeat(np.arange(len(ids)), size)
    own = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    known = np.flatnonzero(own != none)
    place, of, own = (np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size))[known] // half, of[known], own[known]
    # each half passage belongs to two passages
    pairs = [(base[of] + k)[(k >= 0) & (k < many[of])] * (none + 1) + own[(k >= 0) & (k < many[of])] for k in (place - 1, place)]
    pairs = np.sort(np.concatenate(pairs))
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    able = index.candidates(pairs // (none + 1), pairs % (none + 1), threshold)
    best: dict[tuple[int, int], tuple] = {}
    for g, d in zip(able.tolist(), (np.searchsorted(base, able, "right") - 1).tolist()):
        a = (g - int(base[d])) * half
        terms = pairs[slice(*np.searchsorted(pairs, [g * (none + 1), (g + 1) * (none + 1)]))] % (none + 1)
        for chunk, score in index.search(terms.tolist(), threshold):
            key = int(index.item[chunk])
            item_id, question, answer = index.parts[key]
            reach = len(question) + len(answer)
            region = ids[d][max(0, a - reach) : a + PASSAGE + reach].tolist()
            q, r = contained(question.tolist(), region, 5), contained(answer.tolist(), region, 3)
            if q >= overlap and r >= overlap and ((d, key) not in best or score > best[d, key][2] + 1e-12):
                best[d, key] = (item_id, a, score, q, r)
    for d, key in sorted(best):
        out[d].append(best[d, key])
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Adds ``leaks`` to every row: the items found in its text, with place, score and overlaps.

    Null and empty texts, and an empty benchmark, give empty lists. Equal scores of several passages keep the first.
    Repeated rows get equal lists; a column ``leaks`` in ``docs`` is replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    out, scratch, live = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAK)), None, []
    for index in shards(benchmark, threshold / 2):
        if len(live) == LIVE:  # so many shards that not all fit a worker: what they find is written, then the next ones are dealt
            scratch = scratch or common.Scratch(spark, "leaks")
            out, before = scratch.keep(_pass(out, live, threshold, overlap)), live
            for b in before:
                b.unpersist()
            live = []
        live.append(spark.sparkContext.broadcast(index))
    return _pass(out, live, threshold, overlap) if live else out


def _pass(docs: DataFrame, live: list, threshold: float, overlap: float) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("leaks")
            both, tokens = batch.column(at).to_pylist(), [words(t) for t in common.texts(batch)]
            keys = [f.name for f in LEAK_TYPE.value_type]
            for shared in live:
                found = leaks_in(tokens, shared.value, threshold, overlap)
                both = [old + [dict(zip(keys, x)) for x in new] for old, new in zip(both, found)]
            arrays = [*batch.columns]
            arrays[at] = pa.array(both, LEAK_TYPE)
            return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

        return kernel

    return common.map_arrow(docs, make, schema)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("x"))
    return found.select(
        "doc_id", "x.item_id", F.col("x.word").alias("first_word"), F.col("x.score").alias("bm25_share"),
        F.col("x.question").alias("question_overlap"), F.col("x.answer").alias("answer_overlap"),
    )
