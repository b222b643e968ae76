"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from its neighbours on both sides (``SIDE`` on each). Words fall into classes: the most
frequent words of the corpus are classes of their own, all others share classes by their ending. The network, written
in numpy, gives the class of the masked word from the classes around it; within a class a word has its corpus
frequency. The sum of these conditional log-probabilities over all positions scores the document.

Word counts cover the whole corpus. Training is data-parallel: each task trains on every position of each of its
documents from common parameters, and the cluster averages the parameters, weighted by positions, in every round.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOP, ENDINGS, BUCKETS = 95, 32, 8192  # the last two: powers of two
ENDING_BITS = ENDINGS.bit_length() - 1  # bits of a word's hash that tell its ending; the next ones tell its bucket
CLASSES = TOP + ENDINGS + 1  # the last one stands outside a text
OUTSIDE = CLASSES - 1
SIDE, HIDDEN, STRIDE, ROUNDS = 2, 32, 1, 2
#: Counts that a task holds before it adds up those of equal words, and hands them on if half as many are left.
FLUSH = 1 << 20
#: Bytes of text hashed at once; longest word whose bytes are read eight by eight.
PIECE, LONGEST = 1 << 18, 256
#: Ending of a word by its last two bytes; one byte stands in the second row.
_ENDING = np.array([zlib.crc32(bytes([i >> 8, i & 255])) % ENDINGS for i in range(1 << 16)] + [zlib.crc32(bytes([i])) % ENDINGS for i in range(256)], np.uint64)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word (64 bits, the lowest tell its ending); seven bytes at least follow the last word."""
    size = end - start
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = common.mix64(size.astype(np.uint64))
    rest, at = slice(None), start
    left = size
    while len(at):
        x = eight[at].view("<u8")[:, 0] & _FIRST[np.minimum(left, 8)]
        out[rest] = common.mix64(out[rest] * np.uint64(0x9E3779B97F4A7C15) ^ x)
        more = np.flatnonzero((left > 8) & (left <= LONGEST))
        rest = more if isinstance(rest, slice) else rest[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONGEST):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    last = data[end - 1].astype(np.int64)
    two = np.where(size > 1, data[end - 2].astype(np.int64) << 8, 1 << 16)
    return (out & ~np.uint64(ENDINGS - 1) | _ENDING[two + last]).view(np.int64)


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words in each text); the words are those of ``words``."""
    out, sizes = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    raw, first, held = [], 0, 0
    for i, t in enumerate(texts):
        raw.append(t.lower().encode("utf-8", "surrogatepass"))
        held += len(raw[-1])
        if held < PIECE and i + 1 < len(texts):
            continue
        data = np.frombuffer(b"".join([b" ", b" ".join(raw), b" " * 8]), np.uint8)
        gap = (data == 32) | (data - np.uint8(9) < 5)
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        for a in range(0, len(start), PIECE):
            out.append(_hashes(data, start[a : a + PIECE], end[a : a + PIECE]))
        ends = np.cumsum([len(x) + 1 for x in raw])
        sizes[first : i + 1] = np.diff(np.searchsorted(start, ends), prepend=0)
        raw, first, held = [], i + 1, 0
    return np.concatenate(out), sizes


def word_hash(word: bytes) -> int:
    data = np.frombuffer(word + b" " * 8, np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(word)]))[0])


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _summed(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(word)
    word = word[order]
    first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
    return word[first], np.add.reduceat(n[order], first) if len(first) else n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts; ``word`` is a 64-bit hash. Tasks pre-aggregate within bounded memory."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # distinct words and counts of each part

        def merged():
            held[:] = [_summed(*(np.concatenate(x) for x in zip(*held)))]
            return held[0]

        def rows():
            word, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

        for b in batches:
            for part in common.slices(b):
                word = np.sort(hashes(common.texts(part))[0])
                first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
                held.append((word[first], np.diff(first, append=len(word))))
                if sum(len(w) for w, _ in held) > FLUSH and len(merged()[0]) > FLUSH // 2:
                    yield rows()
        if held:
            yield rows()
        common.release()

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return rows.select("word", F.pmod("word", F.lit(ENDINGS)).cast("int").alias("ending"), "n")


@dataclass
class Vocabulary:
    """Class of a frequent word by its hash, and log P(word | class) of every bucket of the other classes."""

    frequent: dict[int, int]
    inner: np.ndarray

    @classmethod
    def gather(cls, counts: DataFrame) -> Vocabulary:
        """Reads a report of the ``TOP`` words and ``ENDINGS * BUCKETS`` sums; neither grows with the corpus."""
        top = counts.orderBy(F.desc("n"), "word").limit(TOP).select("word").collect()
        frequent = {r.word: i for i, r in enumerate(top)}
        rest = counts.where(~F.col("word").isin(list(frequent) or [0])) if frequent else counts
        place = (F.col("ending") * BUCKETS + F.pmod(F.shiftright("word", ENDING_BITS), F.lit(BUCKETS))).alias("at")
        sums = np.zeros(ENDINGS * BUCKETS)
        for r in rest.groupBy(place).agg(F.sum("n").alias("n")).collect():
            sums[r["at"]] = r["n"]
        sums = sums.reshape(ENDINGS, BUCKETS)
        inner = np.zeros((CLASSES, BUCKETS), np.float32)
        inner[TOP : TOP + ENDINGS] = np.log((sums + 1) / (sums.sum(1, keepdims=True) + BUCKETS))
        return cls(frequent, inner.ravel())

    def codes(self, word: np.ndarray) -> np.ndarray:
        """Class and bucket, as one number, of each word by its hash."""
        known = np.array(sorted(self.frequent), np.int64)
        out = ((word & (ENDINGS - 1)) + TOP) * BUCKETS + ((word >> ENDING_BITS) & (BUCKETS - 1))
        if len(known):
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            hit = np.flatnonzero(known[at] == word)
            out[hit] = np.array([self.frequent[h] for h in known.tolist()])[at[hit]] * BUCKETS
        return out.astype(np.int32)

    def code(self, word: bytes) -> int:
        return int(self.codes(np.array([word_hash(word)]))[0])

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all rows, number of codes in each row): the column of that name, or else those of the text."""
        if "codes" not in batch.schema.names:
            word, sizes = hashes(common.texts(batch))
            return self.codes(word), sizes
        held = batch.column(batch.schema.get_field_index("codes"))
        return np.asarray(held.flatten(), np.int32), np.diff(np.asarray(held.offsets).astype(np.int64))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows of ``docs`` with ``codes`` in place of the text, so that later passes need not read words again."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "codes")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "codes array<int>"])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        voc = shared.value

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            every, sizes = voc.read(batch)
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(every))
            names = [f.name for f in kept]
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), codes], names=[*names, "codes"])

        return kernel

    return common.map_arrow(docs.drop("codes"), make, schema)


def shapes() -> list[tuple[int, ...]]:
    return [(2 * SIDE, CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]


def start(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s) for s in shapes()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, a = [], 0
    for s in shapes():
        n = int(np.prod(s))
        out.append(flat[a : a + n].reshape(s))
        a += n
    return out


def windows(classes: np.ndarray, at: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """Classes around each position, or those in ``at`` (left to right, without itself); with ``sizes`` those of texts that are joined."""
    sizes = np.array([len(classes)]) if sizes is None else sizes
    place = np.arange(len(classes)) + SIDE * np.repeat(np.arange(1, len(sizes) + 1), sizes)  # marks stand before each text and after the last
    padded = np.full(len(classes) + SIDE * (len(sizes) + 1), OUTSIDE, np.int32)
    padded[place] = classes
    place = place if at is None else place[at]
    out = np.empty((len(place), 2 * SIDE), np.int32)
    for i, k in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        out[:, i] = padded[place + k]
    return out


#: Parameters of the input layer, then its bias; what follows is the output layer with its bias as one more row.
_FIRST_SIZE = 2 * SIDE * CLASSES * HIDDEN
_ROWS = CLASSES * np.arange(2 * SIDE)
_ONES = np.ones(CLASSES, np.float32)
#: Positions that go through the network together.
BATCH = 1024


def _split(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input layer by place and class, its bias, output layer and its bias below)."""
    end = _FIRST_SIZE + HIDDEN
    return flat[:_FIRST_SIZE].reshape(-1, HIDDEN), flat[_FIRST_SIZE:end], flat[end:].reshape(HIDDEN + 1, CLASSES)


def _layers(flat: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer and a column of ones, scores of all classes, in ``out``) where ``rows`` of the input layer are summed."""
    first, b1, last = _split(flat)
    x = first.take(rows[:, 0], 0)
    for k in range(1, 2 * SIDE):
        x += first.take(rows[:, k], 0)
    x += b1
    h = np.ones((len(rows), HIDDEN + 1), np.float32)
    np.tanh(x, out=h[:, :HIDDEN])
    z = np.matmul(h, last, out=out)
    if np.abs(last).sum(0).max() > 60:  # else no exponential overflows, as no hidden value is beyond 1
        z -= z.max(1, keepdims=True)
    return h, z


def forward(flat: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, log-probabilities of all classes) for each row of ``around``."""
    h, z = _layers(flat, around + _ROWS)
    return h[:, :HIDDEN], z - np.log(np.exp(z) @ _ONES)[:, None]


def log_probs(flat: np.ndarray, around: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Log-probability of the true class for each row of ``around``."""
    out, work = np.empty(len(truth)), np.empty((min(BATCH, len(truth)), CLASSES), np.float32)
    for a in range(0, len(truth), BATCH):
        own = truth[a : a + BATCH]
        z = _layers(flat, around[a : a + BATCH] + _ROWS, work[: len(own)])[1]
        true = z[np.arange(len(own)), own]
        out[a : a + BATCH] = true - np.log(np.exp(z, out=z) @ _ONES)
    return out


#: Gradients of one row that are added at once.
TOGETHER = 8


def _by_row(rows: np.ndarray, each: np.ndarray, out: np.ndarray) -> None:
    """Sums of the gradients in ``each`` (a row of zeros follows them) for each row of the input layer."""
    n = len(rows)
    key = rows.T.ravel()
    order = np.argsort(key.astype(np.uint16), kind="stable")
    count = np.bincount(key, minlength=len(out))
    # equal rows are neighbours now, in groups that the row of zeros fills up
    groups = (count + TOGETHER - 1) // TOGETHER
    end = np.cumsum(groups)
    at = np.full(end[-1] * TOGETHER, n)
    at[np.arange(len(key)) + np.repeat((end - groups) * TOGETHER - (np.cumsum(count) - count), count)] = order % n
    sums = each.take(at.reshape(-1, TOGETHER).T.ravel(), 0).reshape(TOGETHER, -1).sum(0).reshape(-1, HIDDEN)
    used = np.flatnonzero(count)
    out[:] = 0
    out[used] = np.add.reduceat(sums, (end - groups)[used])


class Trainer:
    """Adam over mini-batches of masked positions."""

    def __init__(self, flat: np.ndarray, rate: float = 0.005, batch: int = BATCH):
        self.flat, self.rate, self.batch, self.seen, self.k = flat.copy(), rate, batch, 0, 0
        self.m, self.v, self.grad, self.work = (np.zeros_like(flat) for _ in range(4))
        self.e, self.dh = np.empty((batch, CLASSES), np.float32), np.zeros((batch + 1, HIDDEN), np.float32)

    def learn(self, around: np.ndarray, truth: np.ndarray) -> None:
        order = np.random.default_rng(len(truth) + self.seen).permutation(len(truth))
        for a in range(0, len(order), self.batch):
            at = order[a : a + self.batch]
            self._step(around.take(at, 0), truth[at])
        self.seen += len(truth)

    def _step(self, around: np.ndarray, truth: np.ndarray) -> None:
        n, rows = len(truth), around + _ROWS
        last = _split(self.flat)[2]
        g_first, g_b1, g_last = _split(self.grad)
        h, e = _layers(self.flat, rows, self.e[:n])
        np.exp(e, out=e)
        total = e @ _ONES
        # of probabilities less the truth, times their sum: the narrow layer is divided by it
        e[np.arange(n), truth] -= total
        share = (1 / (total * n))[:, None]
        x, dh = h[:, :HIDDEN], self.dh[: n + 1]
        np.matmul(e, last[:HIDDEN].T, out=dh[:n])
        dh[:n] *= (1 - x * x) * share
        dh[n] = 0
        dh[:n].sum(0, out=g_b1)
        _by_row(rows, dh, g_first)
        h *= share
        g_last[:] = (e.T @ h).T
        self._move()

    def _move(self) -> None:
        grad, step = self.grad, self.work
        self.k += 1
        self.m *= 0.9
        self.m += np.multiply(grad, np.float32(0.1), out=step)
        self.v *= 0.999
        grad *= grad
        grad *= np.float32(0.001)
        self.v += grad
        np.divide(self.v, 1 - 0.999**self.k, out=step)
        np.sqrt(step, out=step)
        step += 1e-8
        np.divide(self.m, step, out=step)
        step *= self.rate / (1 - 0.9**self.k)
        self.flat -= step


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, stride: int = STRIDE) -> np.ndarray:
    """Parameters after ``rounds`` of training in all tasks and averaging in the cluster; ``docs`` may be encoded."""
    spark, flat = docs.sparkSession, start()
    voc = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(flat)

        def run(batches, now=now):
            trainer = Trainer(now.value)
            around, truth, held = [], [], 0
            for b in batches:
                for part in common.slices(b):
                    every, sizes = voc.value.read(part)
                    c = every // BUCKETS
                    before = np.repeat(np.cumsum(sizes) - sizes, sizes)
                    size = np.repeat(sizes, sizes)
                    pos = np.flatnonzero((np.arange(len(c)) - before - size * 7919 % stride % np.maximum(size, 1)) % stride == 0) if stride > 1 else None
                    around.append(windows(c, pos, sizes))
                    truth.append(c if pos is None else c[pos])
                    held += len(truth[-1])
                    if held > 50_000:
                        trainer.learn(np.concatenate(around), np.concatenate(truth))
                        around, truth, held = [], [], 0
            if held:
                trainer.learn(np.concatenate(around), np.concatenate(truth))
            if trainer.seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(trainer.flat.astype(np.float64) * trainer.seen), pa.array(np.full(len(flat), float(trainer.seen)))],
                    names=["i", "x", "n"],
                )
            del trainer, around, truth
            common.release()

        sums = docs.select("codes" if "codes" in docs.columns else "text").mapInArrow(run, "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
        flat = flat.copy()
        for r in sums.collect():  # as many rows as the network has parameters
            flat[r.i] = r.x
    return flat


def score_documents(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray) -> DataFrame:
    """Adds ``n_words``, ``log_prob`` (summed conditional log-probabilities) and ``mean_log_prob`` to every row; ``codes`` go.

    Null, empty and blank texts: 0 words, sum 0, mean null. Rows are independent, so repeated rows agree; columns of
    ``docs`` with these names are replaced; an empty table stays empty.
    """
    made = {"n_words": pa.int64(), "log_prob": pa.float64(), "mean_log_prob": pa.float64()}
    rows = docs.drop(*made)
    kept = [f.name for f in rows.schema.fields if f.name != "codes"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "codes"), "n_words long, log_prob double, mean_log_prob double"])
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))  # a fixed size whatever the corpus

    def make():
        voc, params = shared.value

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            # texts are scored together, each within its own borders
            every, n = voc.read(batch)
            truth = every // BUCKETS
            each = voc.inner[every] + log_probs(params, windows(truth, None, n), truth)
            sums = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)).astype(np.float64)  # without words: integers
            mean = pa.array([s / k if k else None for s, k in zip(sums.tolist(), n.tolist())], pa.float64())
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            return pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(sums), mean], names=[*kept, *made])

        return kernel

    return common.map_arrow(rows, make, schema)


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = common.Scratch(spark, "lm")
    counts = scratch.keep(word_counts(docs))
    vocabulary = Vocabulary.gather(counts)
    coded = scratch.only(encode(docs, vocabulary))
    return score_documents(coded, vocabulary, train(coded, vocabulary)).select("doc_id", "n_words", "log_prob", "mean_log_prob")
