"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every hashed n-gram (inside word borders) has the ratio ``r = log(share in toxic texts / share in others)``. A
text's features are the n-gram counts of its distinct words times ``r`` over their number; a logistic regression on
them is fitted in numpy. A second, tiny one weighs that sum over the whole text against its largest value in any run
of ``WINDOW`` words and against the text's ``WORST`` worst words, so that a long text with one toxic paragraph or a few
toxic words is found as well; it is fitted on sums that models of other texts give (``FOLDS`` parts). Sums are additive
over words: workers keep a cache of word sums and texts cost one look-up a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZES = (2, 3, 4, 5)
BITS = 18
#: Most labelled rows of either class that the fit reads, and most characters of them together (one text may be longer).
MAX_ROWS, MAX_CHARS = 2000, 3_000_000
CACHE = 200_000
#: Bytes of text whose words a scorer holds at once, and new words whose n-grams it does.
WORD_BYTES, NEW_WORDS = 1 << 20, 10_000
FOLDS = 4
WINDOW = 48
#: Distinct words whose mean counts beside the window, and the n-grams without a say added to each word's sum.
WORST, WORD_SMOOTH = 3, 6
#: N-grams without a say that are added to every sum, so that a handful of words decides little.
SMOOTH = 100
_P = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``words`` with their borders, and the word number of each."""
    joined = b"".join(b"\x02" + w + b"\x03" for w in words)
    chars = np.frombuffer(joined, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    buckets, owners = [], []
    h = chars + np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(2, SIZES[-1] + 1):
            m = len(chars) - n + 1
            if m <= 0:
                break
            h = h[:m] * _P + chars[n - 1 :] + np.uint64(n)
            if n in SIZES:
                inside = owner[:m] == owner[n - 1 :]
                x = h[inside]
                buckets.append(((x ^ (x >> np.uint64(29))) * _P >> np.uint64(64 - BITS)).astype(np.int32))
                owners.append(owner[:m][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _sums(to: np.ndarray, x: np.ndarray, weight: np.ndarray, of: np.ndarray, size: int, part: int = 1 << 19) -> np.ndarray:
    """``x * weight[of]`` summed by ``to``, a part at a time so that little memory is held."""
    out = np.zeros(size)
    for a in range(0, len(x), part):
        own = slice(a, a + part)
        out += np.bincount(to[own], x[own] * weight[of[own]], size)
    return out


@dataclass
class Model:
    """``weight`` holds r times the fitted coefficient of every bucket; ``top`` weighs (whole text, worst window, worst words, 1)."""

    weight: np.ndarray
    bias: float
    top: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], rounds: int = 60, ridge: float = 1e-6) -> Model:
        """Logistic regression by Adam on the ratio-scaled features; the same rows give the same model.

        With one class only the score says that class for every text; without rows nothing counts as toxic.
        """
        y = np.asarray(labels, np.float64)
        model = cls._linear(texts, y, rounds, ridge)
        if len(y) == 0 or y.min() == y.max():
            return model
        # a model knows the texts that it has learnt by heart too well: each part of either class is judged by the others
        fold = np.zeros(len(y), int)
        for c in (0, 1):
            fold[y == c] = np.arange((y == c).sum()) % FOLDS
        x = np.ones((len(y), 4))
        for k in range(FOLDS):
            mine, other = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if not len(mine):
                continue
            judge = cls._linear([texts[i] for i in other], y[other], rounds, ridge) if min((y[other] == c).sum() for c in (0, 1)) else model
            x[mine, :3] = Scorer(judge).parts([texts[i] for i in mine])
        scale = np.maximum(np.abs(x).mean(0), 1e-9)
        x /= scale
        top = np.zeros(4)
        for _ in range(50):  # Newton steps
            s = 1 / (1 + np.exp(-np.clip(x @ top, -30, 30)))
            top -= np.linalg.solve((x * (s * (1 - s) + 1e-6)[:, None]).T @ x / len(y) + 1e-4 * np.eye(4), x.T @ (s - y) / len(y) + 1e-4 * top)
        model.top = tuple((top / scale).tolist())
        return model

    @classmethod
    def _linear(cls, texts: list[str], y: np.ndarray, rounds: int, ridge: float, rate: float = 0.15) -> Model:
        if len(y) == 0 or y.min() == y.max():
            share = 0.98 if len(y) and y[0] else 0.02
            return cls(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
        row, col, val = [], [], []
        for i, t in enumerate(texts):
            b, _ = grams(sorted(set(t.lower().encode("utf-8", "surrogatepass").split())))
            u, c = np.unique(b, return_counts=True)
            row.append(np.full(len(u), i, np.int32))
            col.append(u)
            val.append((c / (c.sum() + SMOOTH)).astype(np.float32))
        row = np.concatenate(row)
        col = np.concatenate(col)
        val = np.concatenate(val)
        hot = (y == 1)[row]
        p = np.bincount(col[hot], minlength=1 << BITS) + 0.5
        q = np.bincount(col[~hot], minlength=1 << BITS) + 0.5
        r = np.log((p / y.sum()) / (q / (len(y) - y.sum())))
        x, b = val * (r * 100).astype(np.float32)[col], 0.0
        del val, hot
        weight_of = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        used = np.unique(col)
        place = np.zeros(1 << BITS, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        pos = place[col]
        del col
        w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
        mb = vb = 0.0
        for k in range(1, rounds + 1):
            z = _sums(row, x, w, pos, len(y)) + b
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight_of
            g, gb = _sums(pos, x, e, row, len(used)) + ridge * w, e.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            step = rate / (1 - 0.9**k)
            w -= step * m / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            b -= step * mb / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
        full = np.zeros(1 << BITS)
        full[used] = w * r[used] * 100
        return cls(full, float(b))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def parts(self, texts: list[str]) -> np.ndarray:
        """For each text the sum over its distinct words, the largest over a window and that of its worst words, all per n-gram."""
        words = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
        known = self.known
        new = set().union(*words).difference(known) if words else set()
        if new:
            if len(known) > CACHE:
                known.clear()
                new = set().union(*words)
            todo = list(new)
            for a in range(0, len(todo), NEW_WORDS):
                part = todo[a : a + NEW_WORDS]
                b, owner = grams(part)
                s = np.bincount(owner, self.model.weight[b], len(part))
                n = np.bincount(owner, minlength=len(part))
                known.update(zip(part, (s + 1j * n).tolist()))
        bias, out = self.model.bias, np.empty((len(words), 3))
        for i, w in enumerate(words):
            each = np.fromiter(map(known.__getitem__, w), np.complex128, len(w))
            own = set(w)
            apart = np.fromiter(map(known.__getitem__, own), np.complex128, len(own))
            whole, each_word = apart.sum(), apart.real / (apart.imag + WORD_SMOOTH)
            worst = np.partition(each_word, len(own) - WORST)[-WORST:] if len(own) > WORST else np.concatenate([each_word, np.zeros(WORST - len(own))])
            each.real[1:][each[1:] == each[:-1]] = 0  # one word over and over says nothing more
            run = np.concatenate([[0j], np.cumsum(each)])
            run = run[WINDOW:] - run[:-WINDOW] if len(w) >= WINDOW else run[-1:]
            out[i] = whole.real / (whole.imag + SMOOTH) + bias, (run.real / (run.imag + SMOOTH)).max() + bias, worst.mean()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        *weights, shift = self.model.top
        return 1 / (1 + np.exp(-np.clip(self.parts(texts) @ np.array(weights) + shift, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """Labelled texts of either class, those whose ids hash lowest; in a fixed order.

    At most ``max_rows`` of a class, and fewer where their whole texts have more than ``max_chars`` characters together; the first
    is always taken, however long. At most ``2 * max_rows`` ids of a class (some may have no text) are broadcast, so no
    text is shuffled. Reports of ``max_rows`` lengths, then the texts, reach the driver.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    marked = marked.withColumn("_o", F.xxhash64("doc_id"))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    wanted = []
    for side in (F.col("_y") == 1, F.col("_y") != 1):
        ids = marked.where(side).orderBy("_o", "doc_id").limit(2 * max_rows)
        rows = known.join(F.broadcast(ids), "doc_id").select("_o", "doc_id", "_h", F.length("text").alias("n"), "_y")
        total = 0
        for k, r in enumerate(rows.orderBy("_o", "doc_id", "_h").limit(max_rows).collect()):
            total += r.n
            if k and total > max_chars:
                break
            wanted.append((r.doc_id, r._h, r._o, r._y))
    if not wanted:
        return []
    kind, y = docs.schema["doc_id"].dataType.simpleString(), labels.schema[label].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(wanted, f"doc_id {kind}, _h long, _o long, _y {y}").distinct()
    rows = known.join(F.broadcast(chosen), ["doc_id", "_h"]).select("_o", "doc_id", "_h", "_y", "text").orderBy("_o", "doc_id", "_h").limit(len(wanted)).collect()
    return [(r.text, int(r._y)) for r in sorted(rows, key=lambda r: (r._y != 1, r._o, str(r.doc_id), r._h))]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fits the model on a bounded sample of labelled rows; ``labels`` (doc_id, toxic) picks which may be learnt from."""
    rows = sample(docs, labels, "toxic", max_rows, max_chars)
    model = Model.fit([t for t, _ in rows], [y for _, y in rows])
    del rows
    common.release()
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``toxicity`` (0 to 1) to every row: one narrow pass over the whole texts.

    Null and empty texts get the model's bias score. Repeated rows get equal scores; a column ``toxicity`` in ``docs``
    is replaced; an empty table stays empty. The text is the only input of a score.
    """
    kept = docs.drop("toxicity")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "toxicity double"])
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.top))  # 1 MB whatever the corpus

    def make():
        weight, bias, top = shared.value
        scorer = Scorer(Model(weight.astype(np.float64), bias, top))

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = np.concatenate([scorer.scores(common.texts(part)) for part in common.slices(batch, WORD_BYTES)])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "toxicity"])

        return kernel

    return common.map_arrow(kept, make, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(common.crc_mod("doc_id", 5) != 0))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (common.crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
