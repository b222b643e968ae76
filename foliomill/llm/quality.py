"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its features are shape counts of the line itself, of the line before and of the line after.
The field has a weight for each feature and for each pair of neighbouring labels and is fitted by its likelihood, where
the lines of a labelled document carry the document's label. Forward-backward gives every line's marginal of being
good; their mean, weighted by line length, is the document's quality, and a one-dimensional logistic fit turns it into
a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import sample

#: Most labelled rows of either class that the fit reads, and most characters of them together (one text may be longer).
MAX_ROWS, MAX_CHARS = 2000, 3_000_000
#: Lines whose features are held at once.
LINES = 20_000

_CLASSES = np.zeros((8, 256), bool)
for _c in range(256):
    _CLASSES[0, _c] = 65 <= _c <= 90
    _CLASSES[1, _c] = 97 <= _c <= 122
    _CLASSES[2, _c] = 48 <= _c <= 57
    _CLASSES[3, _c] = _c in b".,;:'\"()?-"
    _CLASSES[4, _c] = _c in b"!#$%&*+/<=>@[\\]^_`{|}~"
    _CLASSES[5, _c] = _c in b" \t"
    _CLASSES[6, _c] = 0x80 <= _c <= 0xBF or 0xC0 <= _c
    _CLASSES[7, _c] = _c in b".!?"
#: One bit for each class, so that one look-up a byte serves all of them.
N_OWN = 16


def _blocks(texts: list[str], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shape counts, length in bytes) of the lines that aren't blank, ``LINES`` at a time over all texts; fills in ``counts``."""
    lines: list[bytes] = []
    held: list[tuple[bool, int, int, int]] = []
    for i, t in enumerate(texts):
        data, at = t.encode("utf-8", "surrogatepass"), 0
        seen: set[bytes] = set()
        while at <= len(data):
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            x, at = data[at:end], end + 1
            w = x.split()
            if not w:
                continue
            counts[i] += 1
            lines.append(x)
            held.append((x in seen, len(w), len(set(w)), max(map(len, w))))
            seen.add(x)
            if len(lines) == LINES:
                yield _shapes(lines, held)
                lines, held = [], []
    if lines:
        yield _shapes(lines, held)


def _shapes(lines: list[bytes], held: list[tuple[bool, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lines], np.int64)
    data = np.frombuffer(b"".join(lines), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    share = np.stack([np.add.reduceat(c[data].astype(np.int32), at) for c in _CLASSES[:7]], 1) / size[:, None]
    seen_before, words_of, distinct, widest = np.array(held, np.float64).T
    x = np.empty((len(lines), N_OWN))
    x[:, :7] = share
    x[:, 7] = np.log1p(size) / 6
    x[:, 8] = np.log1p(words_of) / 5
    x[:, 9] = np.minimum(size / words_of, 40) / 10
    x[:, 10] = distinct / words_of
    x[:, 11] = _CLASSES[7][data[at + size - 1]]
    x[:, 12] = _CLASSES[0][data[at]]
    x[:, 13] = seen_before
    x[:, 14] = (share[:, 4] > 0.04) | (share[:, 0] > 0.3)
    x[:, 15] = np.minimum(widest, 80) / 40
    return x, size.astype(np.float64)


def _borders(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is its text's first, and its last."""
    first, end = np.zeros((2, counts.sum()), bool)
    ends, has = np.cumsum(counts), counts > 0
    first[(ends - counts)[has]] = True
    end[ends[has] - 1] = True
    return first, end


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', line lengths in bytes, lines of each text)."""
    counts = np.zeros(len(texts), np.int64)
    parts = list(_blocks(texts, counts))
    if not parts:
        return np.zeros((0, 3 * N_OWN + 3)), np.zeros(0), counts
    x, size = (np.concatenate(p) for p in zip(*parts))
    first, end = _borders(counts)
    before = np.where(first[:, None], 0, np.roll(x, 1, 0))
    after = np.where(end[:, None], 0, np.roll(x, -1, 0))
    return np.hstack([x, before, after, np.ones((len(x), 1)), first[:, None], end[:, None]]), size, counts


def unary(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``features @ weights``, line lengths, lines of each text), a block of lines at a time: a few numbers a line are held."""
    counts, of = np.zeros(len(texts), np.int64), weights[: 3 * N_OWN].reshape(3, N_OWN).T
    parts = [(x @ of, size) for x, size in _blocks(texts, counts)]
    if not parts:
        return np.zeros(0), np.zeros(0), counts
    u, size = (np.concatenate(p) for p in zip(*parts))
    first, end = _borders(counts)
    out = u[:, 0] + weights[-3] + weights[-2] * first + weights[-1] * end
    out[1:] += np.where(first[1:], 0, u[:-1, 1])
    out[:-1] += np.where(end[:-1], 0, u[1:, 2])
    return out, size, counts


def _grid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines; for each, the row of its first line; how many have a line at each place."""
    order = np.argsort(-counts, kind="stable")
    starts = np.cumsum(counts) - counts
    longest = int(counts.max(initial=0))
    live = len(counts) - np.searchsorted(np.sort(counts), np.arange(longest), "right")
    return order, starts[order], live


def marginals(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for all texts at once: P(good) of each line, summed pair marginals, log partition of each text.

    ``unary``: score of good against bad for each line; ``trans``: 2 x 2 scores of neighbouring labels; ``weight``: of each
    text in the sum of pair marginals.
    """
    order, first, live = _grid(counts)
    weight = np.ones(len(counts)) if weight is None else weight
    n, longest = len(unary), len(live)
    psi = np.stack([np.zeros(n), unary], 1)
    alpha, beta, logz = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros(len(counts))
    pairs = np.zeros((2, 2))
    for t in range(longest):
        at = first[: live[t]] + t
        if t == 0:
            alpha[at] = psi[at]
        else:
            m = alpha[at - 1][:, :, None] + trans[None]
            alpha[at] = np.logaddexp(m[:, 0], m[:, 1]) + psi[at]
    ends = np.cumsum(counts) - 1
    has = counts > 0
    logz[has] = np.logaddexp(alpha[ends[has], 0], alpha[ends[has], 1])
    z_of = np.repeat(logz, counts)
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        m = trans[None] + (psi[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
        pairs += np.tensordot(weight[order[: len(at)]], np.exp(alpha[at][:, :, None] + m - z_of[at][:, None, None]), 1)
    return np.exp(alpha[:, 1] + beta[:, 1] - z_of), pairs, logz


def objective(theta: np.ndarray, x: np.ndarray, y: np.ndarray, counts: np.ndarray, weight: np.ndarray, ridge: float, tie: float) -> tuple[float, np.ndarray]:
    """(value, gradient) of the weighted negative log-likelihood of chains whose lines all carry their text's label, with priors.

    ``theta``: feature weights, then the four transitions. The priors are Gaussian. Chains of one label alone would pull the
    transitions without bound; ``tie`` is what keeps them finite.
    """
    w, trans = theta[:-4], theta[-4:].reshape(2, 2)
    score, pairs_of = x @ w, np.maximum(counts - 1, 0)
    p, pairs, logz = marginals(score, trans, counts, weight)
    good, k = np.repeat(y, counts), y.astype(int)
    own = np.bincount(np.repeat(np.arange(len(y)), counts), score * good, len(y)) + trans[k, k] * pairs_of
    value = (weight * (logz - own)).sum() + ridge / 2 * (w * w).sum() + tie / 2 * (trans * trans).sum()
    seen = np.diag([(weight * pairs_of * (k == c)).sum() for c in (0, 1)])
    return value, np.concatenate([x.T @ (np.repeat(weight, counts) * (p - good)) + ridge * w, (pairs - seen + tie * trans).ravel()])


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], rounds: int = 150, ridge: float = 1e-3, tie: float = 0.03) -> Model:
        """Adam on the log-likelihood of the label chains; deterministic. One class only: its share for all texts."""
        y = np.asarray(labels, np.float64)
        x, size, counts = features(texts)
        theta = np.zeros(3 * N_OWN + 3 + 4)
        if len(y) == 0 or y.min() == y.max() or not len(x):
            return cls(theta[:-4], np.zeros((2, 2)), 0.0, 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        m = v = np.zeros(len(theta))
        for k in range(1, rounds + 1):
            # each text counts alike, whatever its number of lines
            g = objective(theta, x, y, counts, weight / np.maximum(counts, 1), ridge, tie)[1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        model = cls(w, trans, 1.0, 0.0)
        q = model.logits(texts)
        a = np.column_stack([q, np.ones(len(q))])
        top = np.array([1.0, 0.0])
        for _ in range(60):
            s = 1 / (1 + np.exp(-np.clip(a @ top, -30, 30)))
            top -= np.linalg.solve((a * (weight * (s * (1 - s) + 1e-6))[:, None]).T @ a + 1e-4 * np.eye(2), a.T @ (weight * (s - y)) + 1e-4 * top)
        model.slope, model.shift = float(top[0]), float(top[1])
        return model

    def line_quality(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line that isn't blank, its length, and the lines of each text."""
        score, size, counts = unary(texts, self.weights)
        return marginals(score, self.trans, counts)[0], size, counts

    def logits(self, texts: list[str]) -> np.ndarray:
        p, size, counts = self.line_quality(texts)
        of = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(of, size, len(texts))
        q = np.where(total > 0, np.bincount(of, size * p, len(texts)) / np.maximum(total, 1), 0.0)
        q = np.clip(q, 1e-3, 1 - 1e-3)
        return np.log(q / (1 - q))

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fits the model on a bounded sample of labelled rows; ``labels`` (doc_id, quality) picks which may be learnt from."""
    rows = sample(docs, labels, "quality", max_rows, max_chars)
    model = Model.fit([t for t, _ in rows], [y for _, y in rows])
    del rows
    common.release()
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``quality`` (0 to 1, higher is better) to every row: one narrow pass over the whole texts.

    A null, empty or blank text has no lines and counts as wholly bad. Repeated rows get equal scores; a column
    ``quality`` in ``docs`` is replaced; an empty table stays empty. The text is the only input of a score.
    """
    kept = docs.drop("quality")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "quality double"])

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = model.scores(common.texts(batch))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "quality"])

        return kernel

    return common.map_arrow(kept, make, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(common.crc_mod("doc_id", 4) != 2))
    return score_quality(docs, model).select(
        "doc_id",
        (common.crc_mod("doc_id", 4) == 2).alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= 0.7).cast("int").alias("predicted"),
    )
