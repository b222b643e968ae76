"""Exact subword counts of every prefix of a text, by prefix dynamic programming.

A byte-pair encoding has the prefix property: the tokens of a prefix that ends at a token boundary are the
first tokens of the whole text. So each prefix has one last token, and it can be found from left to right:
the last token of ``s[:j]`` is the one ``t`` ending at ``j`` for which the pair (last token of ``s[:j-len(t)]``,
``t``) encodes to itself. ``count[j] = count[j - len(t)] + 1`` then holds the exact count at *every* prefix, and
truncation or budget questions are array look-ups instead of new encodings.

No piece of the vocabulary crosses the start of a run of word marks or a line break, so a text falls into
segments whose counts add up; segments repeat a lot and are cached per worker. A segment that is new is cut once more,
between characters that stand side by side in no piece (a word and its punctuation), and its parts are cached as well.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Entries kept by each of a worker's two caches before the older half is forgotten.
CACHE = 350_000
#: Longest segment (characters) that a cache holds, and the step in which longer ones are counted.
LONG = 512


class PrefixCounter:
    """Counts tokens of a sentencepiece BPE model with byte fallback, at every prefix.

    ``model_file`` is the path of the model. Counts equal the library's plain ``encode`` (no begin, end or other
    added tokens). The empty text has no tokens.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
        }
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("a piece crosses a word start: texts cannot be cut into segments")
        if sp.normalize("ﬁ \tａ") not in (f"{MARK}ﬁ{MARK}\tａ", "ﬁ \tａ"):
            raise ValueError("the model rewrites characters before it encodes")
        self.longest = max(map(len, self.score))
        self._side_by_side = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self._starts = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        self._new: dict[str, int] = {}
        self._old: dict[str, int] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._ends: dict[str, tuple[str, list[tuple[str, int]]]] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain byte-pair merging of a short string: best score first, leftmost on ties."""
        parts, score, none = list(text), self.score, float("-inf")
        gains = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score.get(parts[at - 1] + parts[at], none)
            if at < len(gains):
                gains[at] = score.get(parts[at] + parts[at + 1], none)
        return parts

    def _fit(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 3 * CACHE:
                self._fits.clear()
            known = self._fits[key] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def segment(self, s: str) -> list[int]:
        """``count[j]``: tokens of ``s[:j]``, for j from 0 to len(s)."""
        last, count = [""], [0]
        self._extend(s, len(s), 0, last, count)
        return count

    def total(self, s: str) -> int:
        """Tokens of a segment; of a long one only the places that a piece can reach back to are held."""
        base, last, count = 0, [""], [0]
        for upto in range(LONG, len(s) + LONG, LONG):
            self._extend(s, min(upto, len(s)), base, last, count)
            gone = max(0, len(last) - self.longest - 1)
            base += gone
            del last[:gone], count[:gone]
        return count[-1]

    def _end(self, s: str) -> tuple[str, list[tuple[str, int]]]:
        """The longest end of ``s`` that starts a piece, and the pieces at its end with their lengths, longest first."""
        if len(self._ends) > CACHE:
            self._ends.clear()
        tail = s
        while tail and tail not in self._starts:
            tail = tail[1:]
        found = self._ends[s] = tail, [(tail[i:], len(tail) - i) for i in range(len(tail)) if tail[i:] in self.score]
        return found

    def _extend(self, s: str, upto: int, base: int, last: list[str], count: list[int]) -> None:
        """Last token and count of the prefixes up to ``upto``; the lists start at place ``base``."""
        score, fits, ends = self.score, self._fits, self._ends
        at, tail = base + len(last) - 1, ""
        for c in s[max(0, at - self.longest) : at]:
            tail = (ends.get(tail + c) or self._end(tail + c))[0]
        for j in range(at + 1, upto + 1):
            c = s[j - 1]
            tail, pieces = ends.get(tail + c) or self._end(tail + c)
            for t, n in pieces:
                # at the start the whole prefix is one piece only if merging really builds it
                p = last[j - n - base]
                ok = fits.get((p, t))
                if ok is None:
                    ok = self._fit(p, t)
                if ok:
                    last.append(t)
                    count.append(count[j - n - base] + 1)
                    break
            else:  # a character outside the vocabulary: its UTF-8 bytes
                last.append(c)
                count.append(count[-1] + (1 if c in score else len(c.encode("utf-8", "surrogatepass"))))

    def _parts(self, text: str) -> list[str]:
        """Segments of a text, word marks included, without its line breaks."""
        if MARK in text or "  " in text or "\n " in text or text[:1] == " ":
            return [p for line in (MARK + text.replace(" ", MARK)).split("\n") for p in SEGMENT.findall(line)]
        head, *rest = text.split("\n")
        parts = [MARK + w for w in head.split(" ")]
        for line in rest:
            words = line.split(" ")
            if words[0]:
                parts.append(words[0])
            parts.extend([MARK + w for w in words[1:]])
        return parts

    def _runs(self, part: str) -> list[str]:
        """Parts of a segment between which no merge can happen: no piece holds the two characters there side by side."""
        inside = self._side_by_side
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in inside]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])] if cuts else [part]

    def _known(self, part: str) -> int:
        if len(part) > LONG:
            return self.total(part)
        n = self._new.get(part)
        if n is None:
            n = self._old.get(part)
            if n is None:
                runs = self._runs(part)
                n = sum(map(self._known, runs)) if len(runs) > 1 else self.segment(part)[-1]
            if len(self._new) >= CACHE:
                self._old, self._new = self._new, {}
            self._new[part] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        return sum(map(self._known, self._parts(text))) + text.count("\n")

    def prefixes(self, text: str | None) -> list[int]:
        """``out[j]``: tokens of the text's first j characters, for j from 0 to its length."""
        out, base, first = [0], 0, True
        for line in (MARK + (text or "").replace(" ", MARK)).split("\n"):
            if not first:
                base += 1
                out.append(base)
            for p in SEGMENT.findall(line):
                counts = self.segment(p)
                out.extend(base + c for c in counts[1:])
                base += counts[-1]
            first = False
        # the leading mark is not a character of the text; without any character there are no tokens
        return [0, *out[2:]]

    def fits(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens whose shorter prefixes all fit as well."""
        counts = self.prefixes(text)
        best = [0]
        for c in counts[1:]:
            best.append(max(best[-1], c))
        return bisect_right(best, budget) - 1


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    """One counter per worker process, with its caches."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, budget: int | None = None, prefixes: bool = False) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and, if asked for, ``fit_chars`` and ``prefix_tokens`` to every row of ``docs``.

    One narrow pass, no shuffle; a row's result depends on its text alone. ``fit_chars`` is where to cut the text to
    stay within ``budget`` tokens; ``prefix_tokens[j]`` is the exact count of the first j characters.
    Null and empty texts: 0 bytes, 0 tokens, 0 characters. Repeated rows stay. A column of ``docs`` with the name
    of a result column is replaced. An empty table gives an empty table.
    """
    made = {"n_bytes": pa.int64(), "n_tokens": pa.int64()}
    made |= {"fit_chars": pa.int64()} if budget is not None else {}
    made |= {"prefix_tokens": pa.list_(pa.int32())} if prefixes else {}
    kept = docs.drop(*made)
    names = {"n_bytes": "n_bytes long", "n_tokens": "n_tokens long", "fit_chars": "fit_chars long", "prefix_tokens": "prefix_tokens array<int>"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(names[k] for k in made)])

    def make():
        own = counter(model_file)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = common.texts(batch)
            out = {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in rows], "n_tokens": [own.count(t) for t in rows]}
            if budget is not None:
                out["fit_chars"] = [own.fits(t, budget) for t in rows]
            if prefixes:
                out["prefix_tokens"] = [own.prefixes(t) for t in rows]
            arrays = [*batch.columns, *(pa.array(out[k], t) for k, t in made.items())]
            return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *made])

        return kernel

    return common.map_arrow(kept, make, schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
