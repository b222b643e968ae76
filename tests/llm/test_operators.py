"""The ten operators against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from foliomill.llm import bwt, components, decontamination, licenses, lm_scores, mixing, ngram_join, quality, queries, suffix_dedup, token_counts, topk, toxicity
from foliomill.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, source="s", start=0):
    return spark.createDataFrame([(start + i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def all_docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in all_docs(spark).collect()}


ODD = [None, "", " ", "\n\n", "a", "a" * 50_000, "слово " * 3000, "x\x00y", "é🙂\t"]


# 1 token counts


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_counts_are_the_librarys(spark, texts, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op1_token_counts"](spark, DATA).collect()}
    want = {k: len(sp.encode(t)) for k, t in texts.items()}
    assert got == {k: (len(t.encode()), want[k], want[k] > 4096) for k, t in texts.items()}


def test_long_segments_are_not_held(model):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.PrefixCounter(model)
    rng = random.Random(2)
    for n in (511, 512, 513, 1500, 20_000):
        for t in ("a" * n, "".join(rng.choice("abcdeté日") for _ in range(n)), "=" * n):
            assert own.count(t) == len(sp.encode(t)) == own.prefixes(t)[-1]
    assert max(map(len, own._new)) <= token_counts.LONG


def test_every_prefix(model):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.PrefixCounter(model)
    rng = random.Random(1)
    cases = ["", " ", "  a  b ", "a\n b\n\nc", "▁x ▁", "日本 🙂", "　ｆ\x00"]
    cases += ["".join(rng.choice("ab é\n▁the ingto.") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for t in cases:
        assert own.prefixes(t) == [len(sp.encode(t[:j])) for j in range(len(t) + 1)], t
        assert own.count(t) == len(sp.encode(t))
        k = own.fits(t, 5)
        assert all(len(sp.encode(t[:j])) <= 5 for j in range(k + 1)) and (k == len(t) or len(sp.encode(t[: k + 1])) > 5)


def test_words_with_punctuation_are_counted_once(model, monkeypatch):
    import sentencepiece

    sp, own, done = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.PrefixCounter(model), []
    segment = token_counts.PrefixCounter.segment
    monkeypatch.setattr(token_counts.PrefixCounter, "segment", lambda self, s: done.append(s) or segment(self, s))
    word = "anonwhetion"
    forms = [word, word + ",", word + ".", word + "&&&", word + "&&&,", word + "日", word + "\t" + word]
    for t in forms * 2:
        assert own.count(t) == len(sp.encode(t)), t
    assert len(done) == len(set(done)) and sum(word in s for s in done) == 2  # with a word mark and without
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["the", "tion", "é", "ß", "Q", ",", ".", "&&&", "0", "12", " ", "\n", "日", "🙂", "▁", "ﬁ", "\t"]) for _ in range(rng.randint(1, 40)))
        assert own.count(t) == len(sp.encode(t)) == own.prefixes(t)[-1], t


def test_count_edges(spark, model):
    rows = docs(spark, *ODD).withColumn("n_tokens", F.lit("clash"))
    got = token_counts.token_counts(rows, model, budget=10, prefixes=True).orderBy("doc_id").collect()
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in ODD]
    assert (got[0].n_tokens, got[1].n_tokens, got[0].prefix_tokens, got[0].fit_chars) == (0, 0, [0], 0)
    assert all(r.prefix_tokens[-1] == r.n_tokens for r in got)
    assert token_counts.token_counts(docs(spark, "a").limit(0), model).count() == 0


# 2 toxicity and 6 quality


def test_toxicity_holds_the_words_of_little_text(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randint(0, 300_000))) for _ in range(30)] + ["", "x" * 2_000_000]
    model = toxicity.Model(np.random.default_rng(3).normal(size=1 << toxicity.BITS), 0.1, (0.5, 0.2, 0.1, 0.0))
    want = toxicity.Scorer(toxicity.Model(model.weight.astype(np.float32).astype(float), model.bias, model.top)).scores(texts)
    monkeypatch.setattr(common, "map_arrow", lambda df, make, schema: make())
    kernel, seen, scores = toxicity.score_toxicity(docs(spark, "a"), model), [], toxicity.Scorer.scores
    monkeypatch.setattr(toxicity.Scorer, "scores", lambda self, t: seen.append([len(x.encode()) for x in t]) or scores(self, t))
    got = kernel(pa.record_batch({"text": texts})).column("toxicity").to_pylist()
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert sum(map(len, seen)) == len(texts) and all(len(s) == 1 or sum(s[1:]) <= 1 << 20 for s in seen)


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60))
    bad = lambda: plain() + " " + rng.choice(["idiotic scum", "worthless moron"]) + " " + plain()
    m = toxicity.Model.fit([plain() for _ in range(150)] + [bad() for _ in range(150)], [0] * 150 + [1] * 150)
    assert (toxicity.Scorer(m).scores([bad() for _ in range(50)]) >= 0.5).mean() > 0.95
    assert (toxicity.Scorer(m).scores([plain() for _ in range(50)]) < 0.5).mean() > 0.95
    # a toxic paragraph within a long text
    long = " ".join(plain() for _ in range(20))
    assert toxicity.Scorer(m).scores([long + " idiotic scum worthless moron idiotic moron " + long])[0] > toxicity.Scorer(m).scores([long])[0]


@pytest.mark.parametrize("name, m, rest", [("op2_toxicity", 5, 0), ("op6_quality", 4, 2)])
def test_scores(spark, texts, name, m, rest):
    got = queries.QUERIES[name](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == rest) for r in got)
    assert all(r.predicted == int(r.score >= (0.5 if m == 5 else 0.7)) for r in got)


@pytest.mark.parametrize("name, label, bad, good", [("op2_toxicity", "toxic", 0.97, 0.8), ("op6_quality", "quality", 0.95, 0.97)])
def test_held_out_accuracy(spark, name, label, bad, good):
    folder = DATA.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").where(F.col(label).isNotNull()).collect()}
    got = [(truth[r.doc_id], r.predicted) for r in queries.QUERIES[name](spark, folder).collect() if r.held_out and r.doc_id in truth]
    for y, least in ((0, bad), (1, good)):
        own = [p for t, p in got if t == y]
        assert len(own) > 90 and sum(p == y for p in own) >= least * len(own)


def test_fit_on_long_texts_and_few_characters(spark):
    rng = random.Random(4)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(1200))
    rows = docs(spark, *[plain() + (" idiotic scum" * 60 if i % 2 else "") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert len(toxicity.sample(rows, labels, "toxic", 2000, 3_000_000)) == 40
    assert len(toxicity.sample(rows, labels, "toxic", 7, 3_000_000)) == 14
    few = toxicity.sample(rows, labels, "toxic", 2000, 10)  # one of each, longer than that
    assert sorted(y for _, y in few) == [0, 1] and all(len(t) > 4000 for t, _ in few)
    assert few == toxicity.sample(rows.repartition(5), labels, "toxic", 2000, 10)
    twice = toxicity.sample(rows.union(rows), labels, "toxic", 2000, 3_000_000)
    assert len(twice) >= 40
    m = toxicity.fit(rows, labels)
    assert (toxicity.Scorer(m).scores([plain() + " idiotic scum" * 60, plain()]) >= 0.5).tolist() == [True, False]
    assert toxicity.sample(rows.limit(0), labels, "toxic", 5, 100) == [] == toxicity.sample(rows, labels.limit(0), "toxic", 5, 100)


def test_quality_objective_by_finite_differences():
    rng = np.random.default_rng(5)
    texts = ["One line.\nTwo lines!\n\n## ??", "A", "", "b b b\nb b b\nc", "!!\n%%"]
    x, _, counts = quality.features(texts)
    y, weight, theta = np.array([1.0, 0, 1, 0, 0]), rng.random(5), rng.normal(0, 0.5, x.shape[1] + 4)
    at = lambda t: quality.objective(t, x, y, counts, weight, 0.01, 0.03)
    step = 1e-6 * np.eye(len(theta))
    want = [(at(theta + s)[0] - at(theta - s)[0]) / 2e-6 for s in step]
    assert np.allclose(at(theta)[1], want, atol=1e-6)


def test_quality_in_blocks_of_lines(monkeypatch):
    rng = random.Random(6)
    texts = ["\n".join("".join(rng.choice("ab c.!") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    weights = np.random.default_rng(7).normal(size=3 * quality.N_OWN + 3)
    x, size, counts = quality.features(texts)
    for lines in (1, 7, 20_000):
        monkeypatch.setattr(quality, "LINES", lines)
        score, size_of, counts_of = quality.unary(texts, weights)
        assert np.allclose(score, x @ weights) and (size_of == size).all() and (counts_of == counts).all()


def test_score_edges(spark):
    for fit, score, column in (
        (toxicity.Model.fit(["good text here", "bad idiot here"], [0, 1]), toxicity.score_toxicity, "toxicity"),
        (quality.Model.fit(["A good line.\nAnother one.", "!! ## !!\n$$ @@"], [1, 0]), quality.score_quality, "quality"),
    ):
        rows = docs(spark, *ODD, "same text", "same text").withColumn(column, F.lit("clash"))
        got = score(rows, fit).orderBy("doc_id").collect()
        assert len(got) == len(ODD) + 2 and all(0 <= r[column] <= 1 for r in got)
        assert got[0][column] == got[1][column] and got[-1][column] == got[-2][column]
        assert score(docs(spark, "a").limit(0), fit).count() == 0
    assert (toxicity.Scorer(toxicity.Model.fit([], [])).scores(["a", ""]) < 0.5).all() and quality.Model.fit([], []).slope == 0


def test_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 4])
    unary, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs, logz = quality.marginals(unary, trans, counts)
    want, total, at = [], np.zeros((2, 2)), 0
    for k in counts:
        u = unary[at : at + k]
        weigh = {y: np.exp(sum(u[i] * y[i] for i in range(k)) + sum(trans[y[i], y[i + 1]] for i in range(k - 1))) for y in itertools.product((0, 1), repeat=k)}
        z = sum(weigh.values())
        want += [sum(w for y, w in weigh.items() if y[i]) / z for i in range(k)]
        for y, w in weigh.items():
            for i in range(k - 1):
                total[y[i], y[i + 1]] += w / z
        at += k
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_quality_separates(spark):
    good = ["This is a plain sentence about things.\nIt goes on for a while, calmly." + f"\nLine {i} ends here." for i in range(60)]
    bad = [f"BUY!! NOW!! {i}!!\n## $$ || @@\nBUY!! BUY!!" for i in range(60)]
    m = quality.Model.fit(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    assert (m.scores(good[40:]) >= 0.7).all() and (m.scores(bad[40:]) < 0.7).all()


# 3 n-gram join


def brute_links(rows, n, num, den):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {k: k for k in sets}

    def head(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((head(a), head(b)))
                label[y] = x
    return {k: (k, len(s), head(k) if s else k) for k, s in sets.items()}


def near_copies(seed=5, families=6, copies=12, words=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    out = []
    shared = [word() for _ in range(40)]
    for _ in range(families):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.5:
                    w[at] = word()
                elif kind < 0.75:
                    del w[at : at + rng.randint(1, 6)]
                else:
                    w[at:at] = [word() for _ in range(rng.randint(1, 4))]
            out.append(" ".join(w))
        out.append(" ".join([word() for _ in range(5)] + shared + [word() for _ in range(5)]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_join_against_all_pairs(spark, n, num, den):
    rows = [*near_copies(), None, "", "  ", "one two", "ONE\ttwo", "one", "É two"]
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(docs(spark, *rows), n, num, den).collect()}
    assert got == brute_links(list(enumerate(rows)), n, num, den)


def test_join_over_the_table(spark, texts):
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op3_ngram_join"](spark, DATA).collect()}
    assert got == brute_links(sorted(texts.items()), 3, 9, 10)


def test_join_edges(spark):
    assert ngram_join.linked(docs(spark, "a").limit(0)).count() == 0
    twice = docs(spark, "a b c d e f g", None).union(docs(spark, "a b c d e f g", None)).withColumn("node", F.lit(1)).withColumn("fp", F.lit("x"))
    assert sorted(map(tuple, ngram_join.linked(twice).collect())) == [(0, 3, 0), (0, 3, 0), (1, 0, 1), (1, 0, 1)]
    kept = ngram_join.one_of_each(docs(spark, "a b c d e f", "A B C D E F", "x", None, ""))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert ngram_join.one_of_each(twice).count() == 2
    a, b = "one two three four five six seven eight nine ten eleven twelve", "quite another text that stands for itself and nothing else"
    kept = ngram_join.one_of_each(spark.createDataFrame([(1, a), (2, a), (2, b), (None, a), (2, b)], "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, a), (2, b)]
    kept = ngram_join.one_of_each(spark.createDataFrame([(1, a), (1, a + " thirteen"), (None, a)], "doc_id long, text string"))
    assert len(kept.collect()) == 1
    assert ngram_join.one_of_each(spark.createDataFrame([(None, a), (None, a.upper()), (None, b)], "doc_id string, text string")).count() == 2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)], "a long, b long")
    got = dict(components.components(edges, common.Scratch(spark, "t")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 130)}


# 4 decontamination


@pytest.mark.parametrize("block", [64, 3])
def test_wand_finds_what_scoring_all_finds(monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    chunks = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(3, 30))]) for i in range(40)]
    index = decontamination.Index.build(chunks, {})
    for _ in range(60):
        terms = sorted({index.term[w] for w in rng.sample(vocabulary, rng.randint(1, 25)) if w in index.term})
        scores = collections.defaultdict(float)
        for t in terms:
            for c, x in zip(*(v.tolist() for v in index.postings(t))):
                scores[c] += x
        for threshold in (0.2, 0.5, 0.8):
            want = {c for c, s in scores.items() if s >= threshold - 1e-9}
            assert {c for c, _ in index.search(terms, threshold)} == want
            if threshold > 0.3:
                assert index.candidates(np.full(len(terms), 7), np.array(terms, np.int64), threshold).tolist() in ([[7]] if want else [[], [7]])


def test_leaks_over_the_table(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = queries.QUERIES["op4_decontamination"](spark, DATA).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_leak_edges(spark):
    item = "Which river crosses the old town of Nowhere before it meets the sea? The answer is the long Grey River."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    filler = " ".join(f"word{i}" for i in range(300))
    rows = docs(spark, *ODD, item, f"{filler} {item.upper()} {filler}", filler, item.split("?")[0] + "?").withColumn("leaks", F.lit("clash"))
    got = decontamination.find_leaks(rows, bench).orderBy("doc_id").collect()
    assert [[x.item_id for x in r.leaks] for r in got] == [[]] * len(ODD) + [[1], [1], [], []]
    assert decontamination.find_leaks(rows, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert decontamination.find_leaks(rows.limit(0), bench).count() == 0


def test_shards_cover_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD", 3)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(30))) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(docs(spark, *[t for _, t in items]), bench).collect()
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in got} == {i: [i] for i in range(10)}


def test_shards_share_statistics(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(["the", "of", "and", f"q{i}x{k}"]) for k in range(40))) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = docs(spark, *[" ".join("new" if k % 9 == 4 else w for k, w in enumerate(t.split())) for _, t in items])
    found = {}
    for shard in (512, 3):
        monkeypatch.setattr(decontamination, "SHARD", shard)
        monkeypatch.setattr(decontamination, "LIVE", 2)  # of four shards: two passes
        got = decontamination.find_leaks(edited, bench, 0.3, 0.0).collect()
        found[shard] = {(r.doc_id, x.item_id, x.word): x.score for r in got for x in r.leaks}
    assert found[3].keys() == found[512].keys() and any(x < 0.99 for x in found[512].values())
    assert found[3] == pytest.approx(found[512])


def brute_leaks(texts, items, threshold, overlap):
    """BM25 of every passage against every chunk, straight from the formula."""
    import math

    D = decontamination
    cut = {i: D.cut(t) for i, t in items}
    chunks = [(i, c) for i, (_, _, own) in cut.items() for c in own]
    mean, df = sum(len(c) for _, c in chunks) / len(chunks), collections.Counter(w for _, c in chunks for w in set(c))
    idf = {w: math.log(1 + (len(chunks) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    impact = lambda w, c: idf[w] * c.count(w) * (D.K1 + 1) / (c.count(w) + D.K1 * (1 - D.B + D.B * len(c) / mean))
    out = {}
    for d, t in enumerate(texts):
        w, half = D.words(t), D.PASSAGE // 2
        for a in range(0, max(1, len(w) - half), half):
            passage = set(w[a : a + D.PASSAGE])
            for i, c in chunks:
                score = sum(impact(x, c) for x in set(c) & passage) / sum(impact(x, c) for x in set(c))
                q, r, _ = cut[i]
                region = w[max(0, a - len(q) - len(r)) : a + D.PASSAGE + len(q) + len(r)]
                if score >= threshold - 1e-9 and D.contained(q, region, 5) >= overlap and D.contained(r, region, 3) >= overlap:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_leaks_by_brute_force_and_altered_copies(spark):
    rng = random.Random(17)
    pool = ["the", "of", "and", "river", "town"] + [f"v{k}" for k in range(250)]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, prose(rng.randint(20, 60)) + "? It is " + prose(6) + ".") for i in range(40)]
    texts, planted = [], set()
    for d in range(120):
        t = prose(rng.randint(0, 260))
        if d % 2:
            i, x = rng.choice(items)
            w = x.split()
            for _ in range(len(w) // 25):  # a word in 25 is altered
                w[rng.randrange(len(w) * 3 // 4)] = rng.choice(pool)
            t += " " + " ".join(w) + " " + prose(40)
            planted.add((d, i))
        texts.append(t)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for threshold, overlap in ((0.6, 0.7), (0.35, 0.0)):
        got = decontamination.find_leaks(docs(spark, *texts), bench, threshold, overlap).collect()
        got = {(r.doc_id, x.item_id): x.score for r in got for x in r.leaks}
        assert got == pytest.approx(brute_leaks(texts, items, threshold, overlap))
        assert len(planted & set(got)) >= 0.9 * len(planted)


def test_one_pass_for_many_items(spark):
    items = spark.range(100_000).selectExpr("id AS item_id", "concat('which number follows ', id, ' in the list of ', id % 977, ' numbers? It is ', id + 1, ' of course.') AS text")
    found = decontamination.find_leaks(docs(spark, "which number follows 77123 in the list of 917 numbers? It is 77124 of course.", "nothing"), items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert 77123 in [x.item_id for x in found.orderBy("doc_id").first().leaks]


# 5 suffix-array dedup


def brute_repeats(rows, least, keep_first):
    count, seen = collections.Counter(), set()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        count.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = {}
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            if (w in seen) if keep_first else count[w] > 1:
                gone[i : i + least] = True
            seen.add(w)
        out[k] = (int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def passages(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéf") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    pool = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = [" ".join(rng.choice([text(10), rng.choice(pool)]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [*rows, rows[0], rows[0], "x" * 700, "ab" * 200, None, "", "short"]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("group", [512, 1])
def test_repeats_against_all_windows(spark, monkeypatch, keep_first, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 1: every seed with several contexts counts as hot
    rows = passages()
    want = brute_repeats(list(enumerate(rows)), 64, keep_first)
    got = suffix_dedup.find_repeats(docs(spark, *rows), 64, keep_first).collect()
    own = {r.doc_id: (sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in got}
    assert own == want


def brute_shared(rows, least):
    owners = collections.defaultdict(set)
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - least + 1):
            owners[b[i : i + least]].add((k, b))
    return {k for o in owners.values() if len(o) > 1 for k, _ in o}


@pytest.mark.parametrize("passage", [40, 64, 100])
@pytest.mark.parametrize("group", [512, 1])
def test_shared_passages_against_all_windows(spark, monkeypatch, passage, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(5)
    rows = passages(9)
    own = rng.choice("ab") + "".join(rng.choice("ghijkl") for _ in range(120))
    rows += [own + " " + own, "".join(rng.choice("mnopq") for _ in range(500))]  # repeats within one text only; none at all
    got = suffix_dedup.find_repeats(docs(spark, *rows), 64, passage=passage).collect()
    assert {r.doc_id for r in got if r.passage} == brute_shared(list(enumerate(rows)), passage)
    want = brute_repeats(list(enumerate(rows)), 64, False)
    assert {r.doc_id: (sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in got} == want


def test_contexts_in_stretches(monkeypatch):
    rng, texts = random.Random(3), [t.encode() for t in passages(4) if t]
    ends = np.cumsum([len(t) for t in texts])
    data, seen = np.frombuffer(b"".join(texts), np.uint8), {}
    for stretch in (1 << 20, 97):
        monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
        windows, of = collections.Counter(), collections.defaultdict(set)
        for least, x in suffix_dedup.contexts(data, ends, [40, 64]):
            for k, ah, dg, s0, s1, seed in zip(*(x[c].tolist() for c in ("text", "ah", "dg", "s0", "s1", "seed"))):
                assert s0 <= s1 <= seed <= s0 + least - suffix_dedup.SEED
                windows.update((least, k, s) for s in range(s0, s1 + 1))
                of[least, ah, dg].add(texts[k][s0 : s1 + least])
                seen.setdefault((least, texts[k][seed : seed + suffix_dedup.SEED]), set()).add(ah)
        assert windows == collections.Counter((n, k, s) for n in (40, 64) for k, t in enumerate(texts) for s in range(len(t) - n + 1))
        assert all(len(v) == 1 for v in of.values()) and all(len(v) == 1 for v in seen.values())


def test_only_contexts_that_can_meet_are_transformed():
    rng = random.Random(5)
    letters = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    seed, least, group = b"x" * suffix_dedup.SEED, 120, []
    for i in range(60):
        left, right = letters(88), letters(88)
        if group and i % 3 == 0:  # shares as much as a window holds, a byte less or more, with an earlier one
            old, far, n = rng.choice(group), rng.randrange(0, 89), least + i % 2 - (i % 4 == 0)
            whole = bytearray(left + seed + right)
            whole[88 - far : 88 - far + n] = old["bytes"][88 - far : 88 - far + n]
            left, right = bytes(whole[:88]), bytes(whole[88 + len(seed) :])
        cut = rng.randrange(0, 40)
        group.append({"ah": 1, "dg": i, "doc_id": i, "th": 0, "s0": 500, "seed": 588, "bytes": (left + seed + right)[: 208 - cut]})
    group.append(dict(group[0], doc_id=99))
    met = suffix_dedup._meeting(group, least)
    gone = {r["dg"]: g for r, g in zip(group[:60], bwt.repeated([r["bytes"] for r in group[:60]], least, False)[0])}
    assert any(g.any() for g in gone.values()) and len(met) < 50
    for r, g in zip(met, bwt.repeated([r["bytes"] for r in met], least, False)[0]):
        assert (gone.pop(r["dg"]) == g).all()
    assert not any(g.any() for g in gone.values())


def test_hashes_in_parts(monkeypatch):
    data = np.random.default_rng(6).integers(0, 256, 1000).astype(np.uint8)
    for n in (31, 32, 33, 131, 132, 133, 231, 232, 1000):
        whole = suffix_dedup._hashes(data[:n], 32)
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "HASHED", 100)
            assert (suffix_dedup._hashes(data[:n], 32) == whole).all() and len(whole) == max(0, n - 31)


def test_repeats_over_the_table(spark, texts):
    got = queries.QUERIES["op5_suffix_dedup"](spark, DATA).collect()
    assert {r.doc_id for r in got if r.shares_passage} == brute_shared(sorted(texts.items()), suffix_dedup.PASSAGE)
    want = brute_repeats(sorted(texts.items()), 400, False)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        k: (len(texts[k].encode()), n, s, hashlib.sha256(kept).hexdigest()) for k, (n, s, kept) in want.items()
    }


def test_repeat_edges(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("йцукен") for _ in range(100)) + "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = docs(spark, "q" + long, "w" + long, None, "").withColumn("th", F.lit("own")).withColumn("spans", F.lit("clash")).withColumn("marks", F.lit(5))
    got = suffix_dedup.find_repeats(rows, 64, keep_first=True, whole_chars=True).orderBy("doc_id").collect()
    assert [r.th for r in got] == ["own"] * 4 and [r.marks for r in got] == [5] * 4
    for r in got:
        bytes(r.kept).decode()
    assert bytes(got[0].kept).decode() == "q" + long and bytes(got[1].kept).decode() == "w"
    assert suffix_dedup.find_repeats(rows.limit(0), 64, passage=80).count() == 0
    same = docs(spark, long).union(docs(spark, long))
    assert [len(r.kept) for r in suffix_dedup.find_repeats(same, 64).collect()] == [0, 0]


def test_expansion_against_all_windows():
    rng = random.Random(8)
    for _ in range(150):
        least, letters = rng.choice([1, 2, 3, 5, 9, 20]), rng.choice([b"ab", b"abc", bytes([0, 1, 255]), bytes(range(97, 123))])
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(least, 60))) for _ in range(rng.randint(1, 6))]
        pieces += [pieces[0][1:] + letters[:1] * least] * (rng.random() < 0.5)
        for first in (False, True):
            gone, _ = bwt.repeated(pieces, least, first)
            want = brute_windows(pieces, least, first)
            assert [g.tolist() for g in gone] == want


def brute_windows(pieces, least, first):
    count = collections.Counter(p[i : i + least] for p in pieces for i in range(len(p) - least + 1))
    seen, out = set(), []
    for p in pieces:
        row = []
        for i in range(len(p) - least + 1):
            w = p[i : i + least]
            row.append(w in seen if first else count[w] > 1)
            seen.add(w)
        out.append(row)
    return out


# 7 mixing


def test_mix_against_sql(spark, duck):
    same_rows(queries.QUERIES["op7_mixing"](spark, DATA), duck, queries.ORACLES["op7_mixing"])


def test_mix_is_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, most = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s]
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_targets_fill_up(spark, monkeypatch):
    for each in (1, 100):  # a partition for each source; all in one
        monkeypatch.setattr(mixing, "SOURCES", each)
        sizes = spark.createDataFrame([("b", 100), ("a", 10), (None, 1000)], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(sizes, common.Scratch(spark, "t")).collect()}
        assert got["a"] == 30 and got["b"] == 300 and got[None] == pytest.approx(780)
    sizes = spark.createDataFrame([("a", 0), ("b", 0)], "source string, size long")
    assert [r.target for r in mixing.targets(sizes, common.Scratch(spark, "t")).collect()] == [0, 0]
    one = spark.createDataFrame([("a", 9)], "source string, size long")
    assert mixing.targets(one, common.Scratch(spark, "t"), share=10.0).first().target == 27


def brute_mix(rows, weights=(5.0, 2.0, 1.0)):
    """Copies of (doc_id, text, source) rows: one sorted run over each source."""
    import hashlib
    from math import floor

    size = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    n = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    w, target = {s: weights[i % 3] for i, s in enumerate(names)}, {}
    while open_ := [s for s in names if s not in target]:
        free = sum(n.values()) - sum(target.values())
        full = [s for s in open_ if free * w[s] / sum(w[x] for x in open_) > 3 * n[s]]
        if not full:
            target |= {s: free * w[s] / sum(w[x] for x in open_) for s in open_}
        target |= {s: 3.0 * n[s] for s in full}
    out, u = collections.Counter(), mixing.offset(7)
    for s in names:
        own = sorted(((size(t), hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest(), d, t) for d, t, x in rows if x == s), key=lambda r: r[:2])
        each = target[s] / n[s] if n[s] else 0.0
        for i, (k, _, d, t) in enumerate(own, 1):
            out[d, t, s] += floor(i * each + u) - floor((i - 1) * each + u)
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("slice_rows", [500, 3])
def test_mix_on_any_ids(spark, monkeypatch, kind, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rng = random.Random(12)
    own = lambda: rng.choice([None, -(2**63), 2**63 - 1, rng.randint(-(2**63), 2**63 - 1), 7])
    rows = [(own(), rng.choice(["a b", "same size", "", None, "w " * rng.randint(1, 20)]), rng.choice(["x", "y", None])) for _ in range(300)]
    rows = [(d if kind == "long" or d is None else f"id-{d}", t, s) for d, t, s in rows] * 2
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string")
    got = collections.Counter()
    for r in mixing.mix(frame, keep_text=True).collect():
        got[r.doc_id, r.text, r.source] += r.copies
    assert got == brute_mix(rows)


def test_mix_edges(spark):
    rows = docs(spark, "a b", "a b", None, "").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixing.mix(rows.union(rows)).collect()
    assert len(got) == 8 and sum(r.taken for r in got) == 8
    assert mixing.mix(rows.limit(0)).count() == 0
    empty = mixing.mix(docs(spark, None, "")).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0)] * 2
    assert {r.text for r in mixing.mix(docs(spark, "a b"), keep_text=True).collect()} == {"a b"}


def test_hot_size_is_sliced(spark, monkeypatch):
    rows = spark.createDataFrame([(i * 3, "same size", "s") for i in range(3000)] + [(None, "same size", "s")], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(rows).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    assert sorted(map(str, mixing.mix(rows).collect())) == want


# 8 licences


def brute_licenses(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_places(spark, texts):
    got = queries.QUERIES["op8_licenses"](spark, DATA).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {k: brute_licenses(t) for k, t in texts.items()}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_cases(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Released under the MIT License.": "mit",
        "CC-\nBY and cc by": "cc-by",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "GNU Lesser General Public License v2.1": "lgpl-2.1",
        "the Mozilla Public License 2.0": "mpl-2.0",
        "All rights reserved.": "all-rights-reserved",
        "Éapache license": "", "a gnu. general, public; LICENSE": "gpl",
    }
    got = licenses.scan(docs(spark, *cases)).orderBy("doc_id").collect()
    assert [",".join(r.labels) for r in got] == list(cases.values())
    odd = licenses.scan(docs(spark, *ODD, "MIT License " * 2000).withColumn("labels", F.lit("clash"))).orderBy("doc_id").collect()
    assert [(r.n_words, len(r.places)) for r in odd] == [brute_licenses(t)[:2] for t in [*ODD, "MIT License " * 2000]]
    assert licenses.scan(docs(spark, "a").limit(0)).count() == 0


def sample(parsed, rng):
    """A random string that a parsed regex matches."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "IN":
            out += "w" if str(x[0][0]) == "CATEGORY" else chr(rng.choice(x)[1])
        elif op == "MAX_REPEAT":
            out += "".join(sample(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 2))))
        elif op == "BRANCH":
            out += sample(rng.choice(x[1]), rng)
        elif op == "SUBPATTERN":
            out += sample(x[3], rng)
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def brute_detections(text):
    """All matches of all rules by Python's regex engine, then suppression by its definition, as (label, first, last word, priority)."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    line = " " + "".join(w + " " for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low))
    found = []
    for label, regex, priority, _ in licenses.rules():
        found += [(m.start(), -m.end(), -priority, label) for m in re.finditer(regex, line, re.ASCII)]
    found.sort()
    kept = [x for i, x in enumerate(found) if not any(y[1] <= x[1] and y[2] <= x[2] for y in found[:i])]
    word = lambda at: line.count(" ", 0, at) - 1
    return [(label, word(s), word(-e), -p) for s, e, p, label in kept]


def test_detections_by_brute_force(spark, monkeypatch):
    from re import _parser

    rng = random.Random(21)
    rules = [_parser.parse(regex) for _, regex, *_ in licenses.rules()]
    texts = [" ".join(sample(rng.choice(rules), rng) if rng.random() < 0.6 else rng.choice(["or", "license", "the", "2.0", "under", "é"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    want = [brute_detections(t) for t in texts]
    for together in (256, 2):
        monkeypatch.setattr(licenses, "TOGETHER", together)
        got = licenses.scan(docs(spark, *texts).repartition(4)).orderBy("doc_id").collect()
        assert [[tuple(x) for x in r.detections] for r in got] == want


def test_license_names_without_the_word(spark):
    cases = {
        "Released under the Apache 2.0.": ("apache,apache-2.0", 1.0), "MPL 2.0 or later": ("mpl-2.0", 1.0), "EPL 2.0": ("epl-2.0", 1.0), "LGPL 2.1": ("lgpl-2.1", 1.0),
        "Released under terms of the BSD": ("bsd", 0.8), "available under terms of MIT": ("mit", 0.8), "Creative Commons Zero": ("cc0-1.0", 1.0),
        "distributed under 3-clause BSD": ("bsd-3-clause", 0.8), "published (as is) under original BSD": ("bsd-4-clause", 0.8), "a simple example under review": ("", 0.0),
    }
    got = licenses.scan(docs(spark, *cases)).orderBy("doc_id").collect()
    assert [(",".join(r.labels), r.score) for r in got] == list(cases.values())


def test_license_prefilter_loses_nothing(spark):
    from re import _parser

    rng = random.Random(8)
    # each text is a match of one rule and nothing else
    rows = docs(spark, *[sample(_parser.parse(regex), rng).replace(" ", rng.choice([" ", "-", "\n", ". "])).title() for _, regex, *_ in licenses.rules() for _ in range(3)])
    got, want = (licenses.scan(rows.repartition(4), x).orderBy("doc_id").collect() for x in (True, False))
    assert all(r.labels for r in want) and got == want


def test_rules_are_many_and_native(spark):
    assert len(licenses.rules()) > 200
    plan = licenses.scan(docs(spark, "a"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 9 top-k


def test_topk_against_sql(spark, duck):
    same_rows(queries.QUERIES["op9_topk"](spark, DATA), duck, queries.ORACLES["op9_topk"])


def test_topk_by_hand(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(10)
    vecs = [rng.normal(size=6).round(2).tolist() for _ in range(150)] + [[0.0] * 6] * 3 + [[1.0] * 6] * 9 + [[1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(900, None), (950, [float("nan")] * 6), (1000, [None] + [1.0] * 5), (1050, [float("inf")] * 6), (None, [1.0] * 6), (3, vecs[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.topk(df, F.col("vec_id") % 10 == 0).collect()
    q = {i: np.floor(256 * np.float64(np.float32(np.array(v + [0.0] * (6 - len(v)))))).astype(int) if len(v) == 6 else np.r_[np.floor(256 * np.array(v)).astype(int), [0] * 4] for i, v in enumerate(vecs)}
    want = []
    for a in q:
        if a % 10 == 0:
            best = sorted(((-int(q[a] @ q[b]), b) for b in q if b != a))[:5]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_leaves_short_blocks_alone(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 10)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    formed = []
    pairs_of = topk.block_pairs
    monkeypatch.setattr(topk, "block_pairs", lambda *a: formed.append((pairs_of(*a).count(), a[4] - a[3] + 1)) or pairs_of(*a))
    rng = np.random.default_rng(2)
    vecs = [rng.normal(size=4) for _ in range(400)]
    vecs = [(v / np.linalg.norm(v) * (100 / (1 + i))).tolist() for i, v in enumerate(vecs)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.topk(df, F.col("vec_id") % 50 == 0).collect()}
    q = np.floor(256 * np.array(vecs)).astype(int)
    for a in range(0, 400, 50):
        best = sorted((-int(q[a] @ q[b]), b) for b in range(400) if b != a)[:5]
        assert [got[a, k + 1] for k in range(5)] == [(b, -s) for s, b in best]
    assert sum(n for _, n in formed) >= 40 and sum(n for n, _ in formed) < 15


def test_topk_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.topk(df, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.topk(df, F.col("vec_id") == 7).count() == 0


def test_topk_of_large_components(spark):
    vecs = [[float(2**23), 1.0], [float(2**23), 2.0], [float(2**22), 3.0], [-float(2**23) - 1.0, 5.0], [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    dot = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(vecs[a], vecs[b]))
    want = sorted((-dot(0, b), b) for b in range(1, 5))
    assert sorted(map(tuple, topk.topk(df, F.col("vec_id") == 0).collect())) == [(0, k + 1, b, -s) for k, (s, b) in enumerate(want)]


# 10 LM scores


def test_network_gradient():
    flat = lm_scores.start(1)
    rng = np.random.default_rng(1)
    around, truth = rng.integers(0, lm_scores.CLASSES, (40, 4)).astype(np.int32), rng.integers(0, 5, 40)
    loss = lambda: -lm_scores.forward(trainer.flat, around)[1][np.arange(40), truth].mean()
    trainer = lm_scores.Trainer(flat)
    before = loss()
    for _ in range(60):
        trainer.learn(around, truth)
    assert loss() < 0.5 * before


def test_scores_are_sums_of_conditionals(spark):
    rows = ["the cat sat on the mat", "mat the on sat cat the", "the", None, "", "  ", "the cat sat on the mat"]
    train_on = docs(spark, *(["the cat sat on the mat . the dog sat on the rug ."] * 4000))
    voc = lm_scores.Vocabulary.gather(lm_scores.word_counts(train_on))
    flat = lm_scores.train(train_on, voc, rounds=3, stride=1)
    got = lm_scores.score_documents(docs(spark, *rows).withColumn("log_prob", F.lit("clash")), voc, flat).orderBy("doc_id").collect()
    assert got[0].log_prob == got[-1].log_prob and got[0].mean_log_prob > got[1].mean_log_prob
    assert [(r.n_words, r.log_prob, r.mean_log_prob) for r in got[3:6]] == [(0, 0.0, None)] * 3
    own = [voc.code(w) for w in b"the cat sat on the mat".split()]
    padded = [lm_scores.OUTSIDE] * 2 + [c // lm_scores.BUCKETS for c in own] + [lm_scores.OUTSIDE] * 2
    total = 0.0
    for i, c in enumerate(own):
        around = np.array([[padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]], np.int32)
        total += lm_scores.forward(flat, around)[1][0, c // lm_scores.BUCKETS] + voc.inner[c]
    assert got[0].log_prob == pytest.approx(total, rel=1e-5)
    assert lm_scores.score_documents(docs(spark, "a").limit(0), voc, flat).count() == 0


def test_training_takes_every_position(spark):
    rows = docs(spark, *[" ".join(f"{'abcdefgh'[(i + j) % 8]}{j % 16}" for j in range(16 * i)) for i in range(1, 9)]).coalesce(1)
    voc = lm_scores.Vocabulary.gather(lm_scores.word_counts(rows))
    classes = [np.array([voc.code(w) // lm_scores.BUCKETS for w in lm_scores.words(r.text)], np.int32) for r in rows.collect()]
    trainer = lm_scores.Trainer(lm_scores.start())
    trainer.learn(np.concatenate([lm_scores.windows(c) for c in classes]), np.concatenate(classes))
    assert trainer.seen == 16 * 36
    assert np.allclose(lm_scores.train(rows, voc, rounds=1), trainer.flat, atol=1e-6)


def test_words_are_hashed_together(texts):
    odd = ["ß İΣ Σ", "", " \x1c a\x0bb\x85c d\t\n", "x" * 300 + " " + "y" * 256 + " z " + "y" * 257, "é", "ΑΣ", "  a", "\n"]
    every = [*odd, *list(texts.values())[:40]]
    own = [lm_scores.words(t) for t in every]
    got, sizes = lm_scores.hashes(every)
    assert sizes.tolist() == [len(w) for w in own]
    assert got.tolist() == [lm_scores.word_hash(w) for ws in own for w in ws]
    assert (got % lm_scores.ENDINGS).tolist() == [lm_scores.ending(w) for ws in own for w in ws]
    assert len(set(got.tolist())) == len({w for ws in own for w in ws})
    cost = {}
    many = [t for t in every * 100 if t]
    for f in (lambda: lm_scores.hashes(many), lambda: collections.Counter(lm_scores.word_hash(w) for t in many[: len(many) // 100] for w in lm_scores.words(t))):
        start = time.process_time()
        f()
        cost[len(cost)] = time.process_time() - start
    assert cost[0] < 50 * cost[1]  # half of what single words would take


def test_gradient_and_windows_of_joined_texts(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.array([0, 5, 1, 0, 700, 2, 0])
    classes = rng.integers(0, lm_scores.OUTSIDE, sizes.sum()).astype(np.int32)
    cuts = np.split(classes, np.cumsum(sizes)[:-1])
    around = lm_scores.windows(classes, None, sizes)
    assert (around == np.concatenate([lm_scores.windows(c) for c in cuts])).all()
    trainer = lm_scores.Trainer(lm_scores.start(3))
    monkeypatch.setattr(trainer, "_move", lambda: None)
    trainer._step(around, classes)
    first, b1, second, b2 = (x.astype(np.float64) for x in lm_scores.unpack(trainer.flat))
    h = np.tanh(sum(first[k][around[:, k]] for k in range(4)) + b1)
    e = np.exp(h @ second + b2)
    e /= e.sum(1, keepdims=True)
    e[np.arange(len(classes)), classes] -= 1
    e /= len(classes)
    dh = (e @ second.T) * (1 - h * h)
    want = [np.zeros_like(first), dh.sum(0), h.T @ e, e.sum(0)]
    for k in range(4):
        np.add.at(want[0][k], around[:, k], dh)
    for got, own in zip(lm_scores.unpack(trainer.grad), want):
        assert np.allclose(got, own, atol=1e-6)


def test_word_counts_cover_everything(spark, texts):
    got = {r.word: r.n for r in lm_scores.word_counts(all_docs(spark)).collect()}
    want = collections.Counter(lm_scores.word_hash(w) for t in texts.values() for w in lm_scores.words(t))
    assert got == want


def test_lm_query_and_empty_corpus(spark, texts):
    assert queries.QUERIES["op10_lm_scores"](spark, DATA).count() == len(texts)
    none = docs(spark, "a").limit(0)
    voc = lm_scores.Vocabulary.gather(lm_scores.word_counts(none))
    assert len(lm_scores.train(none, voc)) == len(lm_scores.start())
