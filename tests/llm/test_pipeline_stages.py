"""The corpus pipeline's stages on planted cases, and the whole run."""

import random

from conftest import DATA
from pyspark.sql import functions as F
from test_operators import DOCS, brute_links

import corpus_pipeline as P


def write(spark, tmp_path, rows):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage, item = prose(150), prose(60), "What is the name of the quiet village " + prose(12) + "? It is " + prose(5) + "."
    texts = [prose(80) for _ in range(60)] + [prose(40) + " idiot scum moron trash " + prose(40) for _ in range(60)]
    planted = {"base": base, "copy": base, "near": base.replace(" ", "  ", 3).upper(), "with": prose(50) + " " + passage, "again": passage + " " + prose(50), "leak": prose(70) + " " + item, "clean": prose(90), "null": None, "empty": ""}
    ids = {name: 1000 + k for k, name in enumerate(planted)}
    all_rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(ids[n], t, "en", "s1", len(t or "")) for n, t in planted.items()]
    spark.createDataFrame(all_rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return ids, passage


def test_planted_cases(spark, tmp_path):
    ids, passage = write(spark, tmp_path, None)
    got, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == list(P.COLUMNS)
    toxic = got["toxicity"]
    assert sum(i in toxic for i in range(60)) >= 57 and sum(i in toxic for i in range(60, 120)) <= 3
    assert {ids["clean"], ids["null"], ids["empty"]} <= set(toxic)
    near = got["near_copies"]
    assert ids["base"] in near and ids["copy"] not in near and ids["near"] not in near
    want = brute_links([(i, r.text) for i, r in toxic.items()], 5, 4, 5)
    assert set(near) == {i for i, (_, n, c) in want.items() if not n or c == i}
    cut = got["repeats"]
    assert passage in cut[ids["with"]].text and passage not in cut[ids["again"]].text
    assert cut[ids["clean"]].text == near[ids["clean"]].text and cut[ids["null"]].text is None
    assert all(r.n_chars == len(r.text or "") for r in cut.values())
    assert set(cut) - set(got["decontamination"]) == {ids["leak"]}
    assert set(got["mixing"]) <= set(got["decontamination"])


def test_whole_run(spark):
    out = P.run(spark, DATA)
    assert {"doc_id", "text", "copy", "target"} <= set(out.columns) and out.count() > 0


def odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("toxicity", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    nothing = (None, None, None, None, None)
    rows = [nothing, nothing, (1, "", None, None, 0), (1, "", None, None, 0), (2, "word " * 30_000, "en", "s", None), (3, None, "en", "s", 0), (4, "a text of its own", "de", None, 17)]
    docs = odd_tables(spark, tmp_path, rows)
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = {r.doc_id for r in out.collect()}
        assert 4 in got and got <= {None, 1, 2, 3, 4}, name
        if name != "mixing":
            assert out.columns == list(P.COLUMNS) and got == {None, 1, 2, 3, 4}, name


def test_mixing_of_rows_that_differ_in_one_column(spark, tmp_path):
    rows = [(1, "a b c", "en", s, 5) for s in ("x", "y", None) for _ in range(4)] + [(1, "a b c", None, "en", 5)]
    docs = odd_tables(spark, tmp_path, rows)
    sizes = {(r.source, r.lang): r.source_size for r in P.mix_sources(spark, docs, str(tmp_path)).collect()}
    assert all(n == (3 if s == "en" else 12) for (s, _), n in sizes.items()) and {("x", "en"), ("en", None)} <= set(sizes)
    runs = [sorted(map(str, P.mix_sources(spark, docs.repartition(k), str(tmp_path)).collect())) for k in (1, 5)]
    assert runs[0] == runs[1]


def test_stages_on_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, [])
    for name, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
