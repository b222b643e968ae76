"""Files in, sections out: a decoder of plain text stands in for PDF."""

from foliomill.plans.pipeline import parse
from foliomill.sources import readers, writers
from foliomill.streaming.folder import parse_stream

PAGE_1 = "Оглавление\n1 Введение 2\n1.1 Таблицы 2"


def decoder(content: bytes):
    text = content.decode()
    if text == "bad":
        raise ValueError("no document")
    words = [("1", 10.0, 10.0, 20.0, "Arial-Bold", 14.0), ("Введение", 20.0, 10.0, 20.0, "Arial-Bold", 14.0), (text, 10.0, 40.0, 50.0, "Arial", 11.0), ("Таблица", 10.0, 80.0, 90.0, "Arial", 11.0)]
    grid = [["a", "b"], ["c", "d"], ["e", None]]
    yield 0, PAGE_1, [], []
    yield 1, "", words, [(0.0, 95.0, 9.0, 200.0, grid)]


def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("doc one.pdf", "текст"), ("two.pdf", "bad"), ("skip.txt", "x")):
        (tmp_path / "in" / name).write_text(text)
    return str(tmp_path / "in")


def test_folder_to_json_and_back(spark, tmp_path):
    pages = readers.decoded(readers.files(spark, folder(tmp_path)), decoder).persist()
    assert {(r.doc_id, r.error) for r in pages.select("doc_id", "error").distinct().collect()} == {("doc one", None), ("two", "ValueError: no document")}
    result = parse(*readers.relations(pages))
    got = result.sections.collect()
    assert [(r.number, r.content, r.tables[0].caption, r.tables[0]["rows"][2]) for r in got] == [("1", "текст Таблица", "Таблица", ["e", ""])]
    json = writers.sections_documents(result.sections.withColumn("tables", result.sections.tables))
    text = json.first().json
    assert '"caption":"Таблица"' in text
    out = tmp_path / "out"
    out.mkdir()
    (out / "doc one_content.json").write_text(text)
    (out / "doc one.json").write_text(writers.headings_documents(result.headings).first().json)
    back = readers.sections_json(spark, str(out / "*_content.json")).drop("sec_pos").collect()
    assert [r.asDict(True) for r in back] == [r.asDict(True) for r in result.sections.select(*back[0].asDict()).collect()]
    assert [(r.pos, r.number, r.text) for r in readers.headings_json(spark, str(out / "doc one.json")).collect()] == [(0, "1", "Введение"), (1, "1.1", "Таблицы")]
    writers.write_json(json, str(tmp_path / "json"), "_content")
    again = readers.sections_json(spark, str(tmp_path / "json"))
    assert [r.asDict(True) for r in again.drop("sec_pos").collect()] == [r.asDict(True) for r in back]


def test_words_of_captions(spark, tmp_path):
    def split_by_font(content: bytes):
        for page in decoder(content):
            k, text, words, grids = page
            yield k, text, words, grids, [("Таблица 1. Общая", 10.0, 80.0, 90.0)] if grids else []

    pages = readers.decoded(readers.files(spark, folder(tmp_path)), split_by_font)
    result = parse(*readers.relations(pages), caption_words=readers.caption_words(pages))
    assert [r.tables[0].caption for r in result.sections.collect()] == ["Таблица 1. Общая"]


def test_null_captions_are_kept(spark):
    rows = spark.createDataFrame([("d", 0, "H1", 1, "1", "h", "c", [], [(None, [["a"]])])], "doc_id string, sec_pos int, level string, depth int, number string, heading string, content string, lists array<struct<type:string,topic:string,items:array<string>>>, tables array<struct<caption:string,rows:array<array<string>>>>")
    assert '"caption":null' in writers.sections_documents(rows).first().json


def test_stream(spark, tmp_path):
    query = parse_stream(spark, folder(tmp_path), str(tmp_path / "out"), str(tmp_path / "ck"), decoder)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "sections")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "errors")).first().doc_id == "two"
