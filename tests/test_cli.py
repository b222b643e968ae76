from test_pipeline import decoder, folder

from foliomill.__main__ import main


def test_jobs(spark, tmp_path, capsys):
    source = folder(tmp_path)
    assert main(["headings", str(tmp_path / "missing")], decoder) == 1
    assert main(["headings", source], decoder) == 0
    out = capsys.readouterr()
    assert "[H1]  1. Введение" in out.out and "ValueError: no document" in out.err
    assert main(["run", source, str(tmp_path / "out")], decoder) == 0
    assert "1 of 2 documents" in capsys.readouterr().out
    assert sorted(p.name for p in (tmp_path / "out").glob("[!.]*")) == ["doc one.json", "doc one_content.json"]
    heads = tmp_path / "out" / "doc one.json"
    assert main(["sections", f"{source}/doc one.pdf", "--preview", "5"], decoder) == 0
    assert "текст…" in capsys.readouterr().out
    assert main(["sections", source, "--json"], decoder) == 0
    assert '"number":"1"' in capsys.readouterr().out
    assert main(["tables", source, "--out", str(tmp_path / "tables")], decoder) == 0
    assert "doc one: 1 tables" in capsys.readouterr().out
    saved = tmp_path / "doc one_content.json"
    saved.write_text((tmp_path / "tables" / "doc one_content.json").read_text())
    assert main(["lists", str(saved)]) == 0
    assert "doc one: 0 lists, 0 items" in capsys.readouterr().out
    given = tmp_path / "doc one.json"
    given.write_text(heads.read_text())
    assert main(["tables", source, "--headings", str(given), "--content", str(saved), "--json"], decoder) == 0
    assert '"caption":"Таблица"' in capsys.readouterr().out


def test_a_runs_files_feed_later_jobs(spark, tmp_path, capsys):
    source, out = folder(tmp_path), str(tmp_path / "out")
    (tmp_path / "in" / "100% & a+b=c.pdf").write_text("текст")
    for _ in range(2):  # a second run replaces the files
        assert main(["run", source, out], decoder) == 0
    capsys.readouterr()
    assert main(["sections", source, "--headings", out], decoder) == 0
    assert capsys.readouterr().out.count("Введение") == 2
    assert main(["lists", out]) == 0
    shown = capsys.readouterr().out
    assert "doc one: 0 lists" in shown and "100% & a+b=c: 0 lists" in shown
    (tmp_path / "out" / "torn.json").write_text('[{"level":')
    (tmp_path / "out" / "torn_content.json").write_text("[{")
    assert main(["sections", source, "--headings", out], decoder) == 0
    assert "torn: not a JSON array" in capsys.readouterr().err
    assert main(["lists", out]) == 0
    assert "torn: not a JSON array" in capsys.readouterr().err
    (tmp_path / "none").mkdir()
    assert main(["run", str(tmp_path / "none"), out], decoder) == 0
    assert "no documents in" in capsys.readouterr().err
