"""Jobs: ``python -m foliomill run|headings|sections|tables|lists ...`` (or with spark-submit)."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lines, lists, sections, tables, toc
from .plans.pipeline import parse
from .sources import readers, writers


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="foliomill", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    for name, text in (
        ("run", "a folder of documents to <name>.json (headings) and <name>_content.json (sections)"),
        ("headings", "headings of a document or folder"),
        ("sections", "sections of a document or folder"),
        ("tables", "sections with their tables"),
    ):
        s = sub.add_parser(name, help=text)
        s.add_argument("source")
        s.add_argument("--no-dedup", action="store_true", help="keep repeated headings")
        if name != "run":
            s.add_argument("--json", action="store_true", help="JSON instead of display lines")
        if name in ("sections", "tables"):
            s.add_argument("--headings", help="headings JSON of an earlier run, in place of the contents pages")
    sub.choices["run"].add_argument("out")
    sub.choices["sections"].add_argument("--preview", type=int, default=120, help="characters of content to show")
    sub.choices["tables"].add_argument("--content", help="sections JSON of an earlier run")
    sub.choices["tables"].add_argument("--out", help="folder for the JSON files")
    sub.add_parser("lists", help="lists of a sections JSON of an earlier run").add_argument("source")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, decoder: readers.Decoder = readers.pdfplumber_decoder) -> int:
    """Runs a job; 1 if the source does not exist. Documents that fail are reported and do not end the run."""
    args = arguments(argv)
    if "://" not in args.source and not Path(args.source).exists():
        print(f"not found: {args.source}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName(f"foliomill {args.job}").getOrCreate()
    if args.job == "lists":
        _report(readers.broken_json(spark, args.source, True))
        return _lists(spark, args.source)
    found = _files(spark, args.source)
    if found.select("doc_id").isEmpty():
        print(f"no documents in {args.source}", file=sys.stderr)
        return 0
    pages = readers.decoded(found, decoder).persist()
    failed = pages.where("error is not null").select("doc_id", "error")
    _report(failed)
    text_lines, words, grids = readers.relations(pages)
    if args.job == "run":
        result = parse(text_lines, words, grids, dedup=not args.no_dedup, caption_words=readers.caption_words(pages))
        writers.write_json(writers.headings_documents(result.headings), args.out)
        writers.write_json(writers.sections_documents(result.sections), args.out, readers.CONTENT)
        print(f"{pages.where('error is null').select('doc_id').distinct().count()} of {pages.select('doc_id').distinct().count()} documents")
        return 0
    given = getattr(args, "headings", None)
    if given:
        _report(readers.broken_json(spark, given))
    found = readers.headings_json(spark, given) if given else toc.headings(text_lines)
    found = found if args.no_dedup or given else toc.deduplicated(found)
    if args.job == "headings":
        return _show(writers.headings_documents(found) if args.json else toc.outline(found).orderBy("doc_id", "pos").select("line"))
    body = lines.body_lines(words)
    content = getattr(args, "content", None)
    if content:
        _report(readers.broken_json(spark, content, True))
    out = readers.sections_json(spark, content) if content else sections.sections(body, found)
    if args.job == "sections":
        if args.json:
            empty = out.withColumns({"lists": F.lit(None).cast("array<string>"), "tables": F.lit(None).cast("array<string>")})
            return _show(writers.sections_documents(empty))
        return _show(sections.previews(out, args.preview).orderBy("doc_id", "sec_pos").select(F.concat_ws("\n", "line", "preview")))
    out = out if "lists" in out.columns else lists.with_lists(out)
    out = tables.with_tables(out, grids, readers.caption_words(pages), body, found)
    if args.out:
        writers.write_json(writers.sections_documents(out), args.out, readers.CONTENT)
    totals = tables.table_totals(out).orderBy("doc_id").select(F.concat("doc_id", F.lit(": "), "n_tables", F.lit(" tables")))
    return _show(writers.sections_documents(out) if args.json else totals)


def _files(spark: SparkSession, source: str) -> DataFrame:
    path = Path(source)
    return readers.files(spark, str(path.parent), path.name) if path.is_file() else readers.files(spark, source)


def _lists(spark: SparkSession, source: str) -> int:
    """Totals, then the first four items of each list."""
    found = lists.with_lists(readers.sections_json(spark, source)).persist()
    _show(lists.list_totals(found).select(F.concat("doc_id", F.lit(": "), "n_lists", F.lit(" lists, "), "n_items", F.lit(" items"))))
    each = found.select("doc_id", "sec_pos", "number", F.posexplode("lists").alias("k", "l")).orderBy("doc_id", "sec_pos", "k")
    return _show(each.select(F.concat(F.lit("["), "number", F.lit("] "), "l.type", F.lit(" "), "l.topic", F.lit(": "), F.array_join(F.slice("l.items", 1, 4), " | "))))


def _report(errors: DataFrame) -> None:
    for r in errors.orderBy("doc_id").toLocalIterator():
        print(f"{r.doc_id}: {r.error}", file=sys.stderr)


def _show(rows: DataFrame) -> int:
    """Prints the last column, a row at a time."""
    for r in rows.toLocalIterator():
        print(r[-1])
    return 0


if __name__ == "__main__":
    sys.exit(main())
