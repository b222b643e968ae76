"""Line and title functions as Column expressions: no UDF, all inside code generation where Spark allows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regex as R


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where no projection can hold it (inside lambdas, in long conditions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# A pattern decodes its text each time, so cheap comparisons of bytes come first where they rule most texts out.


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(R.WHITE))


def _solid(c: Column) -> Column:
    """Whether a text starts with a character known to be none of ``WHITE``."""
    return ((c >= F.lit("!")) & (c < F.lit("\x7f"))) | ((c >= F.lit("\xa1")) & (c < F.lit("\u1680")))


def stripped(rows: DataFrame, name: str = "text") -> DataFrame:
    """Rows with ``s``, a text without white space at its edges; most have nothing to strip, as their last character tells."""
    rows = rows.withColumn("_last", F.substring(name, -1, 1))
    return rows.withColumn("s", F.when(_solid(F.col(name)) & _solid(F.col("_last")), F.col(name)).otherwise(strip(F.col(name)))).drop("_last")


def _single_blanks(c: Column) -> Column:
    """Runs of white space to one blank; ``c`` is a plain column."""
    return F.when(F.contains(c, F.lit("  ")) | c.rlike(R.ODD_SPACE), F.regexp_replace(c, R.SPACE, " ")).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the edges; ``c`` is a plain column."""
    return F.trim(_single_blanks(c))


def may_number(c: Column) -> Column:
    """Whether a text can start with a digit of any script (the lowest beyond ASCII is U+0660)."""
    return ((c >= F.lit("0")) & (c < F.lit(":"))) | (c >= F.lit("\u0660"))


def _may_name(c: Column) -> Column:
    """Whether a text can start with a word of the contents' own: none starts below К."""
    return c >= F.lit("К")


def is_leader(c: Column) -> Column:
    """``BODY_LEADER``."""
    return F.contains(c, F.lit("...")) | F.contains(c, F.lit("……"))


def is_toc_leader(c: Column) -> Column:
    """``TOC_LEADER``: three dots with no more than white space between, or two ellipses."""
    return is_leader(c) | ((F.contains(c, F.lit(".")) | F.contains(c, F.lit("…"))) & c.rlike(R.THREE_DOTS))


def is_plain_entry(stripped: Column) -> Column:
    return may_number(stripped) & stripped.rlike(R.PLAIN_ENTRY)


def is_skipped_line(stripped: Column) -> Column:
    return _may_name(stripped) & stripped.rlike(R.SKIPPED)


def is_appendix(stripped: Column) -> Column:
    return _may_name(stripped) & stripped.rlike(R.APPENDIX)


def is_toc_header(stripped: Column, whole: bool = True) -> Column:
    return _may_name(stripped) & stripped.rlike(R.TOC_HEADER if whole else R.TOC_HEADER_OPEN)


def any_of(c: Column, *words: str) -> Column:
    found = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(c, F.lit(w))
    return found


def is_citation(c: Column) -> Column:
    """``CITATION``: its words in lower case, unless a letter stands there that the pattern takes for i or s."""
    words = lambda low: any_of(low, "vol.", "et al", "// ", "doi:", "isbn") | (F.contains(low, F.lit("p.")) & low.rlike(R.CITED_PAGE))
    return F.when(any_of(c, "ı", "İ", "ſ"), c.rlike(R.CITATION)).otherwise(c.rlike(R.CITED_YEAR) | let(F.lower(c), words))


def is_caption(c: Column) -> Column:
    """``CAPTION``, which its words decide, unless a letter stands there that the pattern takes for т."""
    return F.when(any_of(c, "\u1c84", "\u1c85"), c.rlike(R.CAPTION)).otherwise(let(F.lower(c), lambda low: any_of(low, "табл", "table")))


def is_diagnostic(c: Column) -> Column:
    """``DIAGNOSTIC``, which no text of ASCII alone holds."""
    return (F.octet_length(c) > F.length(c)) & c.rlike(R.DIAGNOSTIC)


def normalize_line(c: Column) -> Column:
    """Joins a number broken by blanks at the start of a line: ``3. 3Text`` to ``3.3Text``."""
    prefix = F.regexp_replace(F.regexp_extract(c, R.BROKEN_NUMBER, 1), r"(?Ud)\.\s*", ".")
    rest = F.substring(c, F.length(F.regexp_extract(c, R.BROKEN_NUMBER, 0)) + 1, F.length(c))
    return F.when(may_number(c) & c.rlike(R.BROKEN_NUMBER), F.concat(prefix, F.lit("."), F.regexp_extract(c, R.BROKEN_NUMBER, 2), rest)).otherwise(c)


def normalize_number(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?Ud)\.+\z", "")


def depth(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def level(number: Column) -> Column:
    return F.concat(F.lit("H"), depth(number).cast("string"))


def _letter(c: Column) -> Column:
    """Whether a single character is one of A to z or of the Cyrillic letters."""
    return ((c >= F.lit("A")) & (c < F.lit("{"))) | ((c >= F.lit("\u0400")) & (c < F.lit("\u0530")))


def _without(c: Column, pattern: str) -> Column:
    """Without a trailer, which neither a letter nor a letter and a full stop end; ``c`` is a plain column."""
    last, before = F.substring(c, -1, 1), F.substring(c, -2, 1)
    as_is = _letter(last) | ((last == F.lit(".")) & _letter(before))
    return F.when(as_is, F.ltrim(c, F.lit(R.WHITE))).otherwise(strip(F.regexp_replace(c, pattern, "")))


def strip_dots(c: Column) -> Column:
    """Without leaders and the page number after them; ``c`` is a plain column."""
    return _without(c, R.TRAILER_DOTS)


def strip_page(c: Column) -> Column:
    """Without a page number at the end; ``c`` is a plain column."""
    return _without(c, R.TRAILER_PAGE)


def is_page_number(c: Column) -> Column:
    return may_number(c) & c.rlike(R.PAGE_NUMBER)


def toc_entry(stripped: Column, fmt: Column) -> Column:
    """struct(number, title) of a table-of-contents line, null if it is none."""
    title = let(F.regexp_extract(stripped, R.TOC_ENTRY, 2), lambda rest: toc_title(rest, fmt))
    return F.when(is_toc_entry(stripped), let(title, lambda t: toc_named(stripped, t)))


def is_toc_entry(stripped: Column) -> Column:
    """Whether a line has the shape of an entry, with a title or not."""
    return may_number(stripped) & stripped.rlike(R.TOC_ENTRY) & ~is_skipped_line(stripped) & ~is_page_number(stripped)


def toc_title(rest: Column, fmt: Column) -> Column:
    """The title in what follows an entry's number, a plain column."""
    return F.when(fmt == "A", strip_dots(rest)).otherwise(strip_page(rest))


def toc_named(stripped: Column, title: Column) -> Column:
    """struct(number, title) of an entry with that title, null if it has none."""
    number = normalize_number(F.regexp_extract(stripped, R.TOC_ENTRY, 1))
    return F.when((title != "") & ~is_page_number(title), F.struct(number.alias("number"), title.alias("title")))


def normal_heading(c: Column) -> Column:
    """For comparison by text: lower case, single blanks, then without punctuation."""
    return F.regexp_replace(F.lower(let(strip(c), _single_blanks)), r"(?Ud)[^\w\s]", "")


def fragment_base(heading: Column) -> Column:
    """A heading as ``is_part`` reads it."""
    return F.lower(let(strip(heading), _single_blanks))


def is_part(line: Column, base: Column) -> Column:
    """``is_fragment`` of a heading given as its ``fragment_base``."""
    return let(F.lower(let(strip_dots(line), _single_blanks)), lambda own: (own != "") & F.contains(base, own))


def is_fragment(line: Column, heading: Column) -> Column:
    """Whether a line, without leaders, is part of a heading."""
    return is_part(line, fragment_base(heading))


def is_bold(fontname: Column) -> Column:
    return F.contains(F.lower(fontname), F.lit("bold"))


def is_heading_font(bold: Column, size: Column) -> Column:
    return bold | (size >= F.lit(13.0))


def clean_item(c: Column) -> Column:
    return let(collapse(c), lambda x: F.when(F.endswith(x, F.lit(";")), F.trim(F.substring(x, F.lit(1), F.length(x) - 1))).otherwise(x))


def clean_cell(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "), r"(?Ud)\s{2,}", " "))


def unwrap(c: Column) -> Column:
    """Joins words cut by a hyphen and a blank."""
    return F.regexp_replace(c, R.HYPHEN_WRAP, "")


def topic(heading: Column) -> Column:
    """The first topic whose pattern the heading holds."""
    h, out = F.coalesce(heading, F.lit("")), F.lit(R.OTHER_TOPIC)
    for label, pattern in reversed(R.TOPICS):
        out = F.when(h.rlike(f"(?Udi){pattern}"), F.lit(label)).otherwise(out)
    return out
