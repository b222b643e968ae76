"""Body lines to sections bound to the headings of the table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regex as R
from ..functions import text as T

EVENT = "struct<seq:int,kind:string,number:string>"


def contents_index(headings: DataFrame) -> DataFrame:
    """(doc_id, nums, keys): all numbers in order; each number once, by first place, with its last text, place and depth, and all places."""
    entry = F.struct("pos", "number", "text", "level", "depth")
    per_doc = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    per_doc = per_doc.withColumn("nums", F.transform("h", lambda x: x["number"]))

    def key(last: Column, places: Column) -> Column:
        return F.struct(
            last["number"].alias("num"), T.normal_heading(last["text"]).alias("norm"), last["pos"].alias("pos"), last["depth"].alias("depth"),
            last["text"].alias("text"), last["level"].alias("level"), places.alias("places"),
        )

    def repeated(num: Column) -> Column:
        places = F.filter(F.transform("nums", lambda n, i: F.when(n == num, i)), lambda i: i.isNotNull())
        return key(F.element_at(F.filter("h", lambda x: x["number"] == num), -1), places)

    # most documents give each number once, and their headings are looked at once
    once = F.size(F.array_distinct("nums")) == F.size("nums")
    keys = F.when(once, F.transform("h", lambda x, i: key(x, F.array(i)))).otherwise(F.transform(F.array_distinct("nums"), repeated))
    return per_doc.select("doc_id", "nums", keys.alias("keys"))


def track(candidates: Column, keys: Column) -> Column:
    """Events of a document's candidate lines (seq, num, rest, font), in order; ``rest`` follows the number.

    'B' opens the section of a number that is still unused and uses it up. A line with another number but a heading's
    font opens the first unused heading whose text it starts with, or which starts with it. 'R' is a running header: a
    chapter ahead of its turn while earlier numbers are unused. Each line looks once at the headings that are still free.
    """
    state = F.struct(
        F.lit(0).alias("cur"), keys.alias("free"), F.transform(keys, lambda k: k["num"]).alias("nums"), F.array().cast(f"array<{EVENT}>").alias("events")
    )
    without = lambda a, k: F.concat(F.slice(a, F.lit(1), k - 1), F.slice(a, k + 1, F.size(a)))

    def step(acc: Column, x: Column) -> Column:
        exact = F.get(acc["free"], F.nullif(F.array_position(acc["nums"], x["num"]), F.lit(0)).cast("int") - 1)
        alike = lambda n: F.get(F.filter(acc["free"], lambda k: (k["norm"] != "") & (F.startswith(n, k["norm"]) | F.startswith(k["norm"], n))), 0)
        by_text = F.when(x["font"], T.let(T.normal_heading(x["rest"]), lambda n: F.when(F.length(n) >= 5, alike(n))))
        event = lambda kind, number: F.struct(x["seq"].alias("seq"), F.lit(kind).alias("kind"), number.alias("number"))

        def moved(hit: Column) -> Column:
            between = lambda k: F.exists(k["places"], lambda p: (p >= acc["cur"]) & (p < hit["pos"]))
            running = (hit["depth"] == 1) & (hit["pos"] > acc["cur"]) & F.exists(acc["free"], between)
            place = F.array_position(acc["nums"], hit["num"]).cast("int")
            opened = F.struct(
                (hit["pos"] + 1).alias("cur"), without(acc["free"], place).alias("free"), without(acc["nums"], place).alias("nums"),
                F.concat(acc["events"], F.array(event("B", hit["num"]))).alias("events"),
            )
            passed = F.struct(acc["cur"].alias("cur"), acc["free"].alias("free"), acc["nums"].alias("nums"), F.concat(acc["events"], F.array(event("R", F.lit(None).cast("string")))).alias("events"))
            return F.when(hit.isNull(), acc).when(running, passed).otherwise(opened)

        return T.let(F.coalesce(exact, by_text), moved)

    return F.aggregate(candidates, state, step, lambda acc: acc["events"])


def documents(body: DataFrame, headings: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, lines, pages, marks, nums, keys): a row for each document of the body, which is shuffled once.

    ``lines`` are those that may be content, normalised and numbered by ``seq`` from 1; ``marks`` the numbered bold lines
    outside contents pages. ``nums`` and ``keys`` are the headings', null without any. ``dealt`` lines lie by document
    already and are not shuffled.
    """
    page = Window.partitionBy("doc_id", "page_idx")
    rows = T.stripped(body if dealt else body.repartition("doc_id"))
    rows = rows.withColumns({"line": T.normalize_line(F.col("s")), "plain": T.normalize_line(F.col("text")), "leader": T.is_leader(F.col("text"))})
    before = T.strip_dots(F.col("line"))
    only_leaders = T.is_leader(F.col("line")) & T.let(before, lambda x: (x == "") | T.is_page_number(x))
    content = (F.col("line") != "") & ~T.is_page_number(F.col("line")) & ~only_leaders
    is_entry, font = T.may_number(F.col("line")) & F.col("line").rlike(R.BODY_ENTRY), T.is_heading_font(F.col("bold"), F.col("size"))
    num = F.when(is_entry, T.normalize_number(F.regexp_extract("line", R.BODY_ENTRY, 1)))
    rest = F.when(is_entry, T.strip(F.regexp_extract("line", R.BODY_ENTRY, 2)))
    entry = F.struct("page_idx", "line_no", F.col("line").alias("text"), font.alias("font"), num.alias("num"), rest.alias("rest"))
    bold = F.col("bold") & T.may_number(F.col("plain")) & F.col("plain").rlike(R.TABLE_ENTRY)
    mark = F.struct("page_idx", "line_no", F.regexp_extract("plain", R.TABLE_ENTRY, 1).alias("num"))
    # before the windows, in generated code: an aggregate would interpret them
    rows = rows.withColumns({"entry": F.when(content, entry), "mark": F.when(bold, mark)})
    # a body page that is a table of contents is none
    is_toc = (
        (F.count_if("leader").over(page) >= 3) | F.max((F.col("line_no") < 5) & T.is_toc_header(F.col("s"))).over(page) | (F.count_if(T.is_plain_entry(F.col("s"))).over(page) >= 3)
    )
    rows = rows.withColumn("is_toc", is_toc)
    per_doc = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_toc"), F.col("entry")))).alias("lines"),
        F.array_sort(F.collect_set("page_idx")).alias("pages"),
        F.array_sort(F.collect_list(F.when(~F.col("is_toc"), F.col("mark")))).alias("marks"),
    )
    number = lambda x, k: F.struct((k + 1).alias("seq"), *[x[c].alias(c) for c in ("text", "font", "num", "rest")])
    return per_doc.withColumn("lines", F.transform("lines", number)).join(contents_index(headings), "doc_id", "left")


def _events(docs: DataFrame) -> DataFrame:
    """Documents with headings, and the ``events`` of the lines that can open a section."""
    docs = docs.where(F.col("keys").isNotNull())
    titled = lambda x: x["font"] & (x["rest"] != "")
    able = F.filter("lines", lambda x: x["num"].isNotNull() & (titled(x) | F.array_contains("nums", x["num"])))
    candidates = F.transform(able, lambda x: F.struct(x["seq"].alias("seq"), x["num"].alias("num"), x["rest"].alias("rest"), titled(x).alias("font")))
    return docs.withColumn("events", track(candidates, F.col("keys")))


def boundaries(body: DataFrame, headings: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, seq, kind, number) over content lines: where sections open, and running headers."""
    return _events(documents(body, headings, dealt)).select("doc_id", F.explode("events").alias("e")).select("doc_id", "e.seq", "e.kind", "e.number")


def sections(body: DataFrame, headings: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, sec_pos, level, depth, number, heading, content) in the order in which sections open.

    Lines and headings meet by document only, so the body is shuffled once. A section's lines are a slice of its
    document's; the first ones that repeat parts of the heading in a heading's font are left out.
    """
    return _opened(_events(documents(body, headings, dealt)))


def sections_with(body: DataFrame, headings: DataFrame, placed: DataFrame, dealt: bool = False) -> DataFrame:
    """``sections`` with their ``tables``, in the same pass; ``placed`` (doc_id, t) holds each document's kept tables in order.

    A table goes to the section whose number is open at the end of its page.
    """
    docs = _events(documents(body, headings, dealt)).withColumn("of_page", _page_numbers()).join(placed, "doc_id", "left")
    number = lambda x: F.get(F.filter("of_page", lambda p: p["page_idx"] == x["page_idx"]), 0)["number"]
    docs = docs.withColumn("t", F.transform("t", lambda x: F.struct(number(x).alias("number"), x["caption"].alias("caption"), x["rows"].alias("rows"))))
    return _opened(docs, True)


def _opened(docs: DataFrame, tables: bool = False) -> DataFrame:
    opened = F.filter("events", lambda e: e["kind"] == "B")
    headers = F.transform(F.filter("events", lambda e: e["kind"] == "R"), lambda e: e["seq"])
    docs = docs.withColumns({"opened": opened, "headers": headers, "numbers": F.transform("keys", lambda k: k["num"])})

    def part(e: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("opened", k + 1)["seq"], F.size("lines") + 1)
        own = F.slice("lines", e["seq"] + 1, upto - e["seq"] - 1)
        fields = [k.alias("sec_pos"), F.get("keys", F.array_position("numbers", e["number"]).cast("int") - 1).alias("key"), own.alias("own")]
        if tables:
            mine = F.filter(F.coalesce("t", F.array()), lambda x: x["number"] == e["number"])
            fields.append(F.transform(mine, lambda x: F.struct(x["caption"].alias("caption"), x["rows"].alias("rows"))).alias("tables"))
        return F.struct(*fields)

    rows = docs.select("doc_id", "headers", F.explode(F.transform("opened", part)).alias("s")).select("doc_id", "headers", "s.*")
    header = lambda x: F.array_contains("headers", x["seq"])
    rows = rows.withColumn("base", T.fragment_base(F.col("key.text")))
    clear = lambda x: ~header(x) & ~(x["font"] & T.is_part(x["text"], F.col("base")))
    # lines before the first clear one are counted up; that one turns the count negative, and no later line is looked at
    count = lambda n, x: F.when(n < 0, n).when(clear(x), -n - 1).otherwise(n + 1)
    rows = rows.withColumn("first", F.aggregate("own", F.lit(0), count, lambda n: F.when(n < 0, -n).otherwise(n + 1)))
    kept = F.concat(F.filter(F.slice("own", F.lit(1), F.col("first") - 1), header), F.slice("own", F.col("first"), F.size("own")))
    rows = rows.withColumn("joined", F.array_join(F.transform(kept, lambda x: x["text"]), " "))
    found = ["doc_id", "sec_pos", "key.level", "key.depth", F.col("key.num").alias("number"), F.col("key.text").alias("heading"), T.collapse(F.col("joined")).alias("content")]
    return rows.select(*found, *(["tables"] if tables else []))


def _page_numbers() -> Column:
    """Array of (page_idx, number): the section open at the end of each page, null before the first.

    A tracker of its own: bold lines only, a blank after the number, no match by text.
    """
    keys = F.transform("keys", lambda k: k.withField("depth", T.depth(k["num"])))
    entry = lambda x, k: F.struct(k.alias("seq"), x["num"].alias("num"), F.lit("").alias("rest"), F.lit(False).alias("font"))

    def numbers(v: Column) -> Column:
        so_far = lambda p: F.filter(v["events"], lambda e: F.get(v["marks"], e["seq"])["page_idx"] <= p)
        return F.transform("pages", lambda p: F.struct(p.alias("page_idx"), F.try_element_at(so_far(p), F.lit(-1))["number"].alias("number")))

    def opened(marks: Column) -> Column:
        events = F.filter(track(F.transform(marks, entry), keys), lambda e: e["kind"] == "B")
        return F.struct(marks.alias("marks"), events.alias("events"))

    known = F.filter("marks", lambda x: F.array_contains("nums", x["num"]))
    return T.let(T.let(known, opened), numbers)


def page_sections(body: DataFrame, headings: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, page_idx, number): the section open at the end of each page, null before the first."""
    docs = documents(body, headings, dealt).select("doc_id", F.explode(_page_numbers()).alias("p"))
    return docs.select("doc_id", "p.page_idx", "p.number")


def previews(found: DataFrame, most: int = 120) -> DataFrame:
    """(doc_id, sec_pos, line, preview): display lines of sections; content is cut after ``most`` characters."""
    indent = F.repeat(F.lit(" "), F.when(F.col("depth") <= 5, 2 * (F.col("depth") - 1)).otherwise(10))
    line = F.concat(indent, F.lit("["), "level", F.lit("]  "), "number", F.lit(". "), "heading")
    cut = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("…"))).otherwise(F.col("content"))
    return found.select("doc_id", "sec_pos", line.alias("line"), F.concat(indent, F.lit("  "), cut).alias("preview"))
