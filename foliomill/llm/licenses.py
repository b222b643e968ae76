"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes a line of lower-case words. Each rule is a regex over that line with a label, a priority and keywords
that all of its matches hold. Rules whose keywords are absent are never run; a text that can hold no match of any rule is
never turned into words at all. Matches become intervals; one that lies within another of the same or a higher priority is suppressed. Everything happens
within a row (higher-order functions over arrays): no shuffle, no join, no Python on the executors.

The rules are generated: every licence family is crossed with the ways in which texts name a licence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import let

from . import common

#: Words, where A-Z count as a-z: ASCII digits and letters, and all characters beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Marks around a match, and detections that are resolved together.
FROM, UPTO, TOGETHER = "\x01", "\x02", 256

#: Base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Families: label, regex of the name over lower-case words, versions (a version "3.0" reads "3" or "3 0" as words).
FAMILIES = [
    ("gpl", "(?:gnu )?general public licen[cs]e|gnu gpl|gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "(?:gnu )?affero general public licen[cs]e|(?:gnu )?agpl", ("1.0", "3.0")),
    ("gfdl", "gnu free documentation licen[cs]e|gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache(?: software)? licen[cs]e|apache", ("1.0", "1.1", "2.0")),
    ("mit", "mit(?: x11| expat)?", ()),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause", ()),
    ("bsd-3-clause", "(?:new|revised|modified|3 clause|three clause) bsd|bsd 3 clause", ()),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd|bsd 4 clause", ()),
    ("bsd", "bsd", ()),
    ("isc", "isc", ()),
    ("mpl", "mozilla public licen[cs]e|mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public licen[cs]e|epl", ("1.0", "2.0")),
    ("cddl", "common development and distribution licen[cs]e|cddl", ("1.0", "1.1")),
    ("cpl", "common public licen[cs]e", ("1.0",)),
    ("eupl", "european union public licen[cs]e|eupl", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic licen[cs]e|artistic", ("1.0", "2.0")),
    ("zlib", "zlib(?: libpng)?", ()),
    ("bsl", "boost software licen[cs]e", ("1.0",)),
    ("busl", "business source licen[cs]e|busl", ("1.1",)),
    ("sspl", "server side public licen[cs]e|sspl", ("1.0",)),
    ("ofl", "sil open font licen[cs]e|open font licen[cs]e", ("1.0", "1.1")),
    ("odbl", "open database licen[cs]e|odbl", ("1.0",)),
    ("odc-by", "open data commons attribution licen[cs]e|odc by", ("1.0",)),
    ("pddl", "public domain dedication and licen[cs]e|pddl", ("1.0",)),
    ("psf", "python software foundation licen[cs]e|psf licen[cs]e", ("2.0",)),
    ("php", "php licen[cs]e", ("3.0", "3.01")),
    ("ruby", "ruby licen[cs]e", ()),
    ("wtfpl", "wtfpl", ("1.0", "2.0")),
    ("unlicense", "unlicen[cs]e", ()),
    ("ms-pl", "microsoft public licen[cs]e|ms pl", ()),
    ("ms-rl", "microsoft reciprocal licen[cs]e|ms rl", ()),
    ("osl", "open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free licen[cs]e", ("1.1", "2.0", "2.1", "3.0")),
    ("qpl", "q public licen[cs]e|qt public licen[cs]e", ("1.0",)),
    ("ncsa", "university of illinois ncsa open source licen[cs]e|ncsa", ()),
    ("upl", "universal permissive licen[cs]e", ("1.0",)),
    ("cecill", "cecill", ("1.0", "2.0", "2.1")),
    ("mulan-psl", "mulan(?: permissive software licen[cs]e| psl)", ("1.0", "2.0")),
    ("openrail", "openrail(?: m)?|responsible ai licen[cs]e", ()),
]
#: Creative Commons: elements as in the short names, each with every version.
CC_ELEMENTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}

# Priorities: an identifier or an exact version, then a named licence, then a licence only hinted at.
EXACT, NAMED, HINT = 3, 2, 1
CONFIDENCE = {EXACT: 1.0, NAMED: 0.8, HINT: 0.4, 0: 0.0}

_LICENSED = "(?:licen[cs]ed|released|distributed|published|available|provided)(?: \\w+){0,2} under(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)?"


def _version(v: str) -> str:
    head, *tail = v.split(".")
    rest = " ?".join(tail)
    number = f"{head}(?: ?{rest})?" if rest.strip("0") == "" else f"{head} ?{rest}"
    return f"(?: version| v| ver)? ?v?{number}"


def _needs(regex: str) -> tuple[str, ...]:
    """For each alternative of ``regex`` the longest words that all of its matches hold; a space ahead where they start a match."""
    alternatives, depth = [""], 0
    for c in regex:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            alternatives.append("")
        else:
            alternatives[-1] += c
    out = []
    for x in alternatives:
        x = " " + x.removeprefix("(?:gnu )?")
        while "(" in x:  # innermost groups first
            x = re.sub(r"\([^()]*\)", "\0", x)
        out.append(max(re.split("\0+", re.sub(r"\[[^]]*\]|.\?", "\0", x)), key=len))
    return tuple(dict.fromkeys(out))


def rules() -> list[tuple[str, str, int, tuple[tuple[str, ...], ...]]]:
    """(label, regex, priority, keywords) of all rules; every match holds one keyword at least of each group of keywords.

    The first group is the one that ``GATE`` is made of.
    """
    out: list[tuple[str, str, int, tuple[tuple[str, ...], ...]]] = []
    for label, name, versions in FAMILIES:
        spoken, named = label.replace("-", " "), _needs(name)
        for v in versions:
            out.append((f"{label}-{v}", f"(?:{name})(?: licen[cs]e)?{_version(v)}(?: or (?:any )?later)?", EXACT, (named,)))
            out.append((f"{label}-{v}", f"spdx licen[cs]e identifier {spoken} {v.replace('.', ' ')}(?: only| or later)?", EXACT, ((" spdx licen",), (f" {spoken}",))))
        out.append((label, f"spdx licen[cs]e identifier {spoken}", NAMED if versions else EXACT, ((" spdx licen",), (f" {spoken}",))))
        out.append((label, f"(?:{name})(?: style)?(?: open source)? licen[cs]es?", NAMED, ((" licen",), named)))
        out.append((label, f"{_LICENSED} (?:{name})", NAMED, ((" under",), named)))
        out.append((label, f"licen[cs]e (?:{name})", HINT, ((" licen",), named)))
    own = [(x, x, HINT) for x in ("wtfpl", "unlicense", "cecill")]
    for short in ("gpl", "lgpl", "agpl"):
        for v in ("2", "3"):
            own.append((f"{short}-{v}.0", f"(?:gnu )?{short} ?v?{v}(?: 0)?", EXACT))
        own.append((short, f"gnu {short}", NAMED))
    for elements in CC_ELEMENTS:
        label = "cc-" + elements.replace(" ", "-")
        long = "creative commons " + " ".join(CC_WORDS[e] for e in elements.split())
        for v in CC_VERSIONS:
            number = v.replace(".", " ?").replace(" ?0", "(?: 0)?")
            own.append((f"{label}-{v}", f"cc {elements} {number}", EXACT))
            own.append((f"{label}-{v}", f"{long}(?: licen[cs]e)? {number}", EXACT))
            own.append((f"{label}-{v}", f"creativecommons org licen[cs]es {elements} {v.replace('.', ' ')}", EXACT))
        own.append((label, f"cc {elements}", NAMED))
        own.append((label, long, NAMED))
    own += [
        ("cc0-1.0", "cc0(?: 1 0)?|cc zero(?: 1 0)?|creative commons zero", EXACT),
        ("cc", "creative commons(?: licen[cs]es?)?", HINT),
        ("public-domain", "(?:in|into|to) the public domain|public domain(?: dedication| mark)", NAMED),
        ("all-rights-reserved", "all rights reserved", NAMED),
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy", NAMED),
        ("isc", "permission to use copy modify and or distribute this software for any purpose", NAMED),
        ("bsd", "redistribution and use in source and binary forms", NAMED),
        ("proprietary", "proprietary and confidential|proprietary licen[cs]e", NAMED),
        ("copyleft", "copyleft", HINT),
    ]
    out += [(a, b, c, (_needs(b),)) for a, b, c in own]
    return [(a, f"(?<= )(?:{b})(?= )", c, d) for a, b, c, d in out]


def _gate() -> str:
    """A regex that finds something in every text whose line holds a match of a rule or a base phrase."""
    keys = {k for *_, groups in rules() for k in groups[0]} | {f" {x}" for x in BASE}
    keys = sorted(k for k in keys if not any(x != k and x in k for x in keys) and k != " under")
    # whatever starts a word is told by what stands before it; the words that lead to "under" are those of _LICENSED
    start = [k[1:].replace(" ", _GAP) for k in keys if k[0] == " "]
    start.append(f"(?:released|distributed|published|available|provided){_GAP}(?:{WORD}{_GAP}){{0,2}}under")
    inside = [k.replace(" ", _GAP) for k in keys if k[0] != " "]
    return "(?i)" + "|".join([f"(?<!{WORD.removesuffix('+')})(?:{'|'.join(start)})", *inside])


#: A text in which this finds nothing holds no base phrase and no match of a rule.
GATE = _gate()


def _spans(line: Column, rule: Column) -> Column:
    """Intervals (first and last word, from 0) of all matches of a rule in a line; matches begin and end with words.

    Each match is put between two marks that no word holds, and the words that carry marks are counted off.
    """
    at = lambda words, mark: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i - 1)), lambda i: i.isNotNull())
    marked = F.split(F.regexp_replace(line, rule["regex"], F.lit(f"{FROM}$0{UPTO}")), " ", -1)
    # sorts by start, then longest, then highest priority
    entry = lambda s, e: F.struct(s.alias("s"), (-e).alias("ne"), (-rule["priority"]).alias("np"), rule["label"].alias("label"))
    return let(marked, lambda words: F.zip_with(at(words, FROM), at(words, UPTO), entry))


def _suppressed(found: Column) -> Column:
    """What stays of sorted detections: an earlier one of the same or a higher priority that reaches as far suppresses a later one.

    Lists only grow within blocks, and blocks within the text, so that the time stays in proportion to the detections.
    """
    span = "array<struct<label:string,start:int,end:int,priority:int>>"
    marks = ("m1", "m2", "m3")

    def resolve(acc: Column, x: Column) -> Column:
        end, priority = -x["ne"], -x["np"]
        covered = F.when(priority == 3, acc["m3"]).when(priority == 2, acc["m2"]).otherwise(acc["m1"]) >= end
        mine = F.struct(x["label"].alias("label"), x["s"].alias("start"), end.alias("end"), priority.alias("priority"))
        reach = [F.when(priority >= p, F.greatest(acc[m], end)).otherwise(acc[m]).alias(m) for p, m in enumerate(marks, 1)]
        return F.struct(*reach, F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(mine))).alias("kept"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(*[acc[m].alias(m) for m in marks], F.array().cast(span).alias("kept"))
        done = lambda x: F.struct(*[x[m].alias(m) for m in marks], F.concat(acc["kept"], F.array(x["kept"])).alias("kept"))
        return let(F.aggregate(part, start, resolve), done)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / TOGETHER).cast("int")), lambda k: F.slice(found, k * TOGETHER + 1, F.lit(TOGETHER)))
    start = F.struct(*[F.lit(-1).alias(m) for m in marks], F.array().cast(f"array<{span}>").alias("kept"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(parts, start, block, lambda acc: acc["kept"]))).otherwise(F.array().cast(span))


def scan(docs: DataFrame, prefilter: bool = True) -> DataFrame:
    """Adds to every row: ``n_words``, ``places`` (start word and label of each base phrase), ``detections`` (label,
    first and last word, priority; after suppression), ``base_labels``, ``labels``, ``score``.

    ``score`` is the confidence of the best detection (1 exact version or identifier, 0.8 named, 0.4 hinted, 0 none).
    Null and empty texts: no words, no labels, score 0. Rows are independent: repeated rows get equal results, an empty
    table stays empty, columns of ``docs`` with the names of result columns are replaced. ``prefilter`` only saves time:
    without it every rule runs on every text, with equal results.
    """
    made = ("n_words", "places", "detections", "base_labels", "labels", "score")
    rows = docs.drop(*made)
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(WORD), F.lit(0))
    rows = rows.withColumn("n_words", F.regexp_count(text, F.lit(WORD)).cast("long"))
    rows = rows.withColumn("_words", F.when(text.rlike(GATE), words) if prefilter else words)

    def place(w: Column, i: Column) -> Column:
        out = None
        for phrase, label in BASE.items():
            first, *rest = phrase.split()
            hit = w == first
            for k, x in enumerate(rest, 1):
                hit = hit & (F.get(F.col("_words"), i + k) == x)
            here = F.struct(i.cast("long").alias("word"), F.lit(label).alias("label"))
            out = F.when(hit, here) if out is None else out.when(hit, here)
        return out

    places = F.filter(F.transform(F.col("_words"), place), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<word:bigint,label:string>>")
    rows = rows.withColumn("places", F.coalesce(places, none))
    rows = rows.withColumn("_line", F.when(F.size("_words") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))
    table = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("regex"), F.lit(c).alias("priority"), F.array(*[F.array(*map(F.lit, g)) for g in d]).alias("keywords")) for a, b, c, d in rules()])
    line = F.col("_line")
    active = F.filter(table, lambda r: F.forall(r["keywords"], lambda g: F.exists(g, lambda k: F.contains(line, k)))) if prefilter else table
    none_found = F.array().cast("array<struct<s:int,ne:int,np:int,label:string>>")
    found = F.when(line.isNotNull(), F.array_sort(F.flatten(F.transform(active, lambda r: _spans(line, r))))).otherwise(none_found)
    rows = rows.withColumn("_found", found)

    kept = _suppressed(F.col("_found"))
    rows = rows.withColumn("detections", kept)
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"]))))
    best = F.greatest(
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)),
        F.when(F.size("places") > 0, F.lit(NAMED)).otherwise(F.lit(0)),
    )
    score = F.lit(0.0)
    for p in (HINT, NAMED, EXACT):
        score = F.when(best == p, F.lit(CONFIDENCE[p])).otherwise(score)
    return rows.withColumns({"base_labels": base, "labels": every, "score": score}).drop("_words", "_line", "_found")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
