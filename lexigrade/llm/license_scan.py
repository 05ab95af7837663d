"""License scans: ordered signature rules behind a keyword gate.

A text is lower-cased in A-Z and reduced to its words, joined by single spaces,
so that every rule is a regular expression over words and every match an
interval of words. Rules are written per license as a family of spellings and
expanded by a few sentence forms to some hundreds of expressions, each with a
priority and a confidence; others are passages of the licenses' own texts and
notices. A rule runs only on texts that contain all its
keywords. Overlaps are resolved in order of priority, then length: an interval
contained in a kept one is dropped. Base phrases are never dropped.

Defined cases: a null or empty text has no words, no labels and score 0;
repeated rows are scanned each; an empty table gives no rows; other columns
play no part; a text's length is bounded by nothing but memory for that text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_mask, flat, lower_table, slices, small_batches, spans, table

#: The phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, and spellings of the name over words.
NAMES = (
    ("mit", "mit|expat"), ("apache-1.1", "apache(?: software)? (?:version )?1 1"), ("apache-2", "apache(?: software)? (?:version )?2(?: 0)?"),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd"), ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd"),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd"), ("0bsd", "0bsd|zero clause bsd"), ("isc", "isc"), ("zlib", "zlib(?: libpng)?"),
    ("unlicense", "unlicense"), ("wtfpl", "wtfpl|do what the fuck you want to public"), ("bsl-1.0", "boost software|bsl 1 0"),
    ("gpl-1", "gpl ?v?1(?: 0)?|gnu general public(?: license)? version 1"), ("gpl-2", "gpl ?v?2(?: 0)?|gnu general public(?: license)? version 2"),
    ("gpl-3", "gpl ?v?3(?: 0)?|gnu general public(?: license)? version 3"), ("lgpl-2", "lgpl ?v?2(?: 0)?|gnu library general public(?: license)? version 2"),
    ("lgpl-2.1", "lgpl ?v?2 1|gnu lesser general public(?: license)? version 2 1"), ("lgpl-3", "lgpl ?v?3(?: 0)?|gnu lesser general public(?: license)? version 3"),
    ("agpl-3", "agpl ?v?3(?: 0)?|gnu affero general public(?: license)? version 3"), ("mpl-1.1", "mpl 1 1|mozilla public(?: license)? (?:version )?1 1"),
    ("mpl-2", "mpl 2 0|mozilla public(?: license)? (?:version )?2 0"), ("epl-1", "epl 1 0|eclipse public(?: license)?(?: v| version)? 1 0"),
    ("epl-2", "epl 2 0|eclipse public(?: license)?(?: v| version)? 2 0"), ("cddl-1", "cddl 1 0|common development and distribution(?: license)?(?: version)? 1 0"),
    ("eupl-1.2", "eupl 1 2|european union public(?: licen[cs]e)?(?: v| version)? 1 2"), ("artistic-2", "artistic 2 0"), ("afl-3", "afl 3 0|academic free(?: license)? version 3 0"),
    ("osl-3", "osl 3 0|open software(?: license)? version 3 0"), ("ms-pl", "ms pl|microsoft public"), ("cpl-1", "cpl 1 0|common public(?: license)? version 1 0"),
    ("python-2", "python software foundation|psf 2 0"), ("php-3", "php 3 0?1?"), ("ruby", "ruby"), ("postgresql", "postgresql"), ("openssl", "openssl"),
    ("ncsa", "ncsa|university of illinois ncsa open source"), ("w3c", "w3c software(?: notice)?(?: and)?"), ("x11", "x11"), ("vim", "vim"),
    ("ofl-1.1", "sil open font|ofl 1 1"), ("cc0-1", "cc0(?: 1 0)?|creative commons zero"), ("odbl-1", "odbl|open database"), ("pddl-1", "pddl|public domain dedication and"),
    ("gfdl-1.3", "gfdl 1 3|gnu free documentation(?: license)? version 1 3"), ("unicode", "unicode(?: data files)?"), ("ecl-2", "ecl 2 0|educational community"),
    ("upl-1", "upl 1 0|universal permissive"), ("sspl-1", "sspl|server side public"), ("busl-1.1", "busl 1 1|business source"), ("elastic-2", "elastic(?: v?2)?"),
)

#: Sentence form, keywords besides those of the name, priority and confidence. {n} is a name.
FORMS = (
    ("spdx license identifier (?:{n})", ("spdx", "license"), 90, 1.0),
    ("licensed under (?:the )?(?:terms of (?:the )?)?(?:{n})(?: license)?", ("licensed",), 80, 0.95),
    ("(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:{n}) licen[cs]e", ("under",), 70, 0.9),
    ("(?:subject to|governed by|covered by|under) (?:the )?(?:terms of (?:the )?)?(?:{n}) licen[cs]e", ("licen",), 60, 0.85),
    ("licen[cs]e (?:is )?(?:the )?(?:{n})", ("licen",), 40, 0.7),
    ("(?:{n}) licen[cs]e", ("licen",), 30, 0.6),
)

#: The Creative Commons licenses: elements by label, expanded by versions.
CC_PARTS = (("by-nc-nd", "by nc nd"), ("by-nc-sa", "by nc sa"), ("by-nc", "by nc"), ("by-nd", "by nd"), ("by-sa", "by sa"), ("by", "by"))
CC_WORDS = (
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:s|atives)"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc", "attribution non ?commercial"),
    ("by-nd", "attribution no ?deriv(?:s|atives)"), ("by-sa", "attribution share ?alike"), ("by", "attribution"),
)
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")

_BSD = "(?:all rights reserved )?redistribution and use in source and binary forms with or without modification are permitted"
_GNU = "(?:is|are) free software you can redistribute it and or modify (?:it|them) under the terms of the gnu {n} general public licen[cs]e(?: as)? published by the free software foundation (?:either )?(?:in )?version {v}"
#: Label, passage of the license's text or notice, keywords, priority. A longer passage of a family ranks above the shorter one that it holds.
BODIES = (
    ("mit", "(?:all rights reserved )?permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?(?: the software)?(?: to deal in the software without restriction)?", ("permission is hereby granted",), 85),
    ("bsl-1.0", "(?:all rights reserved )?permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ("permission is hereby granted",), 85),
    ("bsd-4-clause", _BSD + "(?: [^ ]+){0,150}? all advertising materials mentioning features(?: [^ ]+){0,80}? endorse or promote", ("redistribution and use", "advertising materials"), 88),
    ("bsd-3-clause", _BSD + "(?: [^ ]+){0,150}? neither the names?(?: [^ ]+){0,60}? endorse or promote", ("redistribution and use", "neither the name"), 87),
    ("bsd-2-clause", _BSD, ("redistribution and use",), 85),
    ("isc", "(?:all rights reserved )?permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that", ("is hereby granted",), 86),
    ("0bsd", "(?:all rights reserved )?permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)", ("is hereby granted",), 85),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), 85),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache", "compliance"), 85),
    ("apache-2", "apache license version 2 0 january 2004", ("apache", "january"), 85),
    ("gpl-2", _GNU.replace("{n} ", "").replace("{v}", "2"), ("free software", "gnu"), 85), ("gpl-3", _GNU.replace("{n} ", "").replace("{v}", "3"), ("free software", "gnu"), 85),
    ("lgpl-2", _GNU.replace("{n}", "(?:library|lesser)").replace("{v}", "2(?! 1)"), ("free software", "gnu"), 85), ("lgpl-2.1", _GNU.replace("{n}", "lesser").replace("{v}", "2 1"), ("free software", "gnu"), 85),
    ("lgpl-3", _GNU.replace("{n}", "lesser").replace("{v}", "3"), ("free software", "gnu"), 85), ("agpl-3", _GNU.replace("{n}", "affero").replace("{v}", "3"), ("free software", "gnu"), 85),
    ("gpl-2", "gnu general public license version 2 june 1991", ("gnu", "1991"), 85), ("gpl-3", "gnu general public license version 3 29 june 2007", ("gnu", "2007"), 85),
    ("lgpl-2", "gnu library general public license version 2 june 1991", ("gnu", "1991"), 85), ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", ("gnu", "1999"), 85),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", ("gnu", "2007"), 85), ("agpl-3", "gnu affero general public license version 3 19 november 2007", ("gnu", "2007"), 85),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", ("mozilla",), 85),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", ("mozilla",), 85),
)

#: Cheap tests on the raw lower-cased text; every rule needs one of them.
GATE = ("licen", "spdx", "creative", "hereby", "redistribution", "unencumbered", "all rights reserved")
GATE_CC = re.compile(r"(?<![a-z0-9])cc0?[^a-z0-9]*(?:by|zero|1|license)")


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in order: base phrases, forms of every name, Creative Commons, texts of licenses, general notices."""
    out = [Rule(label, phrase, (phrase.split()[-2],), 1000, 1.0) for phrase, label in BASE]
    for label, names in NAMES:
        for name in re.split(r"\|(?![^(]*\))", names):  # not within parentheses
            word = re.match("[a-z0-9]+(?![?])", name)[0]
            for form, keys, priority, confidence in FORMS:
                out.append(Rule(label, form.replace("{n}", name), (*keys, word), priority, confidence))
    for label, words in CC_PARTS:
        for version in CC_VERSIONS:
            out.append(Rule(f"cc-{label}", f"cc {words} {version}", ("cc " + words,), 65, 0.95))
        out.append(Rule(f"cc-{label}", f"cc {words}", ("cc " + words,), 50 if label != "by" else 20, 0.8))
    for label, words in CC_WORDS:
        for version in CC_VERSIONS:
            out.append(Rule(f"cc-{label}", f"creative commons {words} {version}", ("creative commons",), 65, 0.95))
        out.append(Rule(f"cc-{label}", f"creative commons {words}", ("creative commons",), 50, 0.9))
    out += [Rule(label, passage, keys, priority, 0.95) for label, passage, keys, priority in BODIES]
    out.append(Rule("proprietary", "all rights reserved", ("all rights reserved",), 10, 0.5))
    return out


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    label: str
    priority: int
    confidence: float


def detect(words: str, book: list[tuple[Rule, re.Pattern]]) -> list[Found]:
    """What the rules find in words that are joined by single spaces, after suppression."""
    hits, base = [], []
    seen: dict[str, bool] = {}
    places: list[int] | None = None  # where words start
    for rule, regex in book:
        for k in rule.keywords:
            if k not in seen:
                seen[k] = k in words
        if all(seen[k] for k in rule.keywords):
            at = 0
            while m := regex.search(words, at):
                if places is None:
                    places = [0, *(x.end() for x in re.finditer(" ", words))]
                first = bisect_left(places, m.start())
                found = Found(first, first + m[0].count(" ") + 1, rule.label, rule.priority, rule.confidence)
                (base if rule.priority >= 1000 else hits).append(found)
                at = m.start() + 1 if rule.priority >= 1000 else m.end()
    hits.sort(key=lambda h: (-h.priority, h.start - h.end, h.start, h.label))
    outer = Intervals()
    for h in base:
        outer.add(h.start, h.end)
    kept = list(base)
    for h in hits:
        if not outer.holds(h.start, h.end):
            outer.add(h.start, h.end)
            kept.append(h)
    return kept


class Intervals:
    """Intervals of which none lies within another: starts and ends both ascend, so a binary search tells whether one holds another."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and self.ends[k] >= end

    def add(self, start: int, end: int) -> None:
        if self.holds(start, end):
            return
        k = bisect_left(self.starts, start)
        to = bisect_right(self.ends, end, lo=k)  # those within the new one
        self.starts[k:to] = [start]
        self.ends[k:to] = [end]


def book_of(rule_list: list[Rule]) -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(rf"(?<![^ ])(?:{r.regex})(?![^ ])")) for r in rule_list]


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_list: list[Rule] | None = None) -> DataFrame:
    """Word count, base places, labels, score and detections (``label:start:end``) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small_batches(rows)
    kind = dict(rows.dtypes)["id"]
    rule_list = rule_list or rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, lower, inside = book_of(rule_list), lower_table(), alnum_mask()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            out = []
            for at, to in slices(offsets):
                part = lower[data[offsets[at] : offsets[to]]]
                offs = offsets[at : to + 1] - offsets[at]
                starts, ends, first = spans(part, offs, inside)
                low = part.tobytes()
                for i in range(to - at):
                    text = low[offs[i] : offs[i + 1]]
                    n = int(first[i + 1] - first[i])
                    found: list[Found] = []
                    if any(g in text for g in _GATE_BYTES) or (b"cc" in text and _GATE_CC_BYTES.search(text)):
                        lo, hi = first[i], first[i + 1]
                        found = detect(" ".join(low[a:b].decode("utf-8", "replace") for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)), book)
                    out.append((n, found))
            base = [[f for f in found if f.priority >= 1000] for _, found in out]
            columns = [
                pa.array([n for n, _ in out], pa.int64()),
                pa.array([len(b) for b in base], pa.int64()),
                pa.array([min((f.start for f in b), default=None) for b in base], pa.int64()),
                pa.array([max((f.start for f in b), default=None) for b in base], pa.int64()),
                pa.array([",".join(sorted({f.label for f in b})) for b in base], pa.string()),
                pa.array([",".join(sorted({f.label for f in found})) for _, found in out], pa.string()),
                pa.array([max((f.confidence for f in found), default=0.0) for _, found in out], pa.float64()),
                pa.array([",".join(f"{f.label}:{f.start}:{f.end}" for f in sorted(found, key=lambda f: (f.start, f.end, f.label))) for _, found in out], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *(x.split()[0] for x in _FIELDS.split(", "))])

    return rows.mapInArrow(run, f"id {kind}, {_FIELDS}").withColumnRenamed("id", id_col)


_GATE_BYTES = tuple(x.encode() for x in GATE if " " not in x) + (b"reserved",)
_GATE_CC_BYTES = re.compile(GATE_CC.pattern.replace("a-z0-9", r"a-z0-9\x80-\xff").encode("latin-1"), re.S)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under all rules."""
    return scan(table(spark, sf_dir, "documents"))


def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that the contract fixes."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _facts_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w) WHERE ws[k:k + {len(phrase.split()) - 1}] = [{', '.join(repr(x) for x in phrase.split())}]" for phrase, label in BASE
    )
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), p AS ({phrases}),
a AS (SELECT doc_id, count(*) AS n, min(k) - 1 AS lo, max(k) - 1 AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN a USING (doc_id)
"""


FACTS_SQL = _facts_sql()
