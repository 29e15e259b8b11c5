"""License scan by ordered signature rules.

A rule is a label, a keyword and a regular expression on the lower-cased text. The keywords of all rules are found
in one pass (Aho-Corasick); only rules whose keyword occurs are tried. Of the detections, one that lies inside
another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import groupby
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tabscope.llm.rows import map_rows, octets
from tabscope.llm.textbytes import LOWER, byte_array, runs

#: Base phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: Priorities: the text of a license, a tag or link, a name with version, a name, a hint. Each with its confidence.
TEXT, TAG, VERSION, NAME, HINT = range(5)
CONFIDENCE = (0.99, 0.97, 0.95, 0.85, 0.5)
#: Confidence of a base phrase alone.
BASE_CONFIDENCE = 0.8


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


#: Sentences that identify a license's own text: label, keyword, pattern.
TEXTS = (
    ("mit", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy\s+of this software and associated documentation files"),
    ("mit-0", "without restriction, including", r"without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\.\s+the software is provided"),
    ("isc", "permission to use, copy, modify", r"permission to use, copy, modify,? and/or distribute this software for any\s+purpose with or without fee is hereby granted, provided"),
    ("0bsd", "with or without fee is hereby granted", r"for any\s+purpose with or without fee is hereby granted\.\s+the software"),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms, with or without\s+modification, are permitted provided"),
    ("bsd-3-clause", "endorse or promote products", r"neither the name of .{1,120}? nor the names of its\s+contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software\s+must display"),
    ("apache", "unless required by applicable law", r"unless required by applicable law or agreed to in writing, software\s+distributed under the license"),
    ("gpl", "is free software", r"is free software[:;,] you can redistribute it and/or modify\s+it under the terms of the gnu general public license"),
    ("lgpl", "is free software", r"is free software[:;,] you can redistribute it and/or\s+modify it under the terms of the gnu (?:lesser|library) general public"),
    ("agpl", "is free software", r"is free software[:;,] you can redistribute it and/or modify\s+it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to", r"this source code form is subject to the terms of the mozilla public\s+license,? v\. ?2\.0"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", "permission is hereby granted, free of charge", r"obtaining a copy of the software and accompanying documentation covered by\s+this license"),
    ("wtfpl", "you just do what the", r"you just do what the \w+ you want to"),
    ("epl-2.0", "this program and the accompanying materials", r"accompanying materials are made\s+available under the terms of the eclipse public license 2\.0"),
    ("epl-1.0", "this program and the accompanying materials", r"accompanying materials are made\s+available under the terms of the eclipse public license v1\.0"),
    ("cddl", "common development and distribution", r"the contents of this file are subject to the terms of the common development\s+and distribution license"),
    ("artistic", "package may be copied", r"the intent of this document is to state the conditions under which a\s+package may be copied"),
    ("ofl-1.1", "this font software is licensed", r"this font software is licensed under the sil open font license,? version 1\.1"),
    ("psf", "python software foundation", r"this license agreement is between the python software foundation"),
    ("ms-pl", "this license governs use of the accompanying", r"this license governs use of the accompanying software\. if you use the\s+software, you accept this license"),
    ("cc0-1.0", "waive", r"to the extent possible under law, .{1,160}? has waived all copyright"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|document|software|material)"),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("all-rights-reserved", "all rights reserved", r"\ball rights reserved\b"),
    ("public-domain", "public domain", r"\b(?:released|dedicated|placed|is) (?:in|into|to) the public domain\b"),
    ("copyright-notice", "copyright", r"\bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d"),
    ("copyright-notice", "©", r"© ?(?:19|20)\d\d"),
)

#: Licenses by name: label, the words a text names it with, versions in use. Each gives rules for the name, the
#: name with a version, the tag of a file header and phrases of granting.
NAMED = (
    ("gpl", "gnu general public", "1 2 3"), ("lgpl", "gnu lesser general public", "2.1 3"),
    ("lgpl", "gnu library general public", "2"), ("agpl", "gnu affero general public", "1 3"),
    ("gfdl", "gnu free documentation", "1.1 1.2 1.3"), ("apache", "apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla public", "1.0 1.1 2.0"), ("epl", "eclipse public", "1.0 2.0"),
    ("eupl", "european union public", "1.0 1.1 1.2"), ("cddl", "common development and distribution", "1.0 1.1"),
    ("cpl", "common public", "1.0"), ("artistic", "artistic", "1.0 2.0"), ("afl", "academic free", "1.1 2.0 3.0"),
    ("osl", "open software", "1.0 2.0 3.0"), ("bsl", "boost software", "1.0"), ("ofl", "sil open font", "1.0 1.1"),
    ("odbl", "open database", "1.0"), ("odc-by", "open data commons attribution", "1.0"),
    ("psf", "python software foundation", "2"), ("php", "php", "3.0 3.01"), ("zpl", "zope public", "1.1 2.0 2.1"),
    ("cecill", "cecill free software", "1.0 2.0 2.1"), ("mulan", "mulan permissive software", "1 2"),
    ("ms-pl", "microsoft public", ""), ("ms-rl", "microsoft reciprocal", ""), ("mit", "mit", ""),
    ("mit", "expat", ""), ("isc", "isc", ""), ("zlib", "zlib", ""), ("bsd", "bsd", ""), ("ncsa", "ncsa open source", ""),
    ("bsd-2-clause", "simplified bsd", ""), ("bsd-2-clause", "freebsd", ""), ("bsd-3-clause", "new bsd", ""),
    ("bsd-3-clause", "modified bsd", ""), ("bsd-2-clause", "bsd 2-clause", ""), ("bsd-3-clause", "bsd 3-clause", ""),
    ("bsd-4-clause", "original bsd", ""), ("ogl", "open government", "1.0 2.0 3.0"), ("openssl", "openssl", ""),
    ("sspl", "server side public", "1"), ("busl", "business source", "1.0 1.1"), ("elastic", "elastic", "1 2.0"),
    ("unlicense", "un", ""), ("rail", "responsible ai", ""), ("free-art", "free art", "1.2 1.3"),
)

#: Creative Commons: conditions by code, and the versions in use.
CONDITIONS = {
    "by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial",
    "by-nd": "attribution-noderivatives", "by-nc-sa": "attribution-noncommercial-sharealike",
    "by-nc-nd": "attribution-noncommercial-noderivatives",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _named_rules() -> list[Rule]:
    rules = []
    for label, name, versions in NAMED:
        words = r"[\s-]+".join(map(re.escape, name.split()))
        noun = rf"\b{words}[\s-]?licen[sc]e\b"
        keyword = name.split()[-1] + " licen"
        short = label.split("-")[0]
        if name == "un":
            noun, keyword = r"\bunlicen[sc]e\b", "unlicen"
        rules.append(Rule(label, keyword, noun, NAME))
        rules.append(Rule(label, "licen", rf"\blicen[sc]ed under (?:the )?(?:terms of (?:the )?)?{words}\b", NAME))
        rules.append(Rule(label, "spdx-license-identifier", rf"spdx-license-identifier:\s*{re.escape(short)}\b", TAG))
        for version in versions.split():
            number = re.escape(version) if "." in version else rf"{version}(?:\.0)?"
            rules.append(Rule(f"{label}-{version}", keyword, rf"{noun},? ?\(?(?:version |v\.? ?){number}(?![.\d]*\d)", VERSION))
            rules.append(Rule(f"{label}-{version}", short, rf"\b{re.escape(short)}[- ]?(?:v|version )?{number}(?![.\d]*\d)", VERSION))
    return rules


def _commons_rules() -> list[Rule]:
    rules = [
        Rule("cc0", "cc0", r"\bcc0\b", NAME), Rule("cc", "creative commons", r"\bcreative commons\b", NAME),
        Rule("cc-pd", "creativecommons.org/publicdomain", r"creativecommons\.org/publicdomain/\w+", TAG),
    ]
    for code, long in CONDITIONS.items():
        spoken = long.replace("-", r"[\s-]+").replace("non", "non-?").replace("share", "share-?").replace("noder", "no-?der")
        rules.append(Rule(f"cc-{code}", "cc", rf"\bcc[ -]{code}\b(?!-)", NAME))
        rules.append(Rule(f"cc-{code}", "creative commons", rf"\bcreative commons {spoken}\b(?![\s-]+(?:non|share|no-?der))", NAME))
        for version in CC_VERSIONS:
            number = re.escape(version)
            rules.append(Rule(f"cc-{code}-{version}", "cc", rf"\bcc[ -]{code}[ -]{number}(?![.\d]*\d)", VERSION))
            rules.append(Rule(f"cc-{code}-{version}", "creative commons", rf"\bcreative commons {spoken}[, ]+(?:version )?{number}(?![.\d]*\d)", VERSION))
            rules.append(Rule(f"cc-{code}-{version}", "creativecommons.org", rf"creativecommons\.org/licen[sc]es/{code}/{number}", TAG))
    return rules


def all_rules() -> list[Rule]:
    """All rules in order: by priority, then as listed."""
    rules = [Rule(label, keyword, pattern, TEXT) for label, keyword, pattern in TEXTS]
    rules += _named_rules() + _commons_rules()
    rules += [
        Rule("license-hint", "licen", r"\b(?:licen[sc]ed|released|distributed) under\b", HINT),
        Rule("license-hint", "licen", r"\bterms of (?:the|this) licen[sc]e\b", HINT),
    ]
    return sorted(rules, key=lambda r: r.priority)


class Detection(NamedTuple):
    label: str
    begin: int
    end: int
    priority: int


def resolve(found: list[Detection]) -> list[Detection]:
    """Drop each detection whose interval lies inside one of the same or a higher priority; equal ones keep the first.

    Of the kept intervals, those that lie in no other one are held in order: their begins and ends ascend together, so
    only the last of them that begins no later than a detection may contain it.
    """
    kept: list[Detection] = []
    begins: list[int] = []
    ends: list[int] = []
    for _, level in groupby(sorted(found, key=lambda d: d.priority), lambda d: d.priority):
        widest = 0
        outer: list[Detection] = []
        for d in sorted(level, key=lambda d: (d.begin, -d.end, d.label)):
            if d.end <= widest:  # an earlier or equal begin reaches as far
                continue
            at = bisect_right(begins, d.begin) - 1
            if at < 0 or ends[at] < d.end:
                outer.append(d)
                widest = d.end
        kept += outer
        begins, ends = _maximal(sorted([*zip(begins, ends, strict=True), *((d.begin, d.end) for d in outer)], key=lambda x: (x[0], -x[1])))
    return sorted(kept, key=lambda d: (d.begin, d.end))


def _maximal(intervals: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of intervals (ordered by begin, the longest first) that lie in no other one."""
    begins, ends = [], []
    for begin, end in intervals:
        if not ends or end > ends[-1]:
            begins.append(begin)
            ends.append(end)
    return begins, ends


#: Marks of comments and quotes at the beginning of a line.
MARK = r"(?:(?:[*#;>|%!]+|/\*+|--+|dnl|rem)(?=\s)|//+!?)"
_LINE = rf"[^\S\n]*\n[^\S\n]*{MARK}?"
_GAP = re.compile(rf"(?:{_LINE})+\s*|\s\s+|[^\S ]")
#: A space of a pattern outside brackets.
_PATTERN_SPACE = re.compile(r"(\[[^\]]*\])| ")


def _gap(match: re.Match) -> str:
    """What white space becomes: nothing after a word broken at its hyphen, else a space."""
    text, at = match.string, match.start()
    broken = at > 1 and text[at - 1] == "-" and text[at - 2].isalnum() and "\n" in match.group()
    return "" if broken else " "


def folded(text: str) -> str:
    """A text with runs of white space, and marks of comments between its lines, as one space."""
    return _GAP.sub(_gap, text)


def offsets(text: str) -> np.ndarray:
    """The place in a text of each character of the folded one."""
    kept = np.ones(len(text), bool)
    for match in _GAP.finditer(text):
        kept[match.start() + len(_gap(match)) : match.end()] = False
    return np.flatnonzero(kept)


class Scanner:
    """All rules, compiled when first needed, behind one keyword automaton.

    Keywords and patterns are looked for in the folded text; a hyphen may stand for a space.
    """

    def __init__(self) -> None:
        self.rules = all_rules()
        self.compiled: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        self.by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for keyword in {rule.keyword, rule.keyword.replace(" licen", "licen")}:  # the space before it is optional
                self.by_keyword.setdefault(keyword.replace("-", " "), []).append(i)
        for keyword in self.by_keyword:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()

    def detections(self, lowered: str) -> list[Detection]:
        """All detections in a lower-cased text, unresolved."""
        plain = folded(lowered)
        keywords = {keyword for _, keyword in self.automaton.iter(plain.replace("-", " "))}
        found = []
        for i in sorted({i for k in keywords for i in self.by_keyword[k]}):
            rule = self.rules[i]
            if i not in self.compiled:
                self.compiled[i] = re.compile(_PATTERN_SPACE.sub(lambda m: m[1] or "[ -]", rule.pattern))
            found += [Detection(rule.label, m.start(), m.end(), rule.priority) for m in self.compiled[i].finditer(plain)]
        if not found or len(plain) == len(lowered):
            return found
        places = offsets(lowered)
        return [d._replace(begin=int(places[d.begin]), end=int(places[d.end - 1]) + 1) for d in found]


_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def phrase_places(lowered: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a base phrase stand one after another."""
    if b"license" not in lowered:
        return []
    words = [w.decode("utf-8", "replace") for w in _WORDS.findall(lowered)]
    places = []
    for last in (i for i, w in enumerate(words) if w == "license"):
        for phrase, label in PHRASES.items():
            first = last - len(phrase) + 1
            if first >= 0 and tuple(words[first : last + 1]) == phrase:
                places.append((first, label))
    return places


def scan(docs: DataFrame) -> DataFrame:
    """Base phrases and resolved detections of each document.

    ``doc_id, n_words, places array<struct<word, label>>, detections array<struct<label, begin, end, priority>>``;
    begin and end count code points. A null text is empty. Each row is judged alone: ties and repeated rows come
    out as they come in, other columns are ignored.
    """

    def start():
        scanner = Scanner()

        def work(doc_id: int | None, text: bytes | None) -> tuple:
            lowered = (text or b"").translate(LOWER)
            found = resolve(scanner.detections(lowered.decode("utf-8", "replace")))
            places = [{"word": w, "label": label} for w, label in phrase_places(lowered)]
            return doc_id, len(runs(_WORD[byte_array(lowered)])[0]), places, [d._asdict() for d in found]

        return work

    schema = (
        "doc_id bigint, n_words bigint, places array<struct<word: bigint, label: string>>, "
        "detections array<struct<label: string, begin: bigint, end: bigint, priority: int>>"
    )
    return map_rows(docs, ["doc_id", octets()], schema, start)
