import random
import re
import time

from helpers import SCHEMA, row

from tabscope.llm import licenses
from tabscope.llm.licenses import Detection


def labels(text):
    scanner = licenses.Scanner()
    return {d.label for d in licenses.resolve(scanner.detections(text.lower()))}


def test_rules_of_all_kinds():
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0", "apache"}
    assert "cc-by-nc-4.0" in labels("Licensed under CC BY-NC 4.0.")
    assert "gpl-3" in labels("the GNU General Public License, version 3.")
    assert "cc-by-sa-3.0" in labels("https://creativecommons.org/licenses/by-sa/3.0/")
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files") == {"mit"}
    assert "mit" in labels("SPDX-License-Identifier: MIT")
    assert labels("wir gehen mit der Bahn; omit nothing; a permit") == set()
    assert len(licenses.all_rules()) > 200


#: Sentences of the licenses' own texts, one for each rule of ``TEXTS``, in order.
OFFICIAL = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided",
    "for any purpose with or without fee is hereby granted. THE SOFTWARE",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "All advertising materials mentioning features or use of this software must display",
    "Unless required by applicable law or agreed to in writing, software distributed under the License",
    "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public",
    "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "This is free and unencumbered software released into the public domain",
    "The origin of this software must not be misrepresented",
    "obtaining a copy of the software and accompanying documentation covered by this license; Permission is hereby granted, free of charge",
    "You just DO WHAT THE FUCK YOU WANT TO",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "The intent of this document is to state the conditions under which a Package may be copied",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "This LICENSE AGREEMENT is between the Python Software Foundation",
    "This license governs use of the accompanying software. If you use the software, you accept this license",
    "To the extent possible under law, the person who did this has waived all copyright",
    "proprietary and confidential", "unauthorized copying of this file", "No part of this publication may be reproduced",
    "All rights reserved", "released into the public domain", "Copyright (c) 2020", "© 2021",
)


def test_every_text_rule_on_wrapped_texts():
    scanner = licenses.Scanner()
    assert len(OFFICIAL) == len(licenses.TEXTS)
    for (label, *_), text in zip(licenses.TEXTS, OFFICIAL, strict=True):
        for start in ("", "    ", " * ", "# ", "// ", "-- "):
            for join in (f"\n{start}", f"\r\n{start}", "  "):
                lowered = f"before{join}{join.join(text.split())}{join}after".lower()
                found = [d for d in scanner.detections(lowered) if d.label == label and d.priority == licenses.TEXT]
                assert found, (label, start)
                assert lowered.startswith("before") and all(
                    lowered[d.begin : d.end].split()[0] in text.lower() and not lowered[d.end - 1].isspace() for d in found
                )


def test_names_across_hyphens_and_lines():
    assert labels("under the mit-license") == {"mit"} == labels("the MIT\nLicense") == labels("the MITLicense")
    assert "lgpl-3" in labels("GNU Lesser General Public\nLicense, version 3.")
    assert "lgpl-3" in labels(" * GNU Lesser\n * General Public\n * License, version 3.")
    assert "cc-by-nc" in labels("Creative Commons Attribution-Non-\nCommercial")


def test_contained_detections_are_suppressed():
    found = [Detection("a", 0, 10, 2), Detection("b", 2, 8, 2), Detection("c", 2, 8, 1), Detection("d", 5, 15, 4), Detection("a", 0, 10, 2)]
    assert [d.label for d in licenses.resolve(found)] == ["a", "c", "d"]


def test_suppression_against_all_pairs():
    source = random.Random(2)

    def detection(places, length):
        begin = source.randrange(places)
        return Detection(source.choice("abc"), begin, begin + source.randrange(1, length), source.randrange(5))

    for _ in range(3000):
        found = [detection(20, 9) for _ in range(source.randrange(14))]
        kept = []
        for d in sorted(found, key=lambda d: (d.priority, d.begin - d.end, d.begin, d.label)):
            if not any(k.begin <= d.begin and d.end <= k.end for k in kept):
                kept.append(d)
        assert licenses.resolve(found) == sorted(kept, key=lambda d: (d.begin, d.end))
    many, start = [detection(1_000_000, 99) for _ in range(100_000)], time.monotonic()
    assert licenses.resolve(many) and time.monotonic() - start < 20


def test_base_places(spark, docs, rows, nothing):
    texts = [
        "MIT License, mit-license! The APACHE\nlicense.", "General Public License", "general public licenses", "mit_license mit-License", None,
        "émit license", "license mit license", "GENERAL  general public license license",
    ]
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    for r in licenses.scan(df).collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        want = sorted(
            (i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase
        )
        assert r["n_words"] == len(words) and sorted((p["word"], p["label"]) for p in r["places"]) == want
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(nothing).count() == 0
