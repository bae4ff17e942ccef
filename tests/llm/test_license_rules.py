"""License rules: each finds a text that its pattern matches; the scan equals a plain version; labels of real wording."""

import random
import re
from re import _constants as K
from re import _parser as parser

import brute
from oracle import SF
from skytrace.llm.license_rules import signatures
from skytrace.llm.license_scan import BASE_SCORE, scan_licenses


def example(tree, longest):
    """A text that a pattern matches: with its optional parts and last alternatives, or without and with the first ones."""
    out = ""
    for op, arg in tree:
        if op is K.LITERAL:
            out += chr(arg)
        elif op is K.MAX_REPEAT:
            out += example(arg[2], longest) * (min(arg[1], 3) if longest else arg[0])
        elif op is K.SUBPATTERN:
            out += example(arg[3], longest)
        elif op is K.BRANCH:
            out += example(arg[1][-1 if longest else 0], longest)
        elif op is K.ASSERT_NOT:
            continue
        elif op is K.IN and arg[0][0] is K.CATEGORY:
            out += "1"
        elif op is K.NOT_LITERAL:
            out += "x"
        elif op is K.IN:
            out += chr(arg[-1 if longest else 0][1])
        else:
            raise ValueError(op)
    return out


def test_each_rule(spark):
    rows = [(k, long, r.priority, example(parser.parse(r.pattern), long)) for k, r in enumerate(signatures()) for long in (False, True)]
    for k, _, _, text in rows:
        assert re.fullmatch(signatures()[k].pattern, text)
    docs = spark.createDataFrame(rows, "rule int, longest boolean, own int, text string")
    missed = [(signatures()[r["rule"]], r["longest"]) for r in scan_licenses(docs).collect() if not any((d["start"], d["end"]) == (0, r["n_words"]) and d["priority"] >= r["own"] for d in r["detections"])]
    assert missed == []


def test_names_without_the_family_keyword(spark):
    rows = {
        "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "SPDX-License-Identifier: OFL-1.1": "ofl-1.1", "SPDX-License-Identifier: MPL-1.0": "mpl-1.0", "SPDX-License-Identifier: CC-BY-4.0": "cc-by-4.0",
        "Common Development and Distribution License 1.0": "cddl-1.0", "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0", "Creative Commons Attribution Share-Alike 4.0": "cc-by-sa-4.0",
        "Creative Commons Attribution-Non-Commercial 3.0": "cc-by-nc-3.0", "You may not use this file except in compliance with the License.": "apache-2.0",
    }
    docs = spark.createDataFrame([(v, k) for k, v in rows.items()], "expected string, text string")
    assert [r["expected"] for r in scan_licenses(docs).collect() if r["expected"] not in r["labels"]] == []


def plain(text):
    """Detections left and score, by looking at all pairs."""
    words = brute.ALNUM.findall(brute.lower(text))
    padded, found = f" {' '.join(words)} ", set()
    for r in signatures():
        for m in re.finditer(rf" {r.pattern}(?= )", padded):
            start = padded[: m.start()].count(" ")
            found.add((start, start + m[0].count(" "), r.label, r.priority, r.score))
    size = lambda x: x[1] - x[0]
    left = sorted(a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and (b[3] > a[3] or b[3] == a[3] and size(b) > size(a)) for b in found))
    base = BASE_SCORE if brute.phrases(text)[1] else 0.0
    return left, max([base, *(x[4] for x in left)])


def test_equals_plain_version(spark):
    rng = random.Random(5)
    rules = [example(parser.parse(r.pattern), long) for r in signatures() for long in (False, True)]
    texts = [" ".join(rng.choices(rules + ["and", "the", "license", "gpl", "2 0"], k=rng.randint(1, 12))) for _ in range(150)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    some = 0
    for r in scan_licenses(docs).collect():
        left, score = plain(texts[r["doc_id"]])
        some += bool(left)
        assert sorted(tuple(d) for d in r["detections"]) == left and r["score"] == score, texts[r["doc_id"]][:300]
    assert some > 150


#: Wording as it stands in public projects, with the labels that a reader would give; and wording that names no license.
LABELLED = {
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": {"apache", "apache-2.0"},
    "Released under the MIT License. Copyright (c) 2020": {"mit"},
    "This project is distributed under the terms of the GNU GPL v3 or later.": {"gpl", "gpl-3.0"},
    "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": {"gpl-2.0"},
    "SPDX-License-Identifier: MIT-0": {"mit-0"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl", "mpl-2.0"},
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"cc-by-sa-4.0"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted": {"bsd"},
    "Available under the 3-clause BSD license": {"bsd-3-clause"},
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": {"isc"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "Dual licensed: EPL-2.0; see the Eclipse Public License 2.0": {"epl-2.0"},
    "Fonts are under the SIL Open Font License, Version 1.1.": {"ofl-1.1"},
    "You can redistribute it and/or modify it under the same terms as Perl itself.": {"perl"},
    "The text is available under CC BY-SA 4.0.": {"cc-by-sa-4.0"},
    "Lizenziert mit der GNU Lesser General Public License, Version 2.1": {"gpl", "lgpl-2.1"},
    "I bought gpl 3 apples with a permit, at the limit": set(), "Er kam mit dem Zug, mit 0 Euro": set(), "the bsd system and its kernel": set(), "a driving license 2.0": set(),
    "public domain names are registered here": set(), "the apache helicopter has 2 0 mm guns": set(), "artistic freedom and licence": set(), "he works in mit labs": set(), "the eclipse of 2017 was public": set(),
}


def test_labels_of_real_wording(spark):
    docs = spark.createDataFrame([(k,) for k in LABELLED], "text string").withColumnRenamed("text", "own")
    got = {r["own"]: set(r["labels"]) for r in scan_licenses(docs.selectExpr("own", "own AS text")).collect()}
    right = sum(len(got[k] & v) for k, v in LABELLED.items())
    assert right >= 0.95 * sum(map(len, got.values())) and right >= 0.95 * sum(map(len, LABELLED.values())), {k: (got[k], v) for k, v in LABELLED.items() if got[k] != v}
