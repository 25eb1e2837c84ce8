import re

import pytest
from text_rows import prose

from tidemark.llm import license_rules, license_scan

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = [(label, kind, word, re.compile(f" (?:{p})(?= )"))
         for label, kind, word, p in license_rules.rules()]


def brute(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    line = " " + " ".join(words) + " " if words else " "
    base = [(i, label) for phrase, label in license_rules.BASE
            for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    spans = set()
    for n, (label, kind, word, p) in enumerate(RULES):
        if word in line:
            for m in p.finditer(line):
                at = line[:m.start()].count(" ")
                spans.add((at, -(at + m.group().count(" ")), license_rules.KINDS.index(kind), n, label))
    left = [a for a in spans if not any(
        b < a and b[0] <= a[0] and b[1] <= a[1] and b[2] <= a[2] for b in spans)]
    score = max((license_rules.CONFIDENCE[license_rules.KINDS[a[2]]] for a in left), default=0.0)
    own = sorted({label for _, label in base})
    return (len(words), len(base), min((i for i, _ in base), default=None),
            max((i for i, _ in base), default=None), ",".join(own),
            ",".join(sorted(set(own) | {a[4] for a in left})), score, len(left))


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"). See CC BY-NC-SA 4.0.",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of "
    "the License, or (at your option) any later version. All rights reserved. ALL RIGHTS RESERVED",
    "SPDX-License-Identifier: MIT\n" * 3 + "copyright (c) 2019 Someone", "cc by cc by cc by",
    "permission is hereby granted, free of charge, to any person obtaining a copy of it. mit license",
    "all rights reservedé licence", "no word of it", "é all rights reserved ü",
    "GPLv2 or later; LGPL-2.1-only; agpl", "Public Domain Dedication and License, in the public domain",
    "x " * 300 + "Released under the MIT License. " * 50 + "wtfpl zlib license",
]


@pytest.fixture(scope="module")
def scanned(spark, edge_docs):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(200 + i, prose(i, 50) + " " + t + " " + prose(i + 1, 30)) for i, t in enumerate(TEXTS)]
    rows += rows[:3] + [(None, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        edge_docs.select("doc_id", "text"))
    return docs, license_scan.scan(docs).collect()


def test_against_brute_force(scanned):
    docs, got = scanned
    assert sorted(map(tuple, got), key=str) == sorted(
        ((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)


def test_labels(scanned):
    by = {r.doc_id: r for r in scanned[1]}
    assert by[100].labels == "apache-2.0,cc-by,cc-by-nc-sa-4.0" and by[100].base_labels == "cc-by"
    assert by[101].labels == "gpl,gpl-3.0-or-later,reserved" and by[101].n_base == 3
    assert by[102].labels == "copyright,mit" and by[102].score == 1.0
    assert by[103].n_base == 3 and (by[103].first_word, by[103].last_word) == (0, 4)
    assert by[106].labels == "" and by[106].score == 0.0


def test_empty(no_docs):
    assert license_scan.scan(no_docs).count() == 0


def test_rules_are_gated():
    """Every rule's match holds its keyword, and a gate word stands in it."""
    assert len(RULES) > 300
    for label, _, word, p in RULES:
        literal = " " + re.sub(r"\(\?:[^()]*\)\??|\[.\]|\?", " ", p.pattern) + " "
        assert word.split()[0].rstrip("0123456789v")[:3] in p.pattern, (label, word, literal)


def test_native_plan(scanned):
    docs, _ = scanned
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Scan")[0])
