import re

from purlin.llm.license_scan import BASE_PHRASES, rules, scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = [
    None,
    "",
    "no hit at all",
    "Released under the MIT License. mit\n license; MIT LICENSES mit-license",
    "GNU General Public License, version 3. Then the gnu general  public licence and GNU GENERAL PUBLIC LICENSE",
    "cc by é cc byé ccc by CC-BY 4.0 under CC BY-NC-SA 4.0",
    "x" * 40_000 + " Apache License " + "y " * 9000 + "Licensed under the Apache License, Version 2.0",
    "Kmit license İ mit license Ωmit license",
    "SPDX-License-Identifier: MPL-2.0 and https://creativecommons.org/licenses/by-sa/4.0/ all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit license mit license mit license",
]


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for i in range(len(words)):
        for phrase, label in BASE_PHRASES.items():
            p = phrase.split()
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def detections(text):
    """Brute-force spans: every rule on the whole text, then suppression, pair by pair."""
    low = (text or "").lower()
    spans = {(r["label"], m.start(), m.end(), r["priority"]) for r in rules() if r["keyword"] in low for m in re.finditer(r["pattern"], low, re.A)}

    def beaten(a):
        return any(b[1] <= a[1] and b[2] >= a[2] and (b[3] > a[3] or (b[3] == a[3] and b[2] - b[1] > a[2] - a[1]) or (b[3] == a[3] and b[1:3] == a[1:3] and b[0] < a[0])) for b in spans)

    return {a for a in spans if not beaten(a)}


def test_base_columns_and_spans(docs_of):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in scan(docs_of(rows)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert {(d.label, d.begin, d.end, d.priority) for d in r.detections} == detections(text), text
        assert r.labels == ",".join(sorted({*filter(None, r.base_labels.split(",")), *(d.label for d in r.detections)}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_specific_label_suppresses_general_one(docs_of):
    got = scan(docs_of([(1, "Licensed under the Apache License, Version 2.0"), (2, "CC BY-NC 4.0")])).collect()
    assert {r.labels for r in got} == {"apache,apache-2.0", "cc-by,cc-by-nc-4.0"}


def test_rules_are_many_and_valid():
    found = rules()
    assert len(found) > 300 and all(re.compile(r["pattern"]) for r in found)
    assert all(0 < r["confidence"] <= 1 for r in found)


def test_plan_has_no_python_and_no_shuffle(docs_of):
    plan = scan(docs_of([(1, "a")], partitions=1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(docs_of):
    assert scan(docs_of([])).collect() == []


def test_blanks_inside_keywords_lose_nothing(docs_of):
    texts = [
        "GNU  General\nPublic\tLicense, version 3",
        "under the terms of the GNU\nGeneral\r\n Public License as published by the Free\n Software  Foundation",
        "the GNU Lesser\n  General Public License",
        "GNU\nGPL v2",
        "Open\nSoftware License 3.0, European\nUnion Public Licence, Server\x0bSide Public License",
        "Permission is\nhereby granted, free of charge, to any person obtaining a copy",
        "Redistribution and\n use in source and binary forms",
        "Creative\n\nCommons Attribution 4.0 International",
        "All\trights\nreserved; free  to use",
        "https://gnu.org/copyleft/gpl.html",
    ]
    got = {r.doc_id: r for r in scan(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        # no prefilter here: every rule on the whole text
        spans = {(r["label"], m.start(), m.end(), r["priority"]) for r in rules() for m in re.finditer(r["pattern"], text.lower(), re.A)}
        left = {a for a in spans if not any(b[1] <= a[1] and b[2] >= a[2] and (b[3], b[2] - b[1]) > (a[3], a[2] - a[1]) for b in spans)}
        assert left and {(d.label, d.begin, d.end, d.priority) for d in got[i].detections} == left, text


def test_many_hits_and_repeated_rows(docs_of):
    many = "mit license and CC BY-SA 4.0 or Licensed under the Apache License, Version 2.0; " * 400
    got = scan(docs_of([(1, many), (2, "MIT License"), (2, "MIT License")])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 3 and by[1].n_base == brute(many)[1] == 1200
    assert {(d.label, d.begin, d.end, d.priority) for d in by[1].detections} == detections(many)
    assert len({r.labels for r in got if r.doc_id == 2}) == 1
