"""License scans with ordered signature rules, in DataFrame operations alone.

Several hundred regexes, made from the hand-written tables below, are grouped by a keyword. A text is looked at only
if it holds a word of one of the keywords, and a group's regexes run only if the text holds the group's own, whatever
blanks stand in it. Every place a
regex matches is a detection with a span, a priority and a confidence. A detection inside the span of another is
suppressed if that one has the higher priority, or the same and a longer span; of equal spans and priorities the
label that sorts first stays. Detections are sorted by place and swept once.

Beside them the base phrases are counted word by word: words are runs of ASCII letters, digits and all characters
beyond ASCII, after A-Z are lower-cased.

All of it happens within a row: no join, no shuffle, no Python on the executors; the rules travel as one literal.

Defined results: null text counts as empty; no hit gives null positions, empty labels and score 0; repeated rows give
repeated results; an empty table gives an empty result; very long texts and very many hits are taken whole; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purlin.llm.common import quoted

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

NOT_WORD = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"  # ASCII that separates words
BEFORE, AFTER = f"(?:^|(?<=[{NOT_WORD}]))", f"(?:(?=[{NOT_WORD}])|\\z)"

# Families: label stem; keyword; how the name is written; versions (pattern, suffix); identifier.
# Names are matched in lower case; a blank stands for any run of blanks and line ends.
FAMILIES = (
    ("gpl", "general public", r"gnu general public licen[sc]e", ("1", "2", "3"), "gpl"),
    ("gpl", "gnu gpl", r"gnu gpl", ("2", "3"), "gpl"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e", ("2", "2.1", "3"), "lgpl"),
    ("lgpl", "library general", r"gnu library general public licen[sc]e", ("2",), "lgpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ("1", "3"), "agpl"),
    ("gfdl", "free documentation", r"gnu free documentation licen[sc]e", ("1.1", "1.2", "1.3"), "gfdl"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ("1.0", "1.1", "2.0"), "apache"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0"), "mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1.0", "2.0"), "epl"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", ("1.0",), "bsd-3-clause"),
    ("eupl", "european union", r"european union public licen[sc]e", ("1.0", "1.1", "1.2"), "eupl"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1.0", "1.1"), "cddl"),
    ("cpl", "common public", r"common public licen[sc]e", ("1.0",), "cpl"),
    ("cpal", "common public attribution", r"common public attribution licen[sc]e", ("1.0",), "cpal"),
    ("ipl", "ibm public", r"ibm public licen[sc]e", ("1.0",), "ipl"),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1.0", "2.0"), "artistic"),
    ("bsl", "boost", r"boost software licen[sc]e", ("1.0",), "bsl"),
    ("busl", "business source", r"business source licen[sc]e", ("1.1",), "busl"),
    ("sspl", "server side public", r"server side public licen[sc]e", ("1",), "sspl"),
    ("elastic", "elastic", r"elastic licen[sc]e", ("1.0", "2.0"), "elastic"),
    ("osl", "open software", r"open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0"), "osl"),
    ("afl", "academic free", r"academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0"), "afl"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", (), "ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", (), "ms-rl"),
    ("lppl", "latex project", r"latex project public licen[sc]e", ("1.0", "1.2", "1.3"), "lppl"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1.0", "1.1"), "ofl"),
    ("php", "php", r"php licen[sc]e", ("3.0", "3.01"), "php"),
    ("python", "python software", r"python software foundation licen[sc]e", ("2",), "psf"),
    ("zpl", "zope", r"zope public licen[sc]e", ("1.1", "2.0", "2.1"), "zpl"),
    ("w3c", "w3c", r"w3c (?:software (?:notice and )?)?licen[sc]e", (), "w3c"),
    ("odbl", "open database", r"open database licen[sc]e", ("1.0",), "odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ("1.0",), "odc-by"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", ("1.0",), "pddl"),
    ("cecill", "cecill", r"cecill(?:-[bc])?", ("1.0", "2.0", "2.1"), "cecill"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", (), "ncsa"),
    ("vim", "vim", r"vim licen[sc]e", (), "vim"),
    ("ruby", "ruby", r"ruby licen[sc]e", (), "ruby"),
    ("openssl", "openssl", r"openssl licen[sc]e", (), "openssl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", (), "postgresql"),
    ("isc", "isc", r"isc licen[sc]e", (), "isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", (), "zlib"),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",), "wtfpl"),
    ("beerware", "beer-ware", r"beer-ware licen[sc]e", (), "beerware"),
    ("mit", "mit", r"mit(?:/x11| x11)? licen[sc]e|x11 licen[sc]e \(mit\)", (), "mit"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?", (), "mit-0"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause) bsd licen[sc]e|bsd 2-clause(?: licen[sc]e)?|freebsd licen[sc]e", (), "bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e|bsd 3-clause(?: licen[sc]e)?", (), "bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause) bsd licen[sc]e|bsd 4-clause(?: licen[sc]e)?", (), "bsd-4-clause"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e", (), "bsd"),
    ("0bsd", "bsd", r"zero-clause bsd|bsd zero clause(?: licen[sc]e)?", (), "0bsd"),
    ("unlicense", "unlicense", r"the unlicense", (), "unlicense"),
    ("cc0", "cc0", r"cc0", ("1.0",), "cc0"),
    ("apsl", "apple public", r"apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0"), "apsl"),
    ("npl", "netscape", r"netscape public licen[sc]e", ("1.0", "1.1"), "npl"),
    ("qpl", "q public", r"q public licen[sc]e", ("1.0",), "qpl"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", (), "sleepycat"),
    ("ecl", "educational community", r"educational community licen[sc]e", ("1.0", "2.0"), "ecl"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", ("1.0",), "upl"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl) ?(?:licen[sc]e)?", ("1", "2"), "mulanpsl"),
    ("nasa", "nasa", r"nasa open source agreement", ("1.3",), "nasa"),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e", ("1.1", "1.5"), "rpl"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e", ("2.1",), "hippocratic"),
)
# Creative Commons: the terms after "by", and how they are written out.
CC_TERMS = {
    "by": r"attribution",
    "by-sa": r"attribution[- ]share ?-?alike",
    "by-nd": r"attribution[- ]no ?-?deriv(?:ative)?s?(?: works)?",
    "by-nc": r"attribution[- ]non ?-?commercial",
    "by-nc-sa": r"attribution[- ]non ?-?commercial[- ]share ?-?alike",
    "by-nc-nd": r"attribution[- ]non ?-?commercial[- ]no ?-?deriv(?:ative)?s?(?: works)?",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Whole clauses and notices: label, keyword, regex, priority, confidence.
CLAUSES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 60, 0.95),
    ("isc", "permission to use, copy", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", 60, 0.9),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 60, 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,120}? nor the names of its contributors", 61, 0.9),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software", 62, 0.9),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 60, 0.85),
    ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain", 62, 0.95),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation", 60, 0.95),
    ("lgpl", "free software foundation", r"under the terms of the gnu lesser general public license as published by the free software foundation", 61, 0.95),
    ("boost", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy", 61, 0.95),
    ("public-domain", "public domain", r"(?:dedicated|released|placed|is) (?:to|into|in) the public domain", 55, 0.7),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 20, 0.4),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 20, 0.3),
    ("proprietary", "proprietary", r"proprietary and confidential|proprietary licen[sc]e", 40, 0.6),
    ("source-available", "source available", r"source available licen[sc]e", 40, 0.6),
    ("commercial", "commercial licen", r"(?<!non-)(?<!non)commercial licen[sc]e", 30, 0.4),
    ("apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0", 80, 0.99),
    ("gpl", "gnu.org/", r"gnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?gpl", 70, 0.9),
    ("lgpl", "gnu.org/", r"gnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?lgpl", 71, 0.9),
    ("agpl", "gnu.org/", r"gnu\.org/(?:copyleft|licenses)/agpl", 71, 0.9),
    ("mit", "opensource.org/licenses", r"opensource\.org/licenses/mit", 80, 0.95),
    ("bsd", "opensource.org/licenses", r"opensource\.org/licenses/bsd", 80, 0.9),
    ("mpl-2.0", "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0", 80, 0.95),
    ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0", 80, 0.95),
    ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark/1\.0", 80, 0.9),
    ("free-to-use", "free to use", r"free to use(?: and (?:share|distribute))?", 10, 0.2),
)


# Runs of blanks that aren't one space; keywords are looked for in texts with one space for each.
BLANKS = r"\s{2,}|[\t\n\x0B\f\r]"
# Parts of several keywords; a text without any needs no look at those.
COMMON = ("licen", "cc", "creative", "copyright", "public", "permi", "open", "common")


def _blanks(pattern: str) -> str:
    return pattern.replace(" ", r"\s+")


def _version(v: str) -> str:
    return r",?\s+(?:version\s+|v\.?\s*)?" + v.replace(".", r"\.") + (r"(?:\.0)?" if "." not in v else "") + r"(?![\d.]*\d)"


def rules() -> list[dict]:
    """label, keyword, pattern, priority, confidence of every rule, from the most to the least specific kind."""
    out = []

    def add(label: str, keyword: str, pattern: str, priority: int, confidence: float) -> None:
        out.append({"label": label, "keyword": keyword, "pattern": rf"(?<![\w-]){pattern}(?![\w])", "priority": priority, "confidence": confidence})

    for stem, keyword, name, versions, tag in FAMILIES:
        text = f"(?:{_blanks(name)})"
        under = r"(?:licen[sc]ed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?"
        for v in versions:
            label = f"{stem}-{v if '.' in v else v + '.0'}"
            add(label, keyword, under + text + _version(v), 75, 0.97)
            add(label, keyword, text + _version(v), 65, 0.9)
            add(label, "spdx", r"spdx-license-identifier:\s*" + tag + "-" + v.replace(".", r"\.") + r"(?:\.0)?(?:-only|-or-later|\+)?", 90, 1.0)
        label = stem if stem not in BASE_PHRASES.values() else f"{stem}-any"
        add(label, keyword, under + text, 70, 0.85)
        add(label, keyword, text, 50, 0.7)
        if not versions:
            add(label, "spdx", r"spdx-license-identifier:\s*" + tag, 90, 1.0)
    for terms, words in CC_TERMS.items():
        for v in CC_VERSIONS:
            number = v.replace(".", r"\.")
            add(f"cc-{terms}-{v}", "cc", r"cc[- ]" + terms.replace("-", "[- ]") + r"[- ]v?" + number, 78, 0.97)
            add(f"cc-{terms}-{v}", "creative commons", r"creative\s+commons\s+" + _blanks(words) + r"(?:\s+(?:international|unported|generic))?\s+v?" + number, 78, 0.97)
            add(f"cc-{terms}-{v}", "creativecommons.org", r"creativecommons\.org/licenses/" + terms + "/" + number, 80, 0.99)
        if terms != "by":
            add(f"cc-{terms}", "cc", r"cc[- ]" + terms.replace("-", "[- ]"), 55, 0.8)
        add(f"cc-{terms}" if terms != "by" else "cc-by-any", "creative commons", r"creative\s+commons\s+" + _blanks(words), 55, 0.8)
    for label, keyword, pattern, priority, confidence in CLAUSES:
        add(label, keyword, _blanks(pattern), priority, confidence)
    return out


def _groups() -> list[dict]:
    by: dict[str, list[dict]] = {}
    for r in rules():
        by.setdefault(r["keyword"], []).append(r)
    return [{"keyword": k, "rules": rs} for k, rs in sorted(by.items())]


def _words(text: str) -> str:
    """SQL: how many words a string has. Each word, with what separates it, becomes one character."""
    one = f"[{NOT_WORD}]*+[^{NOT_WORD}]++[{NOT_WORD}]*+".replace("\\", "\\\\")
    some = f"[^{NOT_WORD}]".replace("\\", "\\\\")
    return f"(case when {text} rlike '{some}' then length(regexp_replace({text}, '{one}', 'x')) else 0 end)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _scanned(array: str, kind: str, zero: str, plus: str) -> str:
    """SQL: the running folds of an array of ``kind``, from ``zero`` by ``plus`` of {x} and {y}.

    Appending copies an array, so blocks of about the root of its length are folded apart and put together after that.
    """
    width = "cast(ceil(sqrt(size(v))) as int)"
    now, moved = plus.format(x="a.at", y="y"), plus.format(x="a.at", y="z")
    block = f"aggregate(slice(v, k * {width} + 1, {width}), named_struct('at', {zero}, 'out', cast(array() as array<{kind}>)), (a, y) -> named_struct('at', {now}, 'out', concat(a.out, array({now}))))"
    blocks = f"transform(sequence(0, cast(floor((size(v) - 1) / {width}) as int)), k -> {block})"
    joined = f"aggregate({blocks}, named_struct('at', {zero}, 'out', cast(array() as array<array<{kind}>>)), (a, y) -> named_struct('at', {plus.format(x='a.at', y='y.at')}, 'out', concat(a.out, array(transform(y.out, z -> {moved})))), a -> flatten(a.out))"
    return _let(array, "v", f"case when size(v) > 0 then {joined} end")


def _phrases() -> tuple[str, dict[str, str]]:
    """One regex for all base phrases, and one per phrase."""
    between = f"[{NOT_WORD}]+"
    each = {p: BEFORE + "(?i:" + between.join(p.split()) + ")" + AFTER for p in BASE_PHRASES}
    return "(?:" + "|".join(each.values()) + ")", each


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections``: what no other suppresses, as structs of label, begin, end (characters), priority, confidence,
    ordered by place.
    """
    every, each = _phrases()
    lit = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    groups = _groups()
    kind = "array<struct<keyword string, rules array<struct<label string, pattern string, priority int, confidence double>>>>"
    d = docs.select(quoted(id_col).alias("__id"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    d = d.withColumn("low", F.lower("t"))
    gate = F.lit(False)  # on words without blanks, as a keyword may hold any blanks in the text
    for keyword in dict.fromkeys(next((k for k in COMMON if k in g["keyword"]), max(g["keyword"].split(), key=len)) for g in groups):
        gate = gate | F.contains("low", F.lit(keyword))
    d = d.withColumn("n_words", F.expr(f"cast({_words('t')} as bigint)"))
    d = d.withColumn("based", F.expr("(low like '%license%' or low like '%cc%')") & F.expr(f"t rlike {lit(every)}"))
    d = d.withColumn("hits", F.expr(f"case when based then regexp_extract_all(t, {lit(every)}, 0) end"))
    d = d.withColumn("cut", F.expr(f"case when based then split(t, {lit(every)}, -1) end"))
    names = "array_compact(array(" + ", ".join(f"case when based and exists(hits, x -> x rlike {lit(each[p])}) then {lit(label)} end" for p, label in BASE_PHRASES.items()) + "))"
    d = d.withColumn("base", F.expr(f"array_sort(array_distinct({names}))"))
    d = d.withColumn("flat", F.when(gate, F.regexp_replace("low", BLANKS, " ")))
    d = d.withColumn("groups", F.when(F.col("flat").isNotNull(), F.filter(F.from_json(F.lit(json.dumps(groups)), kind), lambda g: F.contains(F.col("flat"), g["keyword"]))))
    # matches and the pieces between them give the places: running lengths of both end where a match ends
    ends = _scanned("transform(sequence(0, size(x.m) - 1), i -> length(get(x.s, i)) + length(get(x.m, i)))", "int", "0", "{x} + {y}")
    spans = f"""
        case when size(groups) > 0 then flatten(transform(
            filter(transform(flatten(transform(groups, g -> g.rules)), r -> named_struct(
                'r', r, 'm', regexp_extract_all(low, r.pattern, 0), 's', split(low, r.pattern, -1))), x -> size(x.m) > 0),
            x -> transform({ends}, (e, i) -> named_struct(
                'begin', e - length(get(x.m, i)), 'after', -e, 'weaker', -x.r.priority, 'label', x.r.label, 'doubt', -x.r.confidence))))
        end"""
    d = d.withColumn("spans", F.array_sort(F.expr(spans)))
    # A span is beaten by an earlier one in this order that ends no sooner and has no lower priority. For each priority in
    # use: the furthest end so far of spans of at least that priority.
    # (lambdas below see nothing but their variables: a column named inside one could be computed anew for every span)
    reach = _scanned("transform(b.s, x -> transform(b.l, p -> case when x.weaker <= p then -x.after else -1 end))", "array<int>", "transform(b.l, p -> -1)", "zip_with({x}, {y}, (one, two) -> greatest(one, two))")
    left = "filter(c.s, (x, i) -> i = 0 or get(get(c.r, i - 1), cast(array_position(c.l, x.weaker) - 1 as int)) < -x.after)"
    made = f"transform({left}, x -> named_struct('label', x.label, 'begin', x.begin, 'end', -x.after, 'priority', -x.weaker, 'confidence', -x.doubt))"
    swept = _let("named_struct('s', spans, 'l', array_sort(array_distinct(transform(spans, x -> x.weaker))))", "b", _let(f"named_struct('s', b.s, 'l', b.l, 'r', {reach})", "c", made))
    none = "cast(array() as array<struct<label: string, begin: int, end: int, priority: int, confidence: double>>)"
    d = d.withColumn("detections", F.expr(f"case when size(spans) > 0 then {swept} else {none} end"))
    last_len = _words("get(hits, size(hits) - 1)")
    return d.select(
        F.col("__id").alias(id_col),
        "n_words",
        F.expr("cast(case when based then size(hits) else 0 end as bigint)").alias("n_base"),
        F.expr(f"cast(case when based then {_words('get(cut, 0)')} end as bigint)").alias("first_word"),
        F.expr(f"cast(case when based then n_words - {_words('get(cut, size(cut) - 1)')} - {last_len} end as bigint)").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base, transform(detections, x -> x.label)))), ',')").alias("labels"),
        F.expr("greatest(case when based then 0.9D else 0.0D end, coalesce(array_max(transform(detections, x -> x.confidence)), 0.0D))").alias("score"),
        "detections",
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` without the detections' spans."""
    return scan(docs, id_col, text_col).drop("detections")
