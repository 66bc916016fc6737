import re

from taulab.llm.licenses import PHRASES, TEMPLATES, LicenseParams, scan

SCHEMA = "doc_id long, text string, labels string, lines int"
DOCS = [
    (1, "Intro words.\nReleased under the MIT License.\nMore of it."),
    (2, None),
    (3, ""),
    (4, "mit\nLICENSE, apache license; apache license"),
    (5, "This work is licensed under the GNU General Public License, version 3"),
    (6, "All rights, reserved"),
    (7, "licensed under the apache license version 2 or later"),
    (8, "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated documentation files"),
    (9, "filler é words " * 20000 + "\nLicensed under CC BY-NC 4.0."),
    (9, "mit licenses and amit license"),
    (None, "All rights reserved. All rights reserved."),
    (10, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    (11, "x " * 61 + "Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that"),
    (12, "x " * 79 + "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0." + " y" * 50),
    (13, "all of it " + "z " * 9 + "rights " + "z " * 9 + "reserved"),
    (14, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)"),
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def brute(i, text, p):
    w = words(text or "")
    places = [(k, label) for phrase, label in PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    got, best = set(base), 1.0 if places else 0.0
    for label, t in p.templates:
        s, run = set(t.split()), len(t.split()) * 3 // 2
        n = max((len(s & set(w[k : k + run])) for k in range(len(w)) if w[k] in s), default=0)
        if 100 * n >= p.percent * len(s):
            got.add(label)
            best = max(best, n / len(s))
    at = [k for k, _ in places]
    return i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(got)), best


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in DOCS], SCHEMA)
    for p in (LicenseParams(), LicenseParams(percent=60)):
        assert sorted(map(tuple, scan(docs, p).collect()), key=str) == sorted((brute(i, t, p) for i, t in DOCS), key=str)


def test_whole_license_texts_as_templates(spark):
    whole = " ".join(f"clause{k % 60} of the text{k % 7}" for k in range(50))
    p = LicenseParams(templates=(*TEMPLATES, ("house", whole)))
    parts = whole.split()
    texts = ["x " * n + whole for n in (0, 39, 151, 298, 299, 300)]
    texts += [" ".join(w for k, w in enumerate(parts) if k % 4 or k > n) for n in (8, 60, 140)]
    texts += [" ".join(w + " y" * (k % n == 0) for k, w in enumerate(parts)) for n in (1, 2, 3)]
    texts += [whole + "\n" + whole, " ".join(parts[:100]), t := "Released under the MIT License. " + whole.upper(), t]
    rows = [(i, t, "x", 0) for i, t in [*enumerate(texts), *((100 + k, t) for k, (_, t) in enumerate(DOCS))]]
    got = scan(spark.createDataFrame(rows, SCHEMA), p).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(i, t, p) for i, t, _, _ in rows), key=str)
    assert sum("house" in r.labels for r in got) in range(8, len(texts))


def test_notices_over_several_lines(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in DOCS], SCHEMA)
    got = {r.doc_id: r.labels for r in scan(docs).collect()}
    assert (got[10], got[11], got[12], got[13], got[14]) == ("bsd", "isc", "mpl", "", "mit")


def test_an_empty_table_and_one_without_matches(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in DOCS], SCHEMA)
    assert scan(docs.limit(0)).collect() == []
    row = scan(spark.createDataFrame([(1, "plain words", "x", 0)], SCHEMA)).first()
    assert (row.labels, row.score, row.first_word) == ("", 0.0, None)


def test_templates_are_plain_words():
    assert all(words(t) == t.split() for _, t in TEMPLATES)
