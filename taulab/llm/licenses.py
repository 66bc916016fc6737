"""License scan: an exact set-similarity join of text blocks with license templates, with DataFrame operations only.

A document meets a template of k words if some run of at most ``stretch_percent`` of k consecutive words, whatever its line
ends, holds ``percent`` of the template's words or more.  Blocks are runs of ``2 * stride`` words that begin at every ``stride``-th
word, so each such run lies in one of them.  Blocks and templates are sets of words.  Words are ordered by their number of blocks
in the whole corpus, rarest first, and:
  prefix filter     a block that meets a template of k words, needing a of them, holds one of its k - a + 1 rarest
  length filter     the block has at least a words of the templates' vocabulary
  positional filter a words can still be common from the shared word on, on both sides
Only blocks that share a prefix word with a template meet it in the join; the overlap is then counted exactly, once
for each pair (at its rarest common word), and last the runs inside the block are.  Templates are a fixed list, so what is broadcast is bounded.

Besides, the places of three phrases are counted over the words of the whole text, whatever its lines.

Defined cases: a null text is empty; without a match both label lists are empty, score is 0 and first_word and
last_word are null; repeated rows get equal rows; null ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: The phrases that always give a label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Common wordings of licenses and notices.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: What stands between words.
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LicenseParams:
    """stretch_percent: the longest run of words that may hold a template, to its length; stride: words between block starts, more where a
    template's run is longer, so that whole license texts can be templates."""

    percent: int = 90
    stretch_percent: int = 150
    stride: int = 40
    templates: tuple[tuple[str, str], ...] = TEMPLATES


def _fitted(p: LicenseParams) -> LicenseParams:
    """With a stride for which every run that may hold a template lies in one block."""
    return replace(p, stride=max(p.stride, max(_stretch(t, p) for _, t in p.templates) - 1))


def _needed(size: int, p: LicenseParams) -> int:
    return -(-size * p.percent // 100)


def _stretch(text: str, p: LicenseParams) -> int:
    return len(text.split()) * p.stretch_percent // 100


def _places(parts: list[str], label: str) -> F.Column:
    """The places in ``words`` where the parts stand one after another."""
    wanted = F.array(*map(F.lit, parts))
    every = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1))
    found = F.filter(every, lambda i: F.slice("words", i + 1, F.lit(len(parts))) == wanted)
    found = F.when(F.col("words").isNotNull(), found).otherwise(F.array().cast("array<int>"))
    return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _facts(docs: DataFrame, p: LicenseParams) -> DataFrame:
    """One pass over the texts: counts, phrase places, and for each block its words that templates use, with their places."""
    vocabulary = F.array(*(F.lit(w) for w in sorted({w for _, t in p.templates for w in t.split()})))
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(low, SIGNS, " ").alias("plain"))
    least = min(_needed(len(set(t.split())), p) for _, t in p.templates)
    every = plain.withColumn("every_word", F.array_remove(F.split("plain", " "), ""))
    every = every.withColumn("words", F.when(F.contains("plain", F.lit("license")), F.col("every_word")))
    strides = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size("every_word") - 1) / p.stride).cast("int"))
    every = every.withColumn("halves", F.transform(strides, lambda i: F.array_intersect(F.slice("every_word", i * p.stride + 1, F.lit(p.stride)), vocabulary)))
    numbered = F.transform("halves", lambda x, i: F.struct(i.alias("i"), F.array_union(x, F.coalesce(F.get("halves", i + 1), F.array().cast("array<string>"))).alias("words")))

    def marked(block: F.Column) -> F.Column:
        run = F.slice("every_word", block["i"] * p.stride + 1, F.lit(2 * p.stride))
        return F.struct(block["words"].alias("words"), F.filter(F.transform(run, lambda w, k: F.struct(w.alias("word"), k.alias("at"))), lambda x: F.array_contains(block["words"], x["word"])).alias("marks"))

    places = [_places(phrase.split(), label) for phrase, label in PHRASES]
    every = every.withColumns({"places": F.concat(*places), "blocks": F.transform(F.filter(numbered, lambda x: F.size(x["words"]) >= least), marked)})
    starts = F.transform("places", lambda x: x["at"])
    return every.select(
        "row",
        "doc_id",
        F.size("every_word").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"]))).alias("base"),
        "blocks",
    )


def _matches(blocks: DataFrame, p: LicenseParams) -> DataFrame:
    """blocks (row, words, marks) -> (row, label, containment) of all blocks that hold a run that meets a template."""
    counts = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row for each template word at most
    order = sorted({w for _, t in p.templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefix, prefix_words = [], set()
    for label, text in p.templates:
        ranks = sorted({rank[w] for w in text.split()})
        need = _needed(len(ranks), p)
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            prefix.append((r, label, ranks, sorted(set(text.split())), i, need, _stretch(text, p)))
            prefix_words.add(order[r])
    templates = blocks.sparkSession.createDataFrame(prefix, "rank int, label string, template array<int>, template_words array<string>, i int, need int, stretch int")
    ranks_of = F.create_map(*(x for w in order for x in (F.lit(w), F.lit(rank[w]))))
    near = blocks.where(F.arrays_overlap("words", F.array(*(F.lit(w) for w in sorted(prefix_words)))))
    near = near.select("row", "marks", F.array_sort(F.transform("words", lambda w: F.element_at(ranks_of, w))).alias("block"))
    probes = near.select("row", "marks", "block", F.posexplode("block").alias("j", "rank"))
    met = probes.join(F.broadcast(templates), "rank").where((F.size("block") - F.col("j") >= F.col("need")) & (F.size("template") - F.col("i") >= F.col("need")))
    common = F.array_intersect("block", "template")
    met = met.withColumn("common", common).where((F.size("common") >= F.col("need")) & (F.array_min("common") == F.col("rank")))
    met = met.withColumn("marks", F.filter("marks", lambda x: F.array_contains("template_words", x["word"])))

    def held(start: F.Column) -> F.Column:
        """How many different words of the template stand in the run that begins with this one."""
        run = F.filter("marks", lambda y: (y["at"] >= start["at"]) & (y["at"] < start["at"] + F.col("stretch")))
        return F.size(F.array_distinct(F.transform(run, lambda y: y["word"])))

    met = met.withColumn("held", F.array_max(F.transform("marks", held))).where(F.col("held") >= F.col("need"))
    return met.select("row", "label", (F.col("held") / F.size("template")).alias("containment"))


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document."""
    params = _fitted(params)
    facts = Workspace(docs.sparkSession, "licenses").save(_facts(docs, params), "facts")
    blocks = facts.select("row", F.explode("blocks").alias("block")).select("row", "block.*")
    found = _matches(blocks, params).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    every = facts.drop("blocks").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return every.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


_PHRASE_SQL = " UNION ALL ".join(
    "SELECT doc_id, p - 1 AS place, '{}' AS label FROM at_word WHERE {}".format(label, " AND ".join(f"ws[p + {k}] = '{w}'" for k, w in enumerate(phrase.split()))) for phrase, label in PHRASES
)
_TEMPLATE_SQL = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in TEMPLATES)

#: The same in DuckDB's SQL, every run that begins with a word of a template against it.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{WORD}') AS ws FROM d),
at_word AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE contains(low, 'license')),
places AS ({_PHRASE_SQL}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY doc_id
), templates AS (SELECT label, list_distinct(t) AS t, len(t) AS k FROM (VALUES {_TEMPLATE_SQL}) AS v(label, t)),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
met AS (
  SELECT doc_id, label, len(list_intersect(ws[p : p + k * 150 // 100 - 1], t)) / len(t) AS containment
  FROM starts JOIN (SELECT label, t, k, unnest(t) AS head FROM templates) AS v ON ws[p] = head
  WHERE 100 * len(list_intersect(ws[p : p + k * 150 // 100 - 1], t)) >= 90 * len(t)
), more AS (SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS best FROM met GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN more ON w.doc_id = more.doc_id
"""
