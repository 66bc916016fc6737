"""Line-first cleaning: rules per line, failing lines removed, then documents judged by what is left.

A line with a word fails if one of these holds (n: its words):
  punctuation   its last word doesn't end a sentence: none of ``. ! ? …`` and their wide forms, closing
                quotes and brackets aside
  navigation    at least two words are a lone ``|``, and they are a fifth of n or more
  symbols       more than 3 in 10 words' worth of ``# * $ % & | < >``
  shouting      more than 3 in 10 words end in ``!!``, or over 60 % of 20 or more A-Z, a-z are capitals
  stutter       n >= 5 and more than 3 in 10 words repeat the word before them
  boilerplate   n < 30 and it holds one of PHRASES, in any case of A-Z
A document is rejected if its lines lose over 40 % of its word characters, or by the base rules: fewer
than 10 words, or over 20 % of the words in five-word windows that the text has twice or more.

Everything is counted over whole texts, in one pass without a shuffle.

Defined cases: a null text has no words, is rejected and stays null when cleaned; lines without a
word pass and count for nothing; repeated rows get equal rows; an empty table gives an empty result; other
columns are kept by ``cleaned_documents`` and ignored by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import SPACED, byte_values, chunks, mix, window_hashes, word_bounds, word_hashes

#: Fixed list of boilerplate phrases.
PHRASES = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign up",
    "subscribe to",
    "terms of service",
    "terms of use",
)

ENDS = (".", "!", "?", "…", "。", "！", "？")
CLOSERS = ('"', "'", ")", "]", "}", "”", "’", "»")


@dataclass(frozen=True)
class QualityParams:
    least_words: int = 10
    repeat_percent: int = 20
    lost_percent: int = 40


_EXACT = byte_values(False)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ALWAYS = np.ones(256, bool)
_U = np.uint64


def _ends_with(buf: np.ndarray, at: np.ndarray, least: np.ndarray, options: tuple[str, ...]) -> np.ndarray:
    """The byte length of the option that ends just before at (0: none), not reaching below least."""
    out = np.zeros(len(at), np.int64)
    for o in options:
        b = o.encode()
        same = (at - len(b) >= least) & (out == 0)
        for k, x in enumerate(b):
            same[same] = buf[at[same] - len(b) + k] == x
        out[same] = len(b)
    return out


def _count(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[hi] - run[lo]


def measure(buf: np.ndarray, offs: np.ndarray, p: QualityParams) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(columns by document, which lines fail, lines before each document) of one piece."""
    docs = len(offs) - 1
    starts, ends, first = word_bounds(buf, offs, SPACED)
    words = word_hashes(buf, starts, ends, _EXACT)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(docs), n_words)

    # lines: cut after each newline and at each document's start
    breaks = np.flatnonzero(buf == 10)
    line_doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(breaks, offs)) + 1)
    line_before = np.searchsorted(line_doc, np.arange(docs + 1))
    # a newline that ends a document and the next one's start give the same place, so order by document
    of = np.concatenate([np.arange(docs), np.searchsorted(offs, breaks, "right") - 1])
    line_from = np.concatenate([offs[:-1], breaks + 1])[np.argsort(of, kind="stable")]
    line_to = np.empty(len(line_from), np.int64)
    line_to[:-1] = line_from[1:] - 1
    last = line_before[1:] - 1
    line_to[last] = offs[1:]
    w0, w1 = np.searchsorted(starts, line_from), np.searchsorted(starts, line_to)
    n = w1 - w0
    some = n > 0

    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[starts] += 1
    np.add.at(in_word, ends, -1)
    points = (np.cumsum(in_word[:-1]) > 0) & ((buf & 0xC0) != 0x80)
    chars = _count(points, line_from, line_to)

    tail = ends[np.maximum(w1 - 1, 0)] if len(ends) else line_to
    head = starts[np.maximum(w1 - 1, 0)] if len(ends) else line_to
    at = tail.copy()
    while (cut := _ends_with(buf, at, head, CLOSERS)).any():
        at -= cut
    fails = _ends_with(buf, at, head, ENDS) == 0
    pipe = (ends - starts == 1) & (buf[np.minimum(starts, len(buf) - 1)] == ord("|")) if len(starts) else np.zeros(0, bool)
    pipes = _count(pipe, w0, w1)
    fails |= (pipes >= 2) & (5 * pipes >= n)
    symbols = _SYMBOL[buf]
    fails |= 10 * _count(symbols, line_from, line_to) > 3 * n
    bang = (ends - starts >= 2) & (buf[np.maximum(ends - 1, 0)] == 33) & (buf[np.maximum(ends - 2, 0)] == 33) if len(starts) else np.zeros(0, bool)
    upper = _count((buf >= 65) & (buf <= 90), line_from, line_to)
    letters = upper + _count((buf >= 97) & (buf <= 122), line_from, line_to)
    fails |= (10 * _count(bang, w0, w1) > 3 * n) | ((letters >= 20) & (10 * upper > 6 * letters))
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    fails |= (n >= 5) & (10 * _count(again, np.minimum(w0 + 1, w1), w1) > 3 * n)
    low = buf.tobytes().lower()
    for phrase in PHRASES:
        b, x = phrase.encode(), -1
        while (x := low.find(b, x + 1)) >= 0:
            line = int(np.searchsorted(line_from, x, "right")) - 1
            if x + len(b) <= line_to[line] and n[line] < 30:
                fails[line] = True
    fails &= some

    def by_doc(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values)])
        return run[line_before[1:]] - run[line_before[:-1]]

    with np.errstate(over="ignore"):
        salt = mix(np.arange(1, docs + 1, dtype=_U))
        lines = mix(word_hashes(buf, line_from, line_to, _EXACT) + salt[line_doc])
        _, kept = np.unique(lines[some], return_index=True)
        n_dup = np.bincount(line_doc[some], minlength=docs) - np.bincount(line_doc[some][kept], minlength=docs)
        windows = window_hashes(words, 5)
        valid = np.flatnonzero(owner[: len(windows)] == owner[4:]) if len(windows) else np.empty(0, np.int64)
        keyed = windows[valid] ^ salt[owner[valid]]
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(valid), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[valid[twice]] += 1
    np.add.at(cover, valid[twice] + 5, -1)
    repeated = np.cumsum(cover)[:-1] > 0

    out = {
        "n_words": n_words,
        "word_chars": by_doc(chars),
        "n_symbols": _count(symbols, offs[:-1], offs[1:]),
        "n_dup_lines": n_dup,
        "n_repeat_words": _count(repeated, first[:-1], first[1:]),
        "n_failed_lines": by_doc(fails),
    }
    lost = by_doc(np.where(fails, chars, 0))
    out["base_failed"] = (n_words < p.least_words) | (100 * out["n_repeat_words"] > p.repeat_percent * n_words)
    out["kept"] = ~out["base_failed"] & (100 * lost <= p.lost_percent * out["word_chars"])
    return out, fails, line_before


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines")
_FLAGS = ("base_failed", "kept")


def judge(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for i, j, buf, offs in chunks(batch.column(1)):
                got, _, _ = measure(buf, offs, params)
                columns = [pa.array(got[c].astype(np.int64)) for c in _COLUMNS] + [pa.array(got[c]) for c in _FLAGS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", *_COLUMNS, *_FLAGS])
                at = j
            assert at == batch.num_rows

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in _COLUMNS), *(f"{c} boolean" for c in _FLAGS)])
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    return out.select("doc_id", *_COLUMNS[:5], *_FLAGS, "n_failed_lines")


def cleaned_documents(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The kept documents, with all their columns and without their failing lines."""
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [], []
            for i, j, buf, offs in chunks(batch.column(where)):
                got, fails, before = measure(buf, offs, params)
                for r in np.flatnonzero(got["kept"]):
                    kept.append(i + int(r))
                    text = buf[offs[r] : offs[r + 1]].tobytes()
                    if got["n_failed_lines"][r]:
                        bad = fails[before[r] : before[r + 1]]
                        text = b"\n".join(x for x, b in zip(text.split(b"\n"), bad, strict=True) if not b)
                    texts.append(text.decode())
            out = batch.take(pa.array(kept, pa.int64()))
            yield out.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out


_PHRASE_SQL = " OR ".join(f"contains(low, '{x}')" for x in PHRASES)
_ENDS_SQL = "[" + "".join(ENDS).replace(".", "\\.").replace("?", "\\?") + "][\"'')\\]}”’»]*[\\x20\\x09-\\x0D]*$"

#: The columns in DuckDB's SQL.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
         translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), m AS (
  SELECT *, len(ws) AS n, length(array_to_string(ws, '')) AS chars,
         len(list_filter(ws, lambda x: x = '|')) AS pipes, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS bangs,
         len(regexp_extract_all(line, '[A-Z]')) AS upper_n, len(regexp_extract_all(line, '[A-Za-z]')) AS letters,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS again
  FROM l
), f AS (
  SELECT *, (NOT regexp_matches(line, '{_ENDS_SQL}'))
         OR (pipes >= 2 AND 5 * pipes >= n) OR 10 * symbols > 3 * n OR 10 * bangs > 3 * n
         OR (letters >= 20 AND 10 * upper_n > 6 * letters) OR (n >= 5 AND 10 * again > 3 * n)
         OR (n < 30 AND ({_PHRASE_SQL})) AS fails
  FROM m
), by_line AS (
  SELECT doc_id, sum(chars) AS word_chars, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost, count(*) FILTER (fails) AS n_failed_lines
  FROM f GROUP BY doc_id
), windows AS (
  SELECT doc_id, p, array_to_string(ws[p : p + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
), twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM windows SEMI JOIN twice USING (doc_id, win)) GROUP BY doc_id
), j AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN by_line ON w.doc_id = by_line.doc_id LEFT JOIN repeats ON w.doc_id = repeats.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 40 * word_chars AS kept
FROM j
"""
