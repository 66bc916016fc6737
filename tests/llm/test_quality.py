import re
from collections import Counter

from taulab.llm.quality import cleaned_documents, judge

SCHEMA = "doc_id long, text string, kept string, n_chars long"
GOOD = "The first sentence has ten plain words and an end here.\nA second one follows it with words of its own too."
TEXTS = [
    (1, GOOD),
    (2, None),
    (3, ""),
    (4, " \n\t\n"),
    (5, GOOD + "\nHome | About | News | Contact"),
    (6, GOOD + "\n" + GOOD),
    (7, "no end " * 30),
    (8, 'She said "stop there."\r\n' + GOOD + "\n\nÉté … 。"),
    (9, "a*** b%%% c### d$$$ e&&& f*** g### h$$$ i%%% j***."),
    (9, "x " * 30_000 + "."),
    (10, GOOD + "\nAll Rights Reserved."),
]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {q for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for q in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), n < 10 or 100 * len(rep) > 20 * n


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in rows], SCHEMA)


def test_base_counts_match_brute_force(spark):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge(docs(spark)).collect())
    assert got == sorted((i, *base(t)) for i, t in TEXTS)


def test_verdicts_and_cleaned_texts(spark):
    kept = {r.doc_id for r in judge(docs(spark)).collect() if r.kept}
    assert kept == {1, 5, 8, 10}
    out = {r.doc_id: r for r in cleaned_documents(docs(spark)).collect()}
    assert set(out) == kept
    assert out[5].text == GOOD and out[5].n_chars == len(GOOD) and out[10].text == GOOD
    assert out[8].text == dict(TEXTS[:8])[8] and out[8].kept == "x"


def test_empty_table(spark):
    assert judge(docs(spark).limit(0)).collect() == []
    assert cleaned_documents(docs(spark).limit(0)).collect() == []
