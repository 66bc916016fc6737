import zlib

import numpy as np
import pyarrow as pa

from taulab.llm.language import LanguageParams, _by_text, _ftrl, _slots, _characters, identify
from taulab.llm.textbatch import ALNUM, chunks, word_bounds

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = identify(docs).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_n_grams_match_brute_force():
    p, text = LanguageParams(), "Été a ab\U0001f600c"
    _, _, buf, offs = next(chunks(pa.array([text])))
    starts, ends, _ = word_bounds(buf, offs, ALNUM)
    word, slot = _slots(*_characters(buf, starts, ends), p)
    grams = []
    for w in text.split():
        m = ["^", *w.lower().replace("É", "É"), "$"]
        m = ["^"] + list(w[0].lower() if w[0].isascii() else w[0]) + list(w[1:]) + ["$"]
        grams.append([tuple(m[i : i + k]) for k in range(1, 5) for i in range(len(m) - k + 1) if k > 1 or 0 < i < len(m) - 1])
    assert np.bincount(word).tolist() == [len(g) for g in grams]
    assert len(set(slot.tolist())) == len({"^" if x == "$" else x for g in grams for x in [tuple("^" if c == "$" else c for c in y) for y in g]})
    assert sorted(next(_by_text(pa.array([text]), p)).tolist()) == sorted(slot.tolist())


def test_elastic_net_gives_sparse_weights():
    rng = np.random.default_rng(0)
    rows = [np.concatenate([rng.integers(0, 1000, 40), np.full(5, 2000 + k % 2)]) for k in range(200)]
    y = np.arange(200) % 2
    few, _ = _ftrl(rows, np.ones(1 << 16), y, 2, LanguageParams(l1=0.05))
    many, _ = _ftrl(rows, np.ones(1 << 16), y, 2, LanguageParams(l1=0.0))
    assert 0 < (few != 0).sum() < (many != 0).sum() and few[2000, 0] > 0 > few[2001, 0]


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "x") for i in range(80)]
    rows += [(100, None, "en", ""), (101, "", "de", ""), (102, "12 + 3 …", "en", ""), (None, "the dog", None, ""), (104, "die katze " * 20000, None, ""), (1, "the cat and the dog", "en", "")]
    out = identify(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[None][0] == "en" and got[104][0] == "de" and all(got[i][0] == ("en" if i % 2 else "de") for i in range(80))
    none = spark.createDataFrame([(1, "a", None, "")], schema)
    assert identify(none).collect()[0].lang_pred == "und" and identify(none.limit(0)).collect() == []
