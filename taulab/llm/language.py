"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Words are lower-cased (A-Z), marked at both ends and cut into character n-grams of lengths 1 to
``longest``, which are hashed to a fixed number of slots.  A text's value in a slot is the slot's share of all its
n-grams times the inverse document frequency.  Document frequencies are counted over all documents
that may be learned from; the weights are fitted by follow-the-regularised-leader steps
with L1 and L2 penalties on a bounded sample of them, drawn by a hash of the id: about ``most_rows`` rows and ``most_bytes`` bytes
in all, shared evenly by the languages that occur (``most_per_language`` rows at most and about ``least_per_language`` at least for
each; texts longer than ``longest_text`` bytes are not drawn); a temperature, fitted on a fifth of the
sample that the weights did not see, calibrates the probabilities.  Weights and frequencies have a fixed size, so
every text is scored whole, in one pass without a shuffle.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; so does every text if
there is nothing to learn from, which has no languages; rows with a null id are held in
and not learned from; repeated rows get equal predictions; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import ALNUM, FOLDED, chunks, mix, word_bounds, word_hashes

_U = np.uint64
_ODD = mix(np.arange(101, 133, dtype=_U)) | _U(1)
_MARK = mix(np.array([77], dtype=_U))[0]


@dataclass(frozen=True)
class LanguageParams:
    folds: int = 4
    held_out: int = 2
    longest: int = 4
    bits: int = 16
    most_per_language: int = 2500
    least_per_language: int = 16
    most_rows: int = 20_000
    most_bytes: int = 256 << 20
    longest_text: int = 1 << 20
    epochs: int = 4
    batch: int = 32
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    scale: float = 30.0


def _characters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each character of the words, with a mark before and after each; where each word begins."""
    size = ends - starts
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    data = buf[at]
    lead = (data & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    with np.errstate(over="ignore"):
        value = FOLDED[data[place]].copy()
        for k in (1, 2, 3):
            more = place + k < len(data)
            more[more] &= ~lead[place[more] + k]
            if k > 1:
                more &= before
            value[more] += FOLDED[data[place[more] + k]] * _ODD[k]
            before = more
    count = np.add.reduceat(lead, np.cumsum(size) - size, dtype=np.int64)
    first = np.cumsum(count + 2) - (count + 2)
    out = np.full(int((count + 2).sum()), _MARK, _U)
    out[np.arange(len(value)) + 1 + 2 * np.repeat(np.arange(len(count)), count)] = value
    return out, first


def _slots(characters: np.ndarray, first: np.ndarray, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of all n-grams; single marks don't count."""
    n = len(characters)
    word = np.zeros(n, np.int64)
    word[first[1:]] = 1
    word = np.cumsum(word)
    words, slots = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(n, _U)
        for k in range(p.longest):
            h = h[: n - k] + characters[k:] * _ODD[8 + k]
            same = word[: n - k] == word[k:]
            if k == 0:
                same = same & (characters != _MARK)
            keep = np.flatnonzero(same)
            words.append(word[keep])
            slots.append((mix(h[keep] + _U(k + 1)) >> _U(64 - p.bits)).astype(np.int64))
    return np.concatenate(words), np.concatenate(slots)


def _by_text(texts: pa.Array, p: LanguageParams) -> Iterator[np.ndarray]:
    """The slots of each text's n-grams."""
    for i, j, buf, offs in chunks(texts, 1 << 20):
        starts, ends, before = word_bounds(buf, offs, ALNUM)
        if not len(starts):
            yield from (np.empty(0, np.int64) for _ in range(j - i))
            continue
        word, slot = _slots(*_characters(buf, starts, ends), p)
        order = np.argsort(np.repeat(np.arange(j - i), np.diff(before))[word].astype(np.int32), kind="stable")
        edges = np.searchsorted(np.repeat(np.arange(j - i), np.diff(before))[word][order], np.arange(j - i + 1))
        slot = slot[order]
        yield from (slot[edges[k] : edges[k + 1]] for k in range(j - i))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # slots x languages: scale * idf * weight
    bias: np.ndarray
    params: LanguageParams = field(repr=False)
    temperature: float = 1.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = []
        for i, j, buf, offs in chunks(texts):
            starts, ends, before = word_bounds(buf, offs, ALNUM)
            got = np.zeros((j - i, len(self.languages)))
            if len(starts):
                _, one, of = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
                word, slot = _slots(*_characters(buf, starts[one], ends[one]), self.params)
                grams = np.bincount(word, minlength=len(one))
                count = np.concatenate([[0], np.cumsum(grams[of])])
                count = np.maximum(1, count[before[1:]] - count[before[:-1]])
                for c in range(len(self.languages)):
                    sums = np.bincount(word, weights=self.table[slot, c], minlength=len(one))[of]
                    run = np.concatenate([[0], np.cumsum(sums)])
                    got[:, c] = (run[before[1:]] - run[before[:-1]]) / count
            out.append(got + self.bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts))
        q = _softmax(self.logits(texts) / self.temperature)
        best, score = q.argmax(axis=1), q.max(axis=1)
        letters = _has_letter(texts)
        return [self.languages[b] if x else "und" for b, x in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _has_letter(texts: pa.Array) -> np.ndarray:
    out = []
    for i, j, buf, offs in chunks(texts):
        run = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
        has = run[offs[1:]] > run[offs[:-1]]
        for k in np.flatnonzero(~has):
            has[k] = any(c.isalpha() for c in buf[offs[k] : offs[k + 1]].tobytes().decode())
        out.append(has)
    return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _ftrl(rows: list[np.ndarray], idf: np.ndarray, target: np.ndarray, classes: int, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x classes) and biases."""
    size = 1 << p.bits
    z, n, w = (np.zeros((size + 1, classes), np.float32) for _ in range(3))
    value = (idf * p.scale).astype(np.float32)
    rng = np.random.default_rng(3)
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), p.batch):
            part = order[s : s + p.batch]
            doc = np.repeat(np.arange(len(part)), [len(rows[r]) for r in part])
            slot = np.concatenate([rows[r] for r in part])
            used, at = np.unique(slot, return_inverse=True)
            used = used.astype(np.int64)
            x = np.bincount(doc * (len(used) + 1) + at, minlength=len(part) * (len(used) + 1)).reshape(len(part), -1).astype(np.float32)
            x /= np.maximum(1, x.sum(axis=1, keepdims=True))
            x[:, :-1] *= value[used]
            x[:, -1] = 1  # the bias, without penalty
            used = np.append(used, size)
            q = _softmax(x @ w[used])
            q[np.arange(len(part)), target[part]] -= 1
            g = x.T @ q / len(part)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / p.alpha
            z[used] += g - sigma * w[used]
            n[used] += g * g
            l1, l2 = np.full((len(used), 1), p.l1, np.float32), np.full((len(used), 1), p.l2, np.float32)
            l1[-1] = l2[-1] = 0
            w[used] = np.where(np.abs(z[used]) <= l1, 0, -(z[used] - np.sign(z[used]) * l1) / ((p.beta + np.sqrt(n[used])) / p.alpha + l2))
    return w[:-1], w[-1]


def fit(ids: np.ndarray, texts: pa.Array, langs: np.ndarray, idf: np.ndarray, p: LanguageParams) -> LanguageModel:
    order = np.argsort(mix(ids.astype(np.int64).view(_U)), kind="stable")
    texts, langs = texts.take(pa.array(order)), langs[order]
    names = sorted(set(langs))
    target = np.searchsorted(np.array(names), langs)
    out = np.arange(len(langs)) % 5 == 4 if len(langs) >= 20 else np.ones(len(langs), bool)
    inside = np.flatnonzero(~out) if len(langs) >= 20 else np.arange(len(langs))
    small = np.uint16 if p.bits <= 16 else np.int32
    w, b = _ftrl([s.astype(small) for s in _by_text(texts.take(pa.array(inside)), p)], idf, target[inside], len(names), p)
    model = LanguageModel(names, w.astype(np.float64) * (idf * p.scale)[:, None], b.astype(np.float64), p)
    z, y = model.logits(texts.filter(pa.array(out))), target[out]
    low, high = np.log(0.02), np.log(20.0)
    loss = lambda t: -np.mean(np.log(np.maximum(1e-12, _softmax(z / np.exp(t))[np.arange(len(y)), y])))
    for _ in range(60):  # golden sections of a quasi-convex loss
        a, c = low + 0.381966 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, c) if loss(a) < loss(c) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))
    return model


def _document_frequency(texts: DataFrame, p: LanguageParams) -> tuple[np.ndarray, int]:
    """Over all given rows; a fixed number of counts for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << p.bits, np.int64), 0
        mark = np.empty(1 << p.bits, bool)
        for batch in batches:
            for slots in _by_text(batch.column(0), p):
                mark[:] = False
                mark[slots] = True
                total += mark
                rows += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["slot", "n"])

    got = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(1 << p.bits)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def _remainder(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, p: LanguageParams) -> LanguageModel:
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.where("text IS NOT NULL AND lang IS NOT NULL").where(_remainder(p.folds) != p.held_out)
    size = F.octet_length("text")
    short = usable.where(size <= p.longest_text)
    counts = short.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).collect()  # one row for each language
    empty = LanguageModel([], np.zeros((1 << p.bits, 0)), np.zeros(0), p)
    if not counts:
        return empty
    df, rows = _document_frequency(usable, p)
    idf = np.log((1 + rows) / (1 + df)) + 1
    rows_each, bytes_each = max(p.least_per_language, min(p.most_per_language, p.most_rows / len(counts))), p.most_bytes / len(counts)
    share = lambda r: min(1.0, max(p.least_per_language / r["rows"], min(rows_each / r["rows"], bytes_each / max(1, r["bytes"]))))
    chance = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(share(r)))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = short.where(draw < F.element_at(chance, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            t = pa.Table.from_batches(got)
            model = fit(t["doc_id"].to_numpy(), t["text"].cast(pa.large_string()).combine_chunks(), np.array(t["lang"].to_pylist()), idf, p)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else empty


def identify(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(_remainder(params.folds) == params.held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
