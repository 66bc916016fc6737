"""Toxicity by class-conditional Kneser-Ney models of the characters in words.

Toxic and ordinary texts each have a model of the next byte of a word after up to ``order``
bytes before it (the word's start counts as one).  Both back off to one shared interpolated Kneser-Ney
model that is counted over the two classes together, so rare expressions, which neither class has
seen often, say almost nothing:

    P_c(x | h) = (max(n_c(hx) - d, 0) + (strength + d * kinds_c(h)) * P_shared(x | h)) / (strength + n_c(h))

A word's evidence is the difference of its two log-likelihoods, moved towards 0 by a margin: below the margin
both models take the word to be from the shared one, which keeps mere language and topic out.  A text's
evidence is the sum over its words divided by its length.  The margin (of a few) and the logistic curve that
turns the root of the evidence into a score are fitted on rows that the models did not count.

The models are fitted in one task on a bounded sample of labelled rows (``most_toxic`` and
``most_ordinary``, drawn by a hash of the id, and of each class no more than ``most_bytes`` bytes in that order), and have a size bounded by that sample; every row is scored,
over its whole text.  Labels, language, source and id are no inputs of a score.

Defined cases: a text that is null or has no words has evidence 0; rows with a null id are held in
and scored, and repeated rows get equal scores; of several texts of a labelled id the one with the smallest SHA-256 is learned from; labels that are null, or of ids with two different labels,
are not learned from; without rows of both classes to learn from every score is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbatch import ALNUM, FOLDED, chunks, mix, word_bounds, word_hashes

_U = np.uint64
_START, _END = 0, 1  # bytes that no word has


@dataclass(frozen=True)
class ToxicityParams:
    folds: int = 5
    order: int = 5
    discount: float = 0.75
    strength: float = 40.0
    margins: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0)
    most_toxic: int = 4000
    most_ordinary: int = 8000
    most_bytes: int = 128 << 20


def _lay_out(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each with a start and an end symbol, in lower case; where each begins."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), _END, np.uint8)
    out[first] = _START
    at = np.arange(len(out)) - np.repeat(first, size)
    inside = (at > 0) & (at < np.repeat(size, size) - 1)
    out[inside] = buf[np.repeat(starts, size)[inside] + at[inside] - 1]
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out, first


_ODD = mix(np.arange(31, 63, dtype=_U)) | _U(1)


def _contexts(symbols: np.ndarray, first: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, hash) of the context of each place: up to order symbols of its word before it."""
    word = np.searchsorted(first, place, "right") - 1
    length = np.minimum(place - first[word], order)
    return length, _hash_back(symbols, place, length)


def _hash_back(symbols: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (length + 1).astype(_U) * _ODD[0]
        for k in range(1, int(length.max(initial=0)) + 1):
            has = length >= k
            h[has] += FOLDED[symbols[place[has] - k]] * _ODD[k]
        return mix(h)


def _with(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context + FOLDED[symbol] * _ODD[30])


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row, the sums of the values over the rows with its key."""
    _, of = np.unique(keys, return_inverse=True)
    return tuple(np.bincount(of, weights=v)[of] for v in values)


@dataclass
class KneserNeyPair:
    """Evidence by (context, symbol), by context alone for symbols it never had, and the logistic curve."""

    pairs: np.ndarray
    pair_evidence: np.ndarray
    contexts: np.ndarray
    context_evidence: np.ndarray
    order: int
    margin: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def of_words(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The evidence of each word that was laid out."""
        place = np.ones(len(symbols), bool)
        place[first] = False
        place = np.flatnonzero(place)
        _, context = _contexts(symbols, first, place, self.order)
        pair = _with(context, symbols[place])
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        out = self.pair_evidence[at]
        miss = np.flatnonzero(self.pairs[at] != pair)
        at = np.minimum(np.searchsorted(self.contexts, context[miss]), len(self.contexts) - 1)
        out[miss] = np.where(self.contexts[at] == context[miss], self.context_evidence[at], np.float32(0))
        size = np.diff(np.append(first, len(symbols))) - 1
        return np.add.reduceat(out.astype(np.float64), np.cumsum(size) - size)

    def evidence(self, texts: pa.Array, margins: tuple[float, ...]) -> np.ndarray:
        """For each margin a row: the evidence of each text over its length in symbols."""
        out = []
        for i, j, buf, offs in chunks(texts):
            starts, ends, before = word_bounds(buf, offs, ALNUM)
            if not len(starts):
                out.append(np.zeros((len(margins), j - i)))
                continue
            _, one, of = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
            words = self.of_words(*_lay_out(buf, starts[one], ends[one]))
            length = np.concatenate([[0], np.cumsum(ends - starts + 1)])
            rows = []
            for m in margins:
                total = np.concatenate([[0], np.cumsum((np.sign(words) * np.maximum(np.abs(words) - m, 0))[of])])
                rows.append((total[before[1:]] - total[before[:-1]]) / np.maximum(1, length[before[1:]] - length[before[:-1]]))
            out.append(np.stack(rows))
        return np.concatenate(out, axis=1) if out else np.zeros((len(margins), 0))

    def score(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.slope * _root(self.evidence(texts, (self.margin,))[0]) + self.offset)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _root(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.sqrt(np.abs(x))


def fit_pair(texts: pa.Array, toxic: np.ndarray, p: ToxicityParams) -> KneserNeyPair:
    """The two models of the rows given."""
    kept: list[tuple[np.ndarray, ...]] = []
    for i, j, buf, offs in chunks(texts):
        starts, ends, before = word_bounds(buf, offs, ALNUM)
        if not len(starts):
            continue
        label = np.repeat(toxic[i:j], np.diff(before))
        _, one, of = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        symbols, first = _lay_out(buf, starts[one], ends[one])
        place = np.ones(len(symbols), bool)
        place[first] = False
        place = np.flatnonzero(place)
        length, context = _contexts(symbols, first, place, p.order)
        word = np.searchsorted(first, place, "right") - 1
        counts = [np.bincount(of, weights=label == c, minlength=len(one))[word] for c in (1, 0)]
        pair, at, inverse = np.unique(_with(context, symbols[place]), return_index=True, return_inverse=True)
        # contexts and pairs of each shorter length, the nearest symbols first
        chain = []
        for k in range(p.order + 1):
            short = _hash_back(symbols, place[at], np.minimum(length[at], k))
            chain += [short, _with(short, symbols[place[at]])]
        kept.append((pair, *(np.bincount(inverse, weights=c) for c in counts), length[at], *chain))
    every = [np.concatenate(x) for x in zip(*kept, strict=True)]
    pair, at, inverse = np.unique(every[0], return_index=True, return_inverse=True)
    n = [np.bincount(inverse, weights=every[c]) for c in (1, 2)]
    length, chain = every[3][at], [x[at] for x in every[4:]]

    shared = np.full(len(pair), 1 / 256)
    for k in range(p.order + 1):
        context, joint = chain[2 * k], chain[2 * k + 1]
        for rows, whole in ((np.flatnonzero(length > k), False), (np.flatnonzero(length == k), True)):
            if not len(rows):
                continue
            if whole:
                here, weight = rows, (n[0] + n[1])[rows]
            else:  # continuation counts: how many longer contexts the pair has
                here = rows[np.unique(chain[2 * k + 3][rows], return_index=True)[1]]
                weight = np.ones(len(here))
            keys, one, of = np.unique(joint[here], return_index=True, return_inverse=True)
            count, owner = np.bincount(of, weights=weight), context[here][one]
            total, kinds = _sum_by(owner, count, np.ones(len(count)))
            x = np.searchsorted(keys, joint[rows])
            shared[rows] = (np.maximum(count[x] - p.discount, 0) + p.discount * kinds[x] * shared[rows]) / total[x]

    context = chain[-2]
    logs, unseen = [], []
    for c in n:
        total, kinds = _sum_by(context, c, (c > 0).astype(float))
        back = p.strength + p.discount * kinds
        logs.append(np.log((np.maximum(c - p.discount, 0) + back * shared) / (p.strength + total)))
        unseen.append(np.log(back / (p.strength + total)))
    contexts, one = np.unique(context, return_index=True)
    return KneserNeyPair(pair, (logs[0] - logs[1]).astype(np.float32), contexts, (unseen[0] - unseen[1])[one].astype(np.float32), p.order)


def _calibrate(model: KneserNeyPair, texts: pa.Array, toxic: np.ndarray, p: ToxicityParams) -> None:
    """Logistic regression by Newton's steps with a slight pull to slope 0; the margin of least loss."""
    least = np.inf
    for margin, evidence in zip(p.margins, model.evidence(texts, p.margins), strict=True):
        value = _root(evidence)
        scale = max(float(np.std(value)), 1e-9)
        x = np.stack([value / scale, np.ones(len(value))], axis=1)
        w, pull = np.zeros(2), np.diag([1e-2, 1e-6])
        for _ in range(50):
            q = _logistic(x @ w)
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + pull, x.T @ (q - toxic) + pull @ w)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        q = np.clip(_logistic(x @ w), 1e-9, 1 - 1e-9)
        if (loss := -np.mean(np.where(toxic == 1, np.log(q), np.log(1 - q)))) < least:
            least, model.margin, model.slope, model.offset = loss, margin, float(w[0] / scale), float(w[1])


def fit(ids: np.ndarray, texts: pa.Array, toxic: np.ndarray, p: ToxicityParams) -> KneserNeyPair | None:
    """Models of four fifths of the rows, the curve from the others."""
    order = np.argsort(mix(ids.astype(np.int64).view(_U)), kind="stable")
    texts, toxic = texts.take(pa.array(order)), toxic[order]
    if len(np.unique(toxic)) < 2:
        return None
    fold = np.zeros(len(toxic), np.int64)
    for c in (0, 1):  # every fifth of each class
        fold[toxic == c] = np.arange((toxic == c).sum()) % 5
    out_of = np.flatnonzero(fold == 4) if min((toxic == c).sum() for c in (0, 1)) >= 5 else np.arange(len(toxic))
    inside = np.flatnonzero(fold != 4)
    model = fit_pair(texts.take(pa.array(inside)), toxic[inside], p)
    _calibrate(model, texts.take(pa.array(out_of)), toxic[out_of], p)
    return model


def _remainder(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> KneserNeyPair | None:
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").where(_remainder(p.folds) != 0)
    one = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    # what the bounds leave of each class, by a hash of the id; at most most_toxic + most_ordinary rows
    sample = None
    for c, most in ((1, p.most_toxic), (0, p.most_ordinary)):
        part = one.where(F.col("toxic") == c).withColumn("h", F.xxhash64("doc_id", F.lit("sample"))).orderBy("h", "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # a window over the bounded sample's sizes, without its texts
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.max("bytes").alias("bytes"))
    so_far = F.sum("bytes").over(Window.partitionBy("toxic").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    used = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= p.most_bytes).select("doc_id", "toxic")
    # of several texts of one id the one of the smallest hash, whatever the layout
    rows = texts.join(F.broadcast(used), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.sha2("text", 256), "text")).alias("text")).select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            t = pa.Table.from_batches(got)
            model = fit(t["doc_id"].to_numpy(), t["text"].cast(pa.large_string()).combine_chunks(), t["toxic"].to_numpy(), p)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def score_documents(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            score = np.zeros(batch.num_rows) if m is None else m.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_remainder(params.folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
