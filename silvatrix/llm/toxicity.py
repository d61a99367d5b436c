"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled set is a draw from all
documents of the training folds by hash alone, whether or not they have a label
and whatever it says; nothing is taken to be clean because nobody called it
toxic. With the class prior ``pi`` the risk of calling unlabelled text toxic is
estimated as

    R_u^-(g) - pi * R_p^-(g)

which is what clean text alone would give. On a finite sample a flexible
classifier can drive that estimate below zero; the non-negative estimator
stops there and takes a step against it instead (Kiryo et al., 2017).

The classifier is linear over the presence of hashed words and word beginnings,
each weighed by how much likelier it is in positives than elsewhere, trained
with numpy on the driver. It learns from a bounded sample: about
``max_positives`` positives and ``max_unlabelled`` documents, each set chosen by
hash at a rate of its own. Features are counted over the sample on the cluster;
of its rows only features that speak for toxicity reach the driver, one row for
texts that have the same.

The class prior is the share of confirmed toxic texts among the labelled
training rows, counted over all of them.

Defined results: null text = empty text, which has the score of the bias;
without positives the score is 0 for all; a null doc_id is not held out; a
document with several labels is toxic if one says so; rows with a repeated
doc_id are scored each, and equal ones count once in the sample; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty
from .features import WORD, HashedWords, sigmoid

BITS = 17
THRESHOLD = 0.7
#: Rows of the training sample, as expected of its hash.
MAX_POSITIVES = 4000
MAX_UNLABELLED = 12000


def _parts(word: str) -> tuple[str, ...]:
    """The word, and its beginnings, which inflected forms share."""
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n))


def fold(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def _index_batches(batches):
    words = HashedWords(BITS, _parts)
    for batch in slices(batches):
        rows = [np.sort(np.fromiter(words(WORD.findall(t.lower())), np.int32)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column("positive"), batch.column("drawn")], ["features", "positive", "drawn"])


def evidence(in_pos: np.ndarray, in_all: np.ndarray, n_pos: int, n_all: int, prior_count: float = 10.0) -> np.ndarray:
    """How much more often each feature is in positives than in the unlabelled draw, as a log ratio.

    Counts of ``prior_count`` are added, so rare features say little. Only
    features that speak for toxicity count; small ratios are cut to nothing,
    so the length of a text has no say.
    """
    ratio = np.log((in_pos + prior_count) / (in_all * (n_pos / max(1, n_all)) + prior_count))
    return np.where(ratio < 0.4, 0.0, ratio)


def nnpu_fit(rows: list[np.ndarray], positive: np.ndarray, drawn: np.ndarray, value: np.ndarray, prior: float, epochs: int = 40, rate: float = 0.05, decay: float = 1e-5, back: float = 1.0, batch: int = 1024, seed: int = 5):
    """Weights and bias of a linear classifier under the non-negative PU risk, by Adam.

    The ``drawn`` rows are the unlabelled draw, which holds positives at the
    share ``prior``. A feature's ``value`` is its :func:`evidence`; the weights
    start at one. The loss is logistic: l(z) = log(1 + exp(-z)).
    """
    size = len(value)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(drawn)
    if not len(pos):
        return np.zeros(size), -60.0
    rng = np.random.default_rng(seed)
    rows = [r[value[r] != 0] for r in rows]
    w = np.append(np.ones(size), -3.0)  # the last is the bias
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    begin = np.cumsum(lens) - lens
    rounds = max(1, len(unl) // batch)
    for _ in range(epochs):
        for ps, us in zip(np.array_split(rng.permutation(pos), rounds), np.array_split(rng.permutation(unl), rounds)):
            if not len(ps) or not len(us):
                continue
            chosen = np.concatenate([ps, us])
            k = lens[chosen]
            row = np.repeat(np.arange(len(chosen)), k)
            idx = flat[np.repeat(begin[chosen] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            s = sigmoid(np.bincount(row, w[idx] * value[idx], len(chosen)) + w[-1])
            loss = -np.log(np.maximum(1 - s, 1e-12))  # of calling it clean
            zp, zu = slice(0, len(ps)), slice(len(ps), None)
            g = np.zeros(len(chosen))
            if loss[zu].mean() - prior * loss[zp].mean() >= 0:
                g[zp] = prior * (s[zp] - 1) / len(ps) - prior * s[zp] / len(ps)
                g[zu] = s[zu] / len(us)
            else:  # the estimate of clean text's risk fell below nothing: step against it
                g[zp] = back * prior * s[zp] / len(ps)
                g[zu] = -back * s[zu] / len(us)
            grad = np.bincount(idx, g[row] * value[idx], size + 1)
            grad[:-1] += decay * (w[:-1] - 1)
            grad[-1] += g.sum()
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1] * value, float(w[-1])


def _hash_below(most: int, rows: int, *of: str) -> Column:
    """True for about ``most`` of ``rows`` rows, by hash."""
    return F.pmod(F.xxhash64(F.lit(99), *of), F.lit(1 << 30)) < max(1, min(1 << 30, (most << 30) // max(1, rows)))


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_positives: int, max_unlabelled: int) -> tuple[DataFrame | None, float]:
    """(features, positive, drawn) of the sample, and the class prior; None without positives."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic:
        return None, 0.0
    confirmed = known.where((F.col("toxic") == 1) & _hash_below(max_positives, toxic, "doc_id")).select("doc_id", F.lit(True).alias("positive"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(fold("doc_id", folds) != held_out)
    drawn = _hash_below(max_unlabelled, texts.select("doc_id").count(), "doc_id", "text")
    # The positives are bounded by their parameter, so their ids are too: no text is shuffled for them.
    marked = texts.join(F.broadcast(confirmed), "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"), drawn.alias("drawn"))
    rows = marked.where("positive or drawn").mapInArrow(_index_batches, "features array<int>, positive boolean, drawn boolean")
    return materialize(rows.distinct(), "toxicity-sample"), toxic / n


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED):
    """Weights and bias, from rows outside the held-out fold."""
    sample, prior = training_sample(docs, labels, folds, held_out, max_positives, max_unlabelled)
    if sample is None:
        return np.zeros(1 << BITS), -60.0
    number = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    n_pos, n_all = sample.agg(number("positive"), number("drawn")).first()
    counted = sample.select(F.explode("features").alias("f"), "positive", "drawn").groupBy("f").agg(number("positive").alias("p"), number("drawn").alias("d")).toArrow()  # 2**BITS rows at most
    in_pos, in_all = np.zeros(1 << BITS), np.zeros(1 << BITS)
    in_pos[np.asarray(counted.column("f"))] = np.asarray(counted.column("p"))
    in_all[np.asarray(counted.column("f"))] = np.asarray(counted.column("d"))
    value = evidence(in_pos, in_all, n_pos, n_all)
    telling = value != 0

    def only_telling(batches):
        for batch in slices(batches):
            rows = [np.array(r, np.int32) for r in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[telling[r]] for r in rows], pa.list_(pa.int32())), batch.column("positive"), batch.column("drawn")], ["features", "positive", "drawn"])

    got = sample.mapInArrow(only_telling, "features array<int>, positive boolean, drawn boolean").toArrow()
    rows = [np.array(r, np.int32) for r in got.column("features").to_pylist()]
    positive, drawn = (np.array(got.column(c).to_pylist(), bool) for c in ("positive", "drawn"))
    order = sorted(range(len(rows)), key=lambda i: (positive[i], drawn[i], len(rows[i]), rows[i].tobytes()))  # whatever order rows came in
    return nnpu_fit([rows[i] for i in order], positive[order], drawn[order], value, prior)


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    weights, bias = fit(docs, labels, folds, held_out, max_positives, max_unlabelled)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 2**BITS floats

    def run(batches):
        w, b = shared.value
        words = HashedWords(BITS, _parts)
        for batch in slices(batches):
            out = []
            for t in batch.column("text").to_pylist():
                idx = np.fromiter(words(WORD.findall(t.lower())), np.int32)
                out.append(float(w[np.sort(idx)].sum(dtype=np.float64)) + b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(sigmoid(np.array(out)), pa.float64())], ["doc_id", "held_out", "score"])

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held_out).alias("held_out"), text_or_empty().alias("text"))
    scored = need.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
