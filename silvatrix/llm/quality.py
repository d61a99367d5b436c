"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of about a hundred words, and only the document
has a label. Every passage is encoded by a small network from learnt embeddings
of its words, hashed to ``WORD_SLOTS`` rows of a table, and from counts of its
surface; gated attention (Ilse et al., 2018)

    a_i = softmax_i( w . (tanh(V h_i) * sigmoid(U h_i)) )

weighs the encodings, and the weighted sum is scored. Attention learns by
itself which passages tell: a page of good prose with a block of junk is found
by the block.

Training is numpy on the driver over a hashed sample of whole labelled rows:
about ``max_rows`` of them, or fewer where these would have over about
``max_passages`` passages in all. Only passage features are collected. Scoring
covers whole texts on the executors.

Defined results: null text = empty text, a bag of one empty passage; without
labels of both kinds the score is 1 for all; a null doc_id is not held out; of
several labels of a document the largest counts; of rows that share a labelled
doc_id one is learnt from, and each is scored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, slices, text_or_empty
from .features import sigmoid, spread
from .toxicity import fold

PASSAGE_WORDS = 96
THRESHOLD = 0.3
#: Labelled rows that training takes, and passages of them in all, as expected of their hash.
MAX_ROWS = 12000
MAX_PASSAGES = 100_000
#: Rows of the table of word embeddings, and numbers of each.
WORD_SLOTS, EMBEDDING = 1 << 14, 8
HIDDEN, GATE = 16, 8
#: Passages whose words are looked up at once.
_BLOCK = 1024

_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_MARKS = b".,;:'\"()-?"
_SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in _MARKS)
_HIGH = bytes(range(0x80, 0x100))
FEATURES = ("upper", "digit", "mark", "symbol", "bang", "pipe", "high", "word_length", "long_words", "short_words", "distinct", "most_frequent", "echoes", "size")


def passage_features(words: list[str]) -> list[float]:
    line = " ".join(words).encode("utf-8", "surrogatepass")
    m, n = len(line), len(words)
    part = lambda kind: spread(m - len(line.translate(None, kind)), m)
    counts = Counter(words)
    lengths = [len(w) for w in words]
    return [
        part(_UPPER), part(_DIGIT), part(_MARKS), part(_SYMBOLS), spread(line.count(b"!"), m), spread(line.count(b"|"), m), part(_HIGH),
        spread(sum(lengths), 10 * n), spread(sum(x > 14 for x in lengths), n), spread(sum(x <= 3 for x in lengths), n),
        spread(len(counts), n), spread(max(counts.values(), default=0), n), spread(sum(a == b for a, b in zip(words, words[1:])), n), min(1.0, n / PASSAGE_WORDS),
    ]


@lru_cache(maxsize=30_000)
def _slot(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS


class Bag(NamedTuple):
    """Passages: surface features of each, slots of all their words in order, words of each."""

    surface: np.ndarray
    words: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def together(bags: list[Bag]) -> tuple[Bag, np.ndarray]:
        """The passages of all bags, and where each bag begins."""
        return Bag(*map(np.concatenate, zip(*bags))), np.cumsum([0, *(len(b.sizes) for b in bags[:-1])])


def bag(text: str) -> Bag:
    """All passages of the whole text; at least one, which may be empty."""
    words = text.split()
    passages = [words[i : i + PASSAGE_WORDS] for i in range(0, max(1, len(words)), PASSAGE_WORDS)]
    slots = np.fromiter(map(_slot, words), np.int32, len(words))
    return Bag(np.array([passage_features(p) for p in passages], np.float32), slots, np.array([len(p) for p in passages], np.int32))


class AttentionModel:
    """Encoder, gated attention and scorer over bags of passages."""

    def __init__(self, surface: int, slots: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"E": rng.normal(0, 0.1, (slots, EMBEDDING)), "W": init(surface + EMBEDDING, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "c0": np.zeros(1)}
        self.mean, self.scale = np.zeros(surface), np.ones(surface)

    def _embedded(self, x: Bag) -> np.ndarray:
        """Of each passage, the sum of its words' embeddings over the root of their number."""
        out = np.zeros((len(x.sizes), EMBEDDING))
        ends = np.cumsum(x.sizes, dtype=np.int64)
        begins = ends - x.sizes
        for at in range(0, len(out), _BLOCK):
            some = at + np.flatnonzero(x.sizes[at : at + _BLOCK])
            if len(some):
                first = begins[some[0]]
                out[some] = np.add.reduceat(self.p["E"][x.words[first : ends[some[-1]]]], begins[some] - first)
        return out / np.sqrt(np.maximum(x.sizes, 1))[:, None]

    def _forward(self, x: Bag, begins: np.ndarray):
        p = self.p
        bags = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(x.sizes))))
        x = np.hstack([np.clip((x.surface - self.mean) / self.scale, -8, 8), self._embedded(x)])
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, begins)[bags])
        a = e / np.add.reduceat(e, begins)[bags]
        z = np.add.reduceat(a[:, None] * h, begins)
        return x, bags, h, t, g, a, z, sigmoid(z @ p["c"] + p["c0"][0])

    def score(self, x: Bag, begins: np.ndarray) -> np.ndarray:
        return self._forward(x, begins)[-1]

    def gradients(self, passages: Bag, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the bags."""
        p = self.p
        x, bags, h, t, g, a, z, s = self._forward(passages, begins)
        ds = (s - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[bags] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, begins)[bags])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[bags] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        of_word = np.repeat(dx @ p["W"][-EMBEDDING:].T / np.sqrt(np.maximum(passages.sizes, 1))[:, None], passages.sizes, axis=0)
        table = np.column_stack([np.bincount(passages.words, of_word[:, k], len(p["E"])) for k in range(EMBEDDING)])
        return {"E": table, "W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "c0": np.array([ds.sum()])}

    def fit(self, bags: list[Bag], y: np.ndarray, epochs: int = 16, rate: float = 0.01, batch: int = 256, seed: int = 3) -> AttentionModel:
        rng = np.random.default_rng(seed)
        every = Bag.together(bags)[0].surface.astype(float)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs) + 1e-4
            for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
                step += 1
                for k, g in self.gradients(*Bag.together([bags[i] for i in part]), y[part]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bag_batches(batches):
    names = ["surface", "words", "sizes"]
    kinds = pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.int32())
    for batch in slices(batches):
        bags = [bag(t) for t in batch.column("text").to_pylist()]
        parts = [pa.array([np.ravel(b[k]) for b in bags], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *parts], ["doc_id", "quality", *names])


def _drawn(rate: float, seed: int) -> Column:
    """True for this share of ids, by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < max(1, min(1 << 20, int(rate * (1 << 20))))


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_rows: int, max_passages: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(quality, surface, words, sizes) of labelled rows outside the held-out fold; None without labels of both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not 0 < good < n:
        return None
    chosen = known.where(_drawn(max_rows / n, 7))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # The sample is bounded by the parameters, so its ids are too: no text is shuffled for it.
    bags = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(_bag_batches, "doc_id long, quality int, surface array<float>, words array<int>, sizes array<int>")
    one = bags.groupBy("doc_id").agg(F.min(F.struct("quality", "surface", "words", "sizes")).alias("b"))
    sample = materialize(one.select("doc_id", "b.*"), "quality-sample")
    passages = sample.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    return sample.where(_drawn(max_passages / max(1, passages), 8)).drop("doc_id")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS, max_passages: int = MAX_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel | None:
    """The model, from labelled rows outside the held-out fold."""
    sample = training_sample(docs, labels, folds, held_out, max_rows, max_passages, id_col, text_col)
    if sample is None:
        return None
    got = sample.toArrow()
    lists = [[v.values.to_numpy() for v in got.column(c)] for c in ("surface", "words", "sizes")]
    rows = [(q, Bag(x.reshape(-1, len(FEATURES)), w, z)) for q, x, w, z in zip(got.column("quality").to_pylist(), *lists)]
    rows.sort(key=lambda r: (r[0], len(r[1].sizes), r[1].surface.tobytes(), r[1].words.tobytes()))  # whatever order rows came in
    y = np.array([r[0] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    return AttentionModel(len(FEATURES), WORD_SLOTS).fit([r[1] for r in rows], y)


def _scores(model: AttentionModel, texts: list) -> np.ndarray:
    return model.score(*Bag.together([bag(t or "") for t in texts]))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, max_passages: int = MAX_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, row_key, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held_out, max_rows, max_passages, id_col, text_col))  # a table of embeddings, 1 MB

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            scores = np.ones(len(texts)) if model is None else _scores(model, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "row_key", "held_out", "score"])

    need = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), (fold(id_col, folds) == held_out).alias("held_out"), text_or_empty(text_col).alias("text"))
    scored = need.mapInArrow(run, "doc_id long, row_key binary, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, max_passages: int = MAX_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns unchanged.

    Rows are scored and filtered where they are read, so no text is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held_out, max_rows, max_passages, id_col, text_col))

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            yield batch if model is None else batch.filter(pa.array(_scores(model, batch.column(text_col).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
