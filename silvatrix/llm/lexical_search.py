"""Ranked lexical search with block-max posting blocks.

The index is made in one pass and without a shuffle. Every task cuts its
documents into segments, bounded in documents and postings; a segment has, for
each term, its postings in blocks of 128: ordinals as differences and counts,
both packed to as few bits as they need, with the block's first and last
ordinal and its impacts, the pairs (occurrences, document length) that no other
posting of the block beats in both. Since impacts don't hang on the statistics
of the corpus, segments never have to be made again when documents come.

A search sums what the formula needs over the stored columns: documents and
terms, and how many documents hold a query's term. Segments then go to tasks, a
segment's rows together, and for each query:

* a term's largest score in a block follows from the block's impacts alone.
  Pointers over block bounds move without decompression (shallow moves): their
  running sum is the bound of every document; those below the threshold,
  the score of the k-th best document so far, are never looked at again;
* what is left is scored term by term, strongest first. Only blocks that cover a
  document still in reach are decompressed, and after each term documents go
  whose sum and the bounds of the terms to come stay below the threshold.

The best k of a task stay from segment to segment, so the threshold rises while
it goes on; a window over k rows a query and task gives the result. Queries are
taken in blocks of bounded size, so any number of them is ranked.

Defined results: null or empty text has no term and is in no result; every row
of the documents is one document, so repeated rows come as often as they are
there; null ids come last among equal scores; every row of the queries is an
item of its own; a query without terms or found documents has no rows; empty
tables give an empty result; extra columns, whatever their names, are left
aside. A text of any length is taken whole, and makes one document of a segment.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

BLOCK = 128
SEGMENT_DOCS = 16_384
SEGMENT_POSTINGS = 2_000_000
#: Pairs of query and term that one run over the index takes.
QUERY_TERMS = 50_000
#: In UTF-8: digits, letters with A-Z lower-cased, and every byte beyond ASCII; a blank for the rest.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_INDEX = "segment long, term binary, block int, first int, last int, n int, total long, impacts binary, postings binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers in as many bits each as the largest needs."""
    width = max(1, int(values.max()).bit_length())
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """``n`` packed numbers, and how many bytes they took."""
    width = data[0]
    size = 1 + (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size - 1, 1), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64)), size


def encode_block(ordinals: np.ndarray, counts: np.ndarray) -> bytes:
    """A block without its first ordinal, which its row has."""
    return pack(np.diff(ordinals, prepend=ordinals[0])) + pack(counts)


def decode_block(data: bytes, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    gaps, size = unpack(data, n)
    return first + np.cumsum(gaps), unpack(data[size:], n)[0]


def impacts_of(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pairs (count, length) of a block that none beats: fewer occurrences only in shorter documents."""
    order = np.lexsort((lengths, -counts))
    c, n = counts[order], lengths[order]
    best = np.minimum.accumulate(n)
    keep = np.r_[True, n[1:] < best[:-1]]
    return np.stack([c[keep], n[keep]])


def _segment(number: int, ids: list, lengths: list[int], terms: dict[bytes, int], parts: tuple[list, list, list]) -> pa.RecordBatch:
    """The rows of a segment: its documents in the row without a term, then its blocks."""
    n = np.array(lengths, np.int64)
    rows = [[None], [0], [0], [len(ids) - 1], [len(ids)], [int(n.sum())], [np.array([x is None for x in ids], np.uint8).tobytes()], [np.array([x or 0 for x in ids], np.int64).tobytes() + n.tobytes()]]
    if terms:
        names = list(terms)
        term, at, count = np.concatenate(parts[0]), np.repeat(np.arange(len(ids)), parts[2]), np.concatenate(parts[1])
        order = np.argsort(term, kind="stable")
        term, at, count = term[order], at[order], count[order]
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        for t, (begin, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            for b, lo in enumerate(range(begin, end, BLOCK)):
                o, c = at[lo : min(lo + BLOCK, end)], count[lo : min(lo + BLOCK, end)]
                for to, x in zip(rows, (names[t], b, int(o[0]), int(o[-1]), len(o), 0, impacts_of(c, n[o]).tobytes(), encode_block(o, c))):
                    to.append(x)
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), number)), *(pa.array(x, k) for x, k in zip(rows, kinds))], names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: set[bytes] | None = None) -> DataFrame:
    """Index ``docs``; with a ``vocabulary`` of bounded size, keep the postings of its terms only."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = known and known.value
        number = TaskContext.get().partitionId() << 32
        ids, lengths, terms, parts, postings = [], [], {}, ([], [], []), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                if only is not None:
                    counts = {t: counts[t] for t in counts.keys() & only}
                ids.append(i)
                lengths.append(len(words))
                parts[0].append(np.fromiter((terms.setdefault(t, len(terms)) for t in counts), np.int32, len(counts)))
                parts[1].append(np.fromiter(counts.values(), np.int64, len(counts)))
                parts[2].append(len(counts))
                postings += len(counts)
                if len(ids) >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield _segment(number, ids, lengths, terms, parts)
                    number += 1
                    ids, lengths, terms, parts, postings = [], [], {}, ([], [], []), 0
        if ids:
            yield _segment(number, ids, lengths, terms, parts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, _INDEX)


def factor(count, m):
    """What an occurrence count gives before its term's weight, rounded down."""
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


def norm(lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A document's m from its length."""
    if 50 * int(lengths.max(initial=0)) * docs >= 1 << 63:
        return np.array([50 + (50 * int(x) * docs) // total for x in lengths], np.int64)
    return 50 + (50 * lengths * docs) // total


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class _Segment:
    """A segment while it is searched: bounds at hand, blocks decompressed when first needed."""

    def __init__(self, rows: list[dict], docs: int, total: int):
        head = rows[0]
        both = np.frombuffer(head["postings"], np.int64).reshape(2, -1)
        self.none, self.ids, self.docs, self.total = np.frombuffer(head["impacts"], np.uint8), both[0], docs, total
        self.m = norm(both[1], docs, total)
        self.lists: dict[bytes, list[dict]] = {}
        for r in rows[1:]:
            self.lists.setdefault(r["term"], []).append(r)
        self.bounds: dict[bytes, tuple] = {}
        self.decoded: dict[tuple[bytes, int], tuple] = {}

    def shallow(self, term: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last ordinal and the largest factor of each block of a term, without its postings."""
        if term not in self.bounds:
            blocks = self.lists[term]
            pairs = [np.frombuffer(b["impacts"], np.int64).reshape(2, -1) for b in blocks]
            best = factor(np.concatenate([p[0] for p in pairs]), norm(np.concatenate([p[1] for p in pairs]), self.docs, self.total))
            starts = np.cumsum([0, *(p.shape[1] for p in pairs[:-1])])
            self.bounds[term] = np.array([b["first"] for b in blocks]), np.array([b["last"] for b in blocks]), np.maximum.reduceat(best, starts)
        return self.bounds[term]

    def block(self, term: bytes, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and factors of a block."""
        if (term, b) not in self.decoded:
            r = self.lists[term][b]
            at, count = decode_block(r["postings"], r["first"], r["n"])
            self.decoded[term, b] = at, factor(count, self.m[at])
        return self.decoded[term, b]

    def search(self, terms: list[tuple[bytes, int]], best: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple:
        """``best``, (scores, null ids, ids) of the k best so far, with what this segment adds."""
        here = [(w, t, *self.shallow(t)) for t, w in terms if t in self.lists]
        least = int(best[0][-1]) if len(best[0]) >= k else 1
        here.sort(key=lambda x: -x[0] * int(x[4].max()))
        if sum(x[0] * int(x[4].max()) for x in here) < least:
            return best
        moves = np.zeros(len(self.ids) + 1, np.int64)
        for w, _, first, last, top in here:
            moves[first] += w * top
            moves[last + 1] -= w * top
        bound = np.cumsum(moves[:-1])
        live = np.flatnonzero(bound >= least)
        rest, score = bound[live], np.zeros(len(self.ids), np.int64)
        for w, t, first, last, top in here:
            if not len(live):
                return best
            b = np.minimum(np.searchsorted(last, live), len(last) - 1)
            covered = (first[b] <= live) & (live <= last[b])
            for i in np.unique(b[covered]).tolist():
                at, f = self.block(t, i)
                score[at] += w * f
            rest -= np.where(covered, w * top[b], 0)
            keep = score[live] + rest >= least
            if not keep.all():
                live, rest = live[keep], rest[keep]
        found = score[live]
        s, none, ids = np.r_[best[0], found], np.r_[best[1], self.none[live]], np.r_[best[2], self.ids[live]]
        order = np.lexsort((ids, none, -s))[:k]
        return s[order], none[order], ids[order]


_FOUND = "q long, doc_id long, score long"


def search(index: DataFrame, queries: dict[int, list[bytes]], k: int = 50) -> DataFrame:
    """(q, rank, doc_id, score): the ``k`` best documents of a bounded block of queries, given by their distinct terms."""
    spark = index.sparkSession
    totals = index.where("term is null").agg(F.sum("n"), F.sum("total")).first()
    docs, total = totals[0] or 0, totals[1] or 0
    wanted = spark.createDataFrame([(t,) for t in sorted({t for ts in queries.values() for t in ts})], "term binary")
    rows = index.join(F.broadcast(wanted), "term", "left_semi")  # QUERY_TERMS terms at most
    holding = {bytes(r["term"]): r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator()}
    weighed = {q: [(t, weight(docs, holding[t])) for t in ts if t in holding] for q, ts in queries.items()}
    sent = spark.sparkContext.broadcast({q: [x for x in ts if x[1] > 0] for q, ts in weighed.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = {q: (none, none.astype(np.uint8), none) for q in sent.value}

        def one(rows: list[dict]) -> None:
            seg = _Segment(rows, docs, total)
            for q, ts in sent.value.items():
                best[q] = seg.search(ts, best[q], k)

        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["segment"] != held[0]["segment"]:
                    one(held)
                    held = []
                held.append(r)
        if held:
            one(held)
        for q, (s, null, ids) in best.items():
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q)), pa.array(ids, mask=null.astype(bool)), pa.array(s)], ["q", "doc_id", "score"])

    # A segment's documents first, then its terms; segments are bounded, whatever a term's number of documents.
    dealt = rows.unionByName(index.where("term is null")).repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first(), "block")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return dealt.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_blocks(items: DataFrame, id_col: str, text_col: str, most: int = QUERY_TERMS) -> Iterator[tuple[dict[int, int | None], dict[int, list[bytes]]]]:
    """Queries by their number, {number: id} and {number: distinct terms}, in blocks of ``most`` terms (or one query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(dict.fromkeys(terms_of(t.as_py()))) for t in batch.column(1)], pa.list_(pa.binary()))], ["id", "terms"])

    ids, found, size = {}, {}, 0
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "id long, terms array<binary>")
    for q, r in enumerate(rows.toLocalIterator()):
        if found and size + len(r["terms"]) > most:
            yield ids, found
            ids, found, size = {}, {}, 0
        ids[q], found[q] = r["id"], [bytes(t) for t in r["terms"]]
        size += len(r["terms"])
    yield ids, found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item.

    Where the items fit one block, only their terms are indexed; else all terms
    are, once, and every block of items reads its own.
    """
    spark = docs.sparkSession
    blocks = query_blocks(items, item_col, item_text_col, most_terms)
    block, after = next(blocks), next(blocks, None)
    vocabulary = {t for ts in block[1].values() for t in ts} if after is None else None
    index = materialize(build_index(docs, id_col, text_col, vocabulary), "posting-blocks")
    out = None
    while block is not None:
        names = spark.createDataFrame(list(block[0].items()), "q long, item_id long")
        one = search(index, block[1], k).join(F.broadcast(names), "q")
        one = materialize(one.select("item_id", "rank", "doc_id", "score"), "ranked")  # k rows a query
        out = one if out is None else out.unionByName(one)
        block, after = after, next(blocks, None) if after is not None else None
    discard(index)
    return out


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, unnest({_TERMS}) AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, big_n),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
s AS (
  SELECT q.item_id, tf.doc_id, tf.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * len.n * c.big_n) // c.big_l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (r) CROSS JOIN c GROUP BY q.item_id, tf.doc_id, tf.r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
