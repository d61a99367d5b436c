"""Line deduplication with two Bloom filters.

Every line of a document has a key: the line without ASCII white space at its
ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that stand in
two documents or more lose their lines everywhere but in the smallest id.

1. Keys are hashed to 128 bits, once a document, and stored (32 bytes a line).
2. A pass over the stored hashes fills two Bloom filters a task: a key whose
   bits all are in the once-seen filter already goes to the twice-seen one.
   Tasks send the words they set, cut into slices; a slice is merged by OR, and
   what two tasks have both set once is twice seen as well.
3. A second pass probes the twice-seen filter. Only keys that it may hold
   shuffle, combined before they do, for exact confirmation: the least and the
   greatest id that hold a key, and the least is the one that keeps it.
4. A third pass over the texts drops lines. Up to ``max_keys`` confirmed keys
   are sent to the tasks, and no text is shuffled; beyond that their rows meet
   the documents in a join by id.

A filter has 16 bits a key, 32 MB at most. Beyond that the hashes are dealt into
parts by their other half, with a filter for each, one after the other.

Defined results: null or empty text = one empty line; rows with the same id
count as one document, null ids too, and come last; repeated rows have each a
result of its own; line ends stay but for \n; an empty table gives an empty
result; extra columns, whatever their names, are left aside. A text is split
whole: the longest one and its lines have to fit in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices

WHITE = b" \t\n\x0b\x0c\r"
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 32 << 20
#: 64-bit words of a slice of a filter.
SLICE_WORDS = 4096
MAX_KEYS = 1 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line in UTF-8, or None where it is too short to count."""
    key = line.strip(WHITE).lower()  # of bytes: ASCII alone
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), np.uint64).reshape(-1, 2)


def key_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, k1, k2): the 128-bit hash of every key, once a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, found = batch.column(0), [], []
            for text in batch.column(1):
                lines = (text.as_py() or b"").split(b"\n")
                keys = dict.fromkeys(k for x in lines if (k := line_key(x, min_chars)) is not None)
                sizes.append(len(keys))
                found.append(_hashes(list(keys)))
            h = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "k1", "k2"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, k1 long, k2 long")


def _places(k1: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter that a hash belongs to, by its upper bits, and four bits there, by its lower ones."""
    k = k1.view(np.uint64)
    at = (k >> np.uint64(40)).astype(np.int64) & (words - 1)
    mask = np.zeros(len(k), np.uint64)
    for i in range(4):
        mask |= np.uint64(1) << ((k >> np.uint64(6 * i)) & np.uint64(63))
    return at, mask


def _sorted_or(at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words with all bits set in them."""
    order = np.argsort(at, kind="stable")
    at, mask = at[order], mask[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[first], np.bitwise_or.reduceat(mask, first) if len(first) else mask[:0]


def twice_seen(keys: DataFrame, words: int) -> np.ndarray:
    """The merged twice-seen filter of a table of hashes: ``words`` words of 64 bits, a bounded size."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            h = batch.column(0).to_numpy()
            distinct, counts = np.unique(h, return_counts=True)
            at, mask = _places(distinct, words)
            again = (counts > 1) | ((once[at] & mask) == mask)
            for to, which in ((twice, again), (once, slice(None))):
                w, bits = _sorted_or(at[which], mask[which])
                to[w] |= bits
        for s in range(0, words, SLICE_WORDS):
            at = np.flatnonzero(once[s : s + SLICE_WORDS])
            if len(at):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s // SLICE_WORDS], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "once": [once[s + at].tobytes()], "twice": [twice[s + at].tobytes()]})

    def merge(parts: pa.Table) -> pa.Table:  # as many words as keys of a slice, by the filter's size
        once, twice = np.zeros(SLICE_WORDS, np.uint64), np.zeros(SLICE_WORDS, np.uint64)
        for at, o, t in zip(*(parts.column(c) for c in ("at", "once", "twice"))):
            at, o, t = (np.frombuffer(x.as_py(), kind) for x, kind in ((at, np.uint16), (o, np.uint64), (t, np.uint64)))
            twice[at] |= t | (once[at] & o)
            once[at] |= o
        at = np.flatnonzero(twice)
        return pa.table({"slice": parts.column("slice")[:1], "at": pa.array([at.astype(np.uint16).tobytes()]), "twice": pa.array([twice[at].tobytes()])})

    filled = keys.select("k1").mapInArrow(fill, "slice int, at binary, once binary, twice binary")
    out = np.zeros(words, np.uint64)
    for r in filled.groupBy("slice").applyInArrow(merge, "slice int, at binary, twice binary").toLocalIterator():
        out[r["slice"] * SLICE_WORDS + np.frombuffer(r["at"], np.uint16).astype(np.int64)] = np.frombuffer(r["twice"], np.uint64)
    return out


def suspects(keys: DataFrame, twice: np.ndarray) -> DataFrame:
    """The rows of ``keys`` whose hash the twice-seen filter may hold."""
    sent = keys.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        for batch in batches:
            at, mask = _places(batch.column(1).to_numpy(), len(seen))
            yield batch.filter(pa.array((seen[at] & mask) == mask))

    return keys.select("doc_id", "k1", "k2").mapInArrow(run, "doc_id long, k1 long, k2 long")


def repeated_keys(keys: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(k1, k2, first): keys of two documents or more, and the one that keeps them, as (whether its id is null, id)."""
    n = keys.count()
    words = SLICE_WORDS
    while words * 64 < n * BITS_PER_KEY and words * 16 <= max_filter_bytes and words < 1 << 24:
        words *= 2
    parts = max(1, -(-n * BITS_PER_KEY // (words * 64)))
    found = None
    for part in range(parts):
        some = keys if parts == 1 else keys.where(F.pmod("k2", F.lit(parts)) == part)
        doc = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
        pairs = suspects(some, twice_seen(some, words)).groupBy("k1", "k2").agg(F.min(doc).alias("first"), F.max(doc).alias("last"))
        # Null ids count as one document, the last, so two documents differ here.
        one = materialize(pairs.where((F.col("first.none") != F.col("last.none")) | (F.col("first.id") != F.col("last.id"))).select("k1", "k2", F.col("first.none").alias("none"), F.col("first.id").alias("id")), "line-keys")
        found = one if found is None else found.unionByName(one)
    return found


class _Keys:
    """Repeated keys in the order of their hash, to look up those of a document's lines."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, keep: np.ndarray, none: np.ndarray):
        order = np.argsort(k1, kind="stable")
        self.k1, self.k2, self.keep, self.none = k1[order], k2[order], keep[order], none[order]
        runs = np.unique(self.k1, return_counts=True)[1] if len(k1) else [1]
        self.longest = int(max(runs))  # keys that share a first half

    def dropped(self, h: np.ndarray, doc_id: int | None) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if not len(self.k1):
            return out
        at = np.searchsorted(self.k1, h[:, 0])
        for step in range(self.longest):
            i = np.minimum(at + step, len(self.k1) - 1)
            same = (self.k1[i] == h[:, 0]) & (self.k2[i] == h[:, 1])
            out |= same & (~self.none[i] if doc_id is None else self.none[i] | (self.keep[i] != doc_id))
        return out


def _without(text: bytes, drop, min_chars: int) -> tuple[bytes, int, int]:
    """What stays of a text, its lines and how many go. ``drop`` judges hashes of keys."""
    lines = text.split(b"\n")
    keys = [line_key(x, min_chars) for x in lines]
    judged = [i for i, k in enumerate(keys) if k is not None]
    gone = {judged[i] for i in np.flatnonzero(drop(_hashes([keys[i] for i in judged]).view(np.int64)))}
    return (b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text), len(lines), len(gone)


_RESULT = "doc_id long, text string, n_lines long, n_dropped long"


def _results(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, lines, dropped = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_filter_bytes: int = MAX_FILTER_BYTES, max_keys: int = MAX_KEYS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row: what stays of its text, its lines before, and how many went."""
    spark = docs.sparkSession
    keys = materialize(key_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    found = repeated_keys(keys, max_filter_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    if found.count() <= max_keys:
        t = found.toArrow()
        sent = spark.sparkContext.broadcast(_Keys(*(t.column(c).to_numpy() for c in ("k1", "k2")), t.column("id").fill_null(0).to_numpy(), t.column("none").to_numpy()))
        discard(keys, found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                yield _results([(i, *_without(t.as_py() or b"", lambda h: table.dropped(h, i), min_chars)) for i, t in zip(ids, batch.column(1))])

        return rows.mapInArrow(run, _RESULT)

    doc = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"])
    losing = keys.join(found, ["k1", "k2"]).where(F.col("doc_id").isNull() & ~F.col("none") | F.col("doc_id").isNotNull() & (F.col("none") | (F.col("id") != F.col("doc_id"))))
    by_doc = materialize(losing.select("doc_id", "k1", "k2").distinct().groupBy("doc_id").agg(F.collect_list("k1").alias("k1"), F.collect_list("k2").alias("k2")), "lines-to-drop")
    discard(keys)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for i, t, a, b in zip(*(batch.column(c).to_pylist() for c in range(4))):
                go = set(zip(a or (), b or ()))
                out.append((i, *_without(t or b"", lambda h: np.array([tuple(x) in go for x in h.tolist()], bool), min_chars)))
            yield _results(out)

    return rows.join(by_doc, doc(rows, by_doc), "left").select(rows["doc_id"], "text", "k1", "k2").mapInArrow(apply, _RESULT)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
g AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, g.keep IS NOT NULL AND g.keep <> k.doc_id AS dropped FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
