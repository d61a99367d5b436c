"""Removal of repeated byte strings by a bucketed, sparse suffix array.

A byte goes if it lies in a string of ``length`` bytes (400) that also starts
anywhere else, in the same document or another. Sorting every suffix of a
corpus would move each byte many times, so suffixes are sorted where a repeat
can be, and equal contexts count once:

1. *Anchors.* Of the ``length``-byte windows of a text, each takes as its
   anchor the position with the least hash of a ``gram``-byte string inside
   it, leftmost first. Equal windows have the same anchor at the same offset.
   Neighbouring windows share anchors, so there is one for about 140 bytes; an
   anchor's *context* is the stretch that its windows cover.
2. *Buckets.* Anchors meet by the hash of their gram. One that meets no other
   ends here. Equal contexts of a bucket become one with a count: with two or
   more, all of it is repeated, and no text is moved for it.
3. *Suffix arrays.* For buckets with different contexts these are fetched, one
   of each kind, and both the suffixes from the anchor on and, reversed, the
   prefixes up to it are put in order by deep-shallow sorting. Two contexts
   agree on ``L`` bytes before and ``R`` from the anchor on; they share a
   window just if L + R >= length, and then every byte from L before to R
   after. Joining the suffixes from the longest common prefix down while
   looking up left neighbours finds each context's largest L and R without
   going through pairs.
4. *Large buckets.* One with over ``large`` different contexts is not sorted by
   one task: its windows are hashed (128 bits) and counted instead, which
   spreads over the cluster and combines before the shuffle.

A corpus is better rid of whole passages than of phrases, so runs of removed
bytes may be asked to hold a number of words: :data:`PASSAGE` is over 50 words,
found by strings of 200 bytes, which 50 words of three letters have.

Defined results: null text = empty text; a text under ``length`` bytes keeps
all; rows that repeat a text lose all of it, the first one included (strings
are judged on the input); an empty table gives an empty result; extra columns,
whatever their names, pass. Documents of any length are worked through in
segments.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, discard, materialize, row_key, slices, text_or_empty
from .suffix_sort import deep_shallow_sort

#: Length of the strings, and words that a run of them has at least, of a repeated passage.
PASSAGE = (200, 51)
#: Starts of windows that are hashed at a time.
SEGMENT = 1 << 18
#: Different contexts that a bucket may have to be sorted by one task.
LARGE = 8192
_REACH = 12  # bits of a context's reach before and after its anchor


def _gram(length: int) -> int:
    gram = 1
    while gram * 2 <= max(1, length * 2 // 5):
        gram *= 2
    return gram


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all ``gram``-byte strings, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < gram:
        right = h[step:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = h[:-step] * np.uint64(0x165667B19E3779F9)
        h += right ^ (right >> np.uint64(31))
        h ^= h >> np.uint64(32)
        step *= 2
    return h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima within blocks."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()[width - 1 : width - 1 + n]
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(ahead, behind)


def anchors(segment: bytes, ends: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of concatenated texts: document, gram hash, anchor, first and last window start.

    ``offsets``/``ends`` bound each text in ``segment``; windows don't leave a text.
    """
    gram = _gram(length)
    none = np.empty(0, np.int64)
    if len(segment) < length:
        return none, none.view(np.uint64), none, none, none
    h = _gram_hashes(np.frombuffer(segment, np.uint8), gram)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(ends - offsets - length + 1, 0)
    doc = np.repeat(np.arange(len(ends)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets, windows)
    at = at[start]
    if not len(at):
        return none, none.view(np.uint64), none, none, none
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    return doc[first], h[at[first]], at[first], start[first], start[last]


def _segments(texts: list[bytes], length: int):
    """Texts in portions of about SEGMENT bytes: (text number, offset in the text, piece)."""
    portion, size = [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - length + 1), SEGMENT):
            piece = text[begin : begin + SEGMENT + length - 1]
            if len(piece) < length:
                continue
            if size and size + len(piece) > SEGMENT + length:
                yield portion
                portion, size = [], 0
            portion.append((i, begin, piece))
            size += len(piece)
    if portion:
        yield portion


def _anchor_batches(length: int):
    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            keys = batch.column("row_key")
            for portion in _segments(texts, length):
                joined = b"".join(x[2] for x in portion)
                ends = np.cumsum([len(x[2]) for x in portion])
                offsets = ends - [len(x[2]) for x in portion]
                doc, h, at, lo, hi = anchors(joined, ends, offsets, length)
                whole = xxhash.xxh3_64_intdigest
                ctx = [whole(joined[a : b + length], p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist())]
                begin = np.array([x[1] for x in portion], np.int64) - offsets
                place = ((at + begin[doc]) << (2 * _REACH)) | ((at - lo) << _REACH) | (hi + length - at)
                source = np.array([x[0] for x in portion], np.int64)[doc]
                ctx = np.array(ctx, np.uint64)
                # Periodic text repeats a context at every period; such a run is one row.
                same = (ctx[1:] == ctx[:-1]) & (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (lo[1:] <= hi[:-1] + length)
                first = np.flatnonzero(np.r_[True, ~same]) if len(ctx) else np.empty(0, np.int64)
                last = np.r_[first[1:], len(ctx)] - 1 if len(ctx) else first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[first].view(np.int64)), pa.array(ctx[first].view(np.int64)), keys.take(pa.array(source[first])), pa.array(place[first]), pa.array(at[last] - at[first]), pa.array(last - first + 1)],
                    ["h", "ctx", "row_key", "place", "extra", "n"],
                )

    return run


def _context_batches(length: int):
    """Texts with the places wanted of them, to contexts; large buckets give window hashes."""

    def run(batches):
        for batch in slices(batches):
            rows = {"h": [], "ctx": [], "before": [], "after": [], "window": [], "r": [], "n": []}
            size = 0
            for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                for w in wanted:
                    at, left, right = w["place"] >> (2 * _REACH), (w["place"] >> _REACH) & ((1 << _REACH) - 1), w["place"] & ((1 << _REACH) - 1)
                    if w["large"]:
                        for r in range(length - right, left + 1):
                            window = xxhash.xxh3_128_digest(text[at - r : at - r + length])
                            for k, v in (("h", w["h"]), ("ctx", w["ctx"]), ("before", None), ("after", None), ("window", window), ("r", r), ("n", w["n"])):
                                rows[k].append(v)
                    else:
                        for k, v in (("h", w["h"]), ("ctx", w["ctx"]), ("before", text[at - left : at][::-1]), ("after", text[at : at + right]), ("window", None), ("r", None), ("n", w["n"])):
                            rows[k].append(v)
                    size += length * 2
                if size > 8 << 20:
                    yield _context_batch(rows)
                    rows, size = {k: [] for k in rows}, 0
            yield _context_batch(rows)

    return run


_CONTEXT = "h long, ctx long, before binary, after binary, window binary, r int, n long"
_CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64())


def _context_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(rows, _CONTEXT_TYPES)], list(rows))


def _in_order(strings: list[bytes], known: int = 0) -> tuple[list[int], list[int]]:
    starts, ends, at = [], [], 0
    for s in strings:
        starts.append(at)
        at += len(s)
        ends.append(at)
    return deep_shallow_sort(b"".join(strings), starts, ends, known)


class _RangeMin:
    def __init__(self, values: list[int]):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            row, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append([min(row[i], row[i + half]) for i in range(len(row) - half)])

    def __call__(self, a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return min(self.rows[k][a], self.rows[k][b - (1 << k)])


def shared_reach(before: list[bytes], after: list[bytes], length: int, known: int = 0) -> tuple[list[int], list[int]]:
    """For each context the largest L and R over the others with L + R >= length; -1 if there are none.

    ``before`` holds reversed prefixes, ``after`` suffixes that agree on ``known`` bytes.
    """
    from bisect import bisect_left

    n = len(after)
    most_l, most_r = [-1] * n, [-1] * n
    order, lcp = _in_order(after, known)
    left_order, left_lcp = _in_order(before)
    rank = [0] * n
    for k, i in enumerate(left_order):
        rank[i] = k
    common = _RangeMin(left_lcp)
    parent = list(range(n))
    members: list[list[int] | None] = [[rank[order[k]]] for k in range(n)]  # sorted left ranks, by place in suffix order

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in sorted(range(1, n), key=lambda k: -lcp[k]):
        r = lcp[k]
        a, b = find(k - 1), find(k)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large = members[a]
        for x in members[b]:
            i = bisect_left(large, x)
            for y in large[max(0, i - 1) : i + 1]:
                both = common(min(x, y) + 1, max(x, y) + 1)
                if both + r >= length:
                    for c in (left_order[x], left_order[y]):
                        most_l[c], most_r[c] = max(most_l[c], both), max(most_r[c], r)
            large.insert(i, x)
        members[b], parent[b] = None, a
    return most_l, most_r


def _sort_batches(length: int):
    """Contexts, bucket after bucket, to (h, ctx, L, R) of those that share a window."""
    gram = _gram(length)

    def bucket(h, contexts, out):
        if len(contexts) < 2:
            return
        names = list(contexts)
        most_l, most_r = shared_reach([contexts[c][0] for c in names], [contexts[c][1] for c in names], length, gram)
        for c, left, right in zip(names, most_l, most_r):
            if left >= 0:
                out[0].append(h)
                out[1].append(c)
                out[2].append(left)
                out[3].append(right)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["h", "ctx", "reach_l", "reach_r"])

    def run(batches):
        now, contexts = None, {}
        for batch in batches:
            out = ([], [], [], [])
            for h, ctx, before, after in zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "before", "after"))):
                if h != now:
                    bucket(now, contexts, out)
                    now, contexts = h, {}
                contexts[ctx] = (before, after)
            yield batch_of(out)
        out = ([], [], [], [])
        bucket(now, contexts, out)
        yield batch_of(out)

    return run


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _merged(found: list[dict] | None, text: bytes = b"", words: int = 0) -> list[dict]:
    """Spans joined where they touch, in order; of these the ones that hold that many words, or parts of words."""
    runs: list[dict] = []
    for x in sorted(found or (), key=lambda x: x["b"]):
        if runs and x["b"] <= runs[-1]["e"]:
            runs[-1]["e"] = max(runs[-1]["e"], x["e"])
        else:
            runs.append({"b": x["b"], "e": x["e"]})
    return [x for x in runs if len(_WORD.findall(text, x["b"], x["e"])) >= words] if words else runs


_SPANS = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))


def _removal_batches(words: int, passage_words: int):
    def run(batches):
        for batch in slices(batches):
            kept, spans, passages = [], [], []
            for text, found, more in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist(), batch.column("more").to_pylist()):
                runs = _merged(found, text, words)
                edges = [0, *(v for x in runs for v in (x["b"], x["e"])), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append(runs)
                passages.append(_merged(more, text, passage_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(spans, _SPANS), pa.array(kept, pa.binary()), pa.array(passages, _SPANS)], ["doc_id", "row_key", "spans", "kept", "passages"]
            )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int = 0, large: int = LARGE, passage: tuple[int, int] | None = None) -> DataFrame:
    """Per row: doc_id, row_key, spans (array of b, e: byte offsets removed), kept (binary), passages.

    ``passages`` are the spans by another ``passage`` = (length, words), which are only told, not removed.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_or_empty(text_col).alias("text"))
    keyed = texts.select("row_key", "text")
    found = found_spans(keyed, length, large)
    more = found_spans(keyed, passage[0], large).withColumnRenamed("found", "more") if passage else found.select("row_key", F.lit(None).cast("array<struct<b:long,e:long>>").alias("more")).limit(0)
    both = texts.join(found, "row_key", "left").join(more, "row_key", "left").select("doc_id", "row_key", "text", "found", "more")
    kind = "array<struct<b:long,e:long>>"
    return both.mapInArrow(_removal_batches(words, passage[1] if passage else 0), f"doc_id long, row_key binary, spans {kind}, kept binary, passages {kind}")


def found_spans(keyed: DataFrame, length: int = 400, large: int = LARGE) -> DataFrame:
    """(row_key, found): spans of texts (row_key, text) to remove, not merged yet; rows without any are left out."""
    if not 2 <= length < 1 << (_REACH - 1):
        raise ValueError("length has to be from 2 to 2047")
    all_anchors = materialize(keyed.where(F.octet_length("text") >= length).mapInArrow(_anchor_batches(length), "h long, ctx long, row_key binary, place long, extra long, n long"), "anchors")
    # A table of its own, not an aggregate below the join: then a gram that fills a partition can be split there.
    buckets = all_anchors.groupBy("h").agg(F.sum("n").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("n > 1").select("h", (F.col("c0") != F.col("c1")).alias("mixed"))
    buckets = materialize(buckets, "buckets")
    met = materialize(all_anchors.join(buckets, "h"), "anchors-met")
    kinds = materialize(met.groupBy("h", "ctx", "mixed").agg(F.sum("n").alias("n"), F.min(F.struct("row_key", "place")).alias("rep")), "contexts")
    discard(all_anchors, buckets)

    mixed = kinds.where("mixed")
    sizes = materialize(mixed.groupBy("h").agg((F.count(F.lit(1)) > large).alias("large")), "bucket-sizes")
    wanted = mixed.join(sizes, "h").groupBy(F.col("rep.row_key").alias("row_key")).agg(F.collect_list(F.struct("h", "ctx", F.col("rep.place").alias("place"), "large", "n")).alias("wanted"))
    contexts = keyed.join(wanted, "row_key").select("text", "wanted").mapInArrow(_context_batches(length), _CONTEXT)
    contexts = materialize(contexts, "context-texts")
    sorted_ones = contexts.where("window is null").select("h", "ctx", "before", "after").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_batches(length), "h long, ctx long, reach_l int, reach_r int")
    windows = contexts.where("window is not null").select("h", "ctx", "window", "r", "n").distinct()
    again = windows.groupBy("h", "window", "r").agg(F.sum("n").alias("m")).where("m > 1").select("h", "window", "r")
    counted = windows.join(again, ["h", "window", "r"]).groupBy("h", "ctx").agg(F.max("r").cast("int").alias("reach_l"), (F.lit(length) - F.min("r")).cast("int").alias("reach_r"))

    reach_mask = (1 << _REACH) - 1
    before = F.shiftright("place", _REACH).bitwiseAND(F.lit(reach_mask))
    after = F.col("place").bitwiseAND(F.lit(reach_mask))
    at = F.shiftright("place", 2 * _REACH)
    copies = kinds.where("n > 1").select("h", "ctx", F.lit(reach_mask).alias("reach_l"), F.lit(reach_mask).alias("reach_r"))
    covered = materialize(sorted_ones.unionByName(counted).unionByName(copies).groupBy("h", "ctx").agg(F.max("reach_l").alias("reach_l"), F.max("reach_r").alias("reach_r")), "covered")
    discard(contexts, sizes, kinds)
    found = met.join(covered, ["h", "ctx"]).select("row_key", (at - F.least(before, F.col("reach_l"))).alias("b"), (at + F.least(after, F.col("reach_r")) + F.col("extra")).alias("e"))
    found = materialize(found.distinct().groupBy("row_key").agg(F.collect_list(F.struct("b", "e")).alias("found")), "found")
    discard(met, covered)
    return found


_SPACES = b" \t\n\v\f\r"


def _shrunk(text: bytes, b: int, e: int, words: bool) -> tuple[int, int]:
    """A span cut down to whole characters, or to whole words with white space between what is on both sides."""
    if words:
        while b < e and b and text[b] not in _SPACES and text[b - 1] not in _SPACES:
            b += 1
        while e > b and e < len(text) and text[e] not in _SPACES and text[e - 1] not in _SPACES:
            e -= 1
        if b < e and 0 < b and e < len(text) and text[b - 1] not in _SPACES and text[e] not in _SPACES:
            b += 1
    while b < e and text[b] & 0xC0 == 0x80:
        b += 1
    while e > b and e < len(text) and text[e] & 0xC0 == 0x80:
        e -= 1
    return b, e


def _whole_characters(text_col: str, words: int):
    """Texts without the spans, which are shrunk so that what stays is text again."""

    def run(batches):
        for batch in slices(batches):
            texts, out = batch.column(text_col).cast(pa.binary()).to_pylist(), []
            for text, spans in zip(texts, batch.column("_sv_spans").to_pylist()):
                parts, at = [], 0
                for x in _merged(spans, text, words):
                    b, e = _shrunk(text, x["b"], x["e"], words > 0)
                    parts.append(text[at:b])
                    at = e
                out.append(None if text is None else b"".join([*parts, text[at:]]).decode("utf-8", "replace"))
            names = [c for c in batch.schema.names if c != "_sv_spans"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in names], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut from its texts, of runs that hold at least so many words; other columns unchanged.

    A cut is shrunk to whole characters, or to whole words where ``words`` are
    asked for. Rows whose text is cut empty stay.
    """
    rows, ident, text = by_position(docs, id_col, text_col)
    keyed = rows.withColumn("_sv_key", row_key(ident, text))
    found = found_spans(keyed.select(F.col("_sv_key").alias("row_key"), text_or_empty(text).alias("text")), length)
    found = found.select(F.col("row_key").alias("_sv_key"), F.col("found").alias("_sv_spans"))
    return keyed.join(found, "_sv_key", "left").select(*rows.columns, "_sv_spans").mapInArrow(_whole_characters(text, words), rows.schema).toDF(*docs.columns)
