"""Byte-level BPE encoding and decoding by merge replay over a word list.

Text is cut into words by the vocabulary's pattern. Encoding works on the
different words of many documents at once: an inverted index from token pair
to positions is built over all of them, then the merges are replayed in rank
order. A merge visits just the positions that the index gives for its pair,
joins them and enters the pairs that its neighbours now form. So every merge
is looked up once for a word list, not once for a word.

Workers remember the ids of words between batches, in a table of bounded
size. Decoding is a lookup of each id's bytes.

Defined results: null text = empty text = no ids; any text encodes, since
every byte has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Chunks that a worker remembers, in each of two generations.
REMEMBERED = 350_000
#: Ranks below this are replayed as arrays of positions, since there are many of each.
_COMMON = 1_000


class MergeTable:
    """Ranks of tokens, and for each pair of tokens that merges the rank of the result.

    ``pairs[left]`` gives the rank by the right token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.of_bytes = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        none: dict[int, int] = {}
        self.pairs = [none] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    if self.pairs[left] is none:
                        self.pairs[left] = {}
                    self.pairs[left][right] = rank
        known = [(left << 32 | right, rank) for left, by in enumerate(self.pairs) for right, rank in by.items()]
        self.pair_keys, self.pair_ranks = np.array([*sorted(known), (np.iinfo(np.int64).max, -1)], np.int64).T.copy()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each merge, -1 where a pair doesn't merge or one of it is no token."""
        keys = np.where(right >= 0, left << 32 | right, -1)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def merge_one(table: MergeTable, word: bytes) -> list[int]:
    """The ids of one word, merging the lowest rank first; what the replay amounts to."""
    ids = [table.of_byte[b] for b in word]
    while len(ids) > 1:
        best = min(((r, i) for i in range(len(ids) - 1) if (r := table.pairs[ids[i]].get(ids[i + 1])) is not None), default=None)
        if best is None:
            break
        ids[best[1] : best[1] + 2] = [best[0]]
    return ids


def _merge_common(table: MergeTable, entries: dict[int, list[np.ndarray]], ids: np.ndarray, now: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Replay the merges under ``_COMMON``: ids, the places after and before each, and those where a merge comes too late.

    ``now`` has the rank of the pair that begins at a position; ``entries`` keeps the merges that are left.
    """
    after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
    odd: list[int] = []
    heap = [r for r in entries if r < _COMMON]
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        i = np.unique(np.concatenate(entries.pop(rank)))
        i = i[now[i] == rank]
        if not len(i):
            continue
        j = after[i]
        over = np.r_[False, j[:-1] >= i[1:]]  # shares its left token with the pair before, as in a run of one letter
        if over.any():
            step = np.arange(len(i))
            even = (step - np.maximum.accumulate(np.where(over, 0, step))) % 2 == 0
            i, j = i[even], j[even]
        k = after[j]
        beside = np.r_[k[:-1] == i[1:], False]
        early = table.ranks_of(np.full(beside.sum(), rank), ids[k[beside]])  # until the pair beside it is merged too
        odd += i[beside][(early >= 0) & (early <= rank)].tolist()
        ids[i], ids[j], now[j] = rank, -2, -1
        after[i], before[k] = k, i
        p = before[i]
        at = np.concatenate([i, p[ids[p] >= 0]])
        ranks = now[at] = table.ranks_of(ids[at], ids[after[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        odd += at[ranks <= rank].tolist()
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]][: len(ranks)]).tolist()
        for r, a, b in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(at)]):
            if r in entries:
                entries[r].append(at[a:b])
            else:
                entries[r] = [at[a:b]]
                if r < _COMMON:
                    heapq.heappush(heap, r)
    return ids.tolist(), after.tolist(), before.tolist(), odd


def replay_merges(table: MergeTable, words: list[bytes]) -> list[list[int]]:
    """The ids of each word."""
    return [np.frombuffer(x, "<u4").tolist() for x in packed_ids(table, words)]


def packed_ids(table: MergeTable, words: list[bytes]) -> list[bytes]:
    """The ids of each word, four bytes each, by replaying the merges over all words at once.

    Words lie one after another with a fence (-1) behind each, which no merge
    crosses; a position that was merged away holds -2. Bytes, their first
    pairs and the merges of common ranks go by arrays of positions, later
    merges by single positions.
    """
    pairs = table.pairs
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes
    data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    first = np.array(table.of_byte)[data]
    first[0] = first[ends] = -1
    ranks = np.where((first[:-1] >= 0) & (first[1:] >= 0), table.of_bytes[data[:-1] * 256 + data[1:]], -1)
    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    different, cuts = np.unique(ranks[at], return_index=True)
    entries = {r: [x] for r, x in zip(different.tolist(), np.split(at, cuts[1:]))}
    ids, after, before, odd = _merge_common(table, entries, first, np.r_[ranks, -1])
    index = {r: np.concatenate(x).tolist() for r, x in entries.items()}
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        for i in sorted(index.pop(rank)):
            j = after[i]
            if ids[i] < 0 or pairs[ids[i]].get(ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -2
            k = after[i] = after[j]
            before[k] = i
            right = ids[k]
            if right >= 0 and (r := pairs[rank].get(right)) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heapq.heappush(heap, r)
                if r <= rank:
                    odd.append(i)
            p = before[i]
            left = ids[p]
            if left >= 0 and (r := pairs[left].get(rank)) is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)
                if r <= rank:
                    odd.append(p)
    last = np.array(ids, np.int64)
    held = np.r_[0, np.cumsum(last >= 0)] * 4
    packed = last[last >= 0].astype("<u4").tobytes()
    out = [packed[a:b] for a, b in zip(held[begins].tolist(), held[ends].tolist())]
    for i in odd:  # a table that ranks a later merge earlier; such a word is merged by itself
        k = int(np.searchsorted(begins, i, "right")) - 1
        out[k] = np.array(merge_one(table, words[k]), "<u4").tobytes()
    return out


class ByteTokenizer:
    def __init__(self, path: str, pattern: str):
        import regex

        self.table = MergeTable.load(path)
        self.find = regex.compile(pattern).findall
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.bytes_of = self.table.bytes_of
        self.digits = {r: str(r) for r in self.bytes_of}

    def _chunks(self, text: str) -> list[str]:
        """Chunks that the pattern cuts as it would cut them in the text.

        With single spaces and line ends between words only, each chunk is a
        word with the space or line end before it; else the text is one chunk.
        The space is left off; a chunk without one before it, but not a line
        end, is marked by ``\\r``, which no such text contains.
        """
        if not text:
            return []
        spaced = text.replace("\n", " ")
        words = spaced.split()
        if " ".join(words) != spaced:
            return ["\r" + text]
        if "\n" in text:
            words = text.replace("\n", " \n").split(" ")
        words[0] = "\r" + words[0]
        return words

    def _learn(self, chunks) -> dict[str, bytes]:
        """Ids of chunks that aren't remembered."""
        old = self.old
        known = {c: old[c] for c in chunks if c in old}
        new = [c for c in chunks if c not in known]
        found = [self.find(c[1:] if c[0] == "\r" else c if c[0] == "\n" else " " + c) for c in new]
        words = self.words
        if len(words) > REMEMBERED:
            words = self.words = {}
        ask = [w for w in set().union(*found) if w not in words]
        coded = [w.encode() for w in ask]
        ranks = self.table.ranks
        parted = []
        for w, b in zip(ask, coded):
            if (r := ranks.get(b)) is None:
                parted.append((w, b))
            else:
                words[w] = r.to_bytes(4, "little")
        words.update(zip([w for w, _ in parted], packed_ids(self.table, [b for _, b in parted])))
        for c, ws in zip(new, found):
            known[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        return known

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._chunks(t) for t in texts]
        missing = set().union(*split) - self.now.keys()
        if len(self.now) + len(missing) > REMEMBERED:
            self.old, self.now = self.now, {}
            missing = set().union(*split)
        self.now |= self._learn(missing)
        return [np.frombuffer(b"".join(map(self.now.__getitem__, parts)), "<u4") for parts in split]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _portions(texts: list[str], size: int = 2 << 20):
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i == len(texts) - 1:
            yield begin, texts[begin : i + 1]
            begin, total = i + 1, 0


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""
    path, pattern = _defaults(vocabulary, pattern)

    def run(batches):
        tok = _tokenizer(path, pattern)
        for batch in slices(batches, 2048):
            for at, texts in _portions(batch.column("text").to_pylist()):
                ids = pa.array([x.astype(np.int32) for x in tok.encode_batch(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = _defaults(vocabulary, pattern)

    def run(batches):
        tok = _tokenizer(path, pattern)
        for batch in slices(batches, 2048):
            for at, texts in _portions(batch.column("text").to_pylist()):
                rows = []
                for ids in tok.encode_batch(texts):
                    ids = ids.tolist()
                    rows.append((len(ids), hashlib.sha256(" ".join(map(tok.digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids)).hexdigest()))
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
