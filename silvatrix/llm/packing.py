"""Packing of token sequences by first-fit decreasing in randomised groups.

Documents are tokenised with a vocabulary of the ``tokenizers`` library and
closed with an end id. A document is cut into whole sequences and a rest; the
whole ones are full as they are, and only rests are packed. Each group packs
its rests, longest first, into the first sequence with room for it, which a
tournament tree over the sequences' free room finds in logarithmic time.

A rest's group is a hash of its row and a seed, so groups are of even size
whatever the keys, and each is packed by itself: no step sees all documents.
Whole sequences take no part in it, so long documents make no group larger.

Defined results: null text = empty text, which is the end id alone; repeated
rows are packed each; ties of length go by row; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, slices, text_or_empty

SEQUENCE = 2048
END_ID = 1
#: Rests of a group, about.
GROUP_ROWS = 4096
#: Whole sequences are numbered from here, above any group's.
FULL_FROM = 1 << 62
#: Chunks that a worker remembers the ids of, in each of two generations.
REMEMBERED = 400_000

#: How the vocabulary's file says that text is split (white space falls away).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below U+0250, lower-casing and composition agree with the library's; other text takes the library's own normaliser.
_OTHER = re.compile("[^\x00-ɏ -⁯]|İ")


class _Generations(dict):
    """What ``learn`` gives for a key; a full dict becomes the older one, which keys in use are taken over from."""

    def __init__(self, learn, most: int):
        super().__init__()
        self.learn, self.most, self.older = learn, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.learn(key)
        if len(self) >= self.most:
            self.older = self.copy()
            self.clear()
        self[key] = found
        return found


class WordTokenizer:
    """Ids of texts, by chunks between white space, which no token crosses."""

    def __init__(self, path: str, special_as_text: bool = False, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = {} if special_as_text else {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = {t: i.to_bytes(4, "little") for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find = regex.compile(_PIECES).findall
        self.bytes_as = self._byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.known = _Generations(self._chunk, remembered)
        self.pieces = _Generations(self._piece, remembered // 4)

    @staticmethod
    def _byte_letters() -> list[str]:
        """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        return [chr(b if b in shown else next(rest)) for b in range(256)]

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else "".join([self.bytes_as[b] for b in piece.encode()])
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.tok.model.tokenize(letters)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._piece(chunk)
        if chunk[0] == " ":
            return self.special[chunk[1:]]
        return b"".join([self.pieces[p] for p in self.find(chunk)])

    def chunks(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif _OTHER.search(text):
            text = self.tok.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        # str.split also parts at the separators 1C to 1F, which are not white space to the library.
        return re.split(r"[ \t-\r\x85\xa0  -     　]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _parts(self, text: str) -> list[str]:
        """Chunks of a text; a special token in it is a chunk of its own, marked by white space before it."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.chunks(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [" " + part] if k % 2 else self.chunks(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, self._parts(t))), "<u4") for t in texts]


@lru_cache(maxsize=1)
def _tokenizer(path: str, special_as_text: bool, remembered: int) -> WordTokenizer:
    return WordTokenizer(path, special_as_text, remembered)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _portions(texts: list[str], size: int = 2 << 20):
    """Runs of texts of about ``size`` characters."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i == len(texts) - 1:
            yield texts[begin : i + 1]
            begin, total = i + 1, 0


def _piece_batches(path: str, keep_ids: bool, special_as_text: bool, remembered: int):
    def run(batches):
        tok = _tokenizer(path, special_as_text, remembered)
        for batch in slices(batches, 2048):
            at = 0
            for texts in _portions(batch.column("text").to_pylist()):
                rows: dict[str, list] = {k: [] for k in ("source", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for k, ids in enumerate(tok.encode_batch(texts)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), SEQUENCE):
                        piece = ids[start : start + SEQUENCE]
                        for name, v in zip(rows, (at + k, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32) if keep_ids else None)):
                            rows[name].append(v)
                at += len(texts)
                source = pa.array(rows.pop("source"), pa.int64())
                ids = rows.pop("ids")
                cols = [batch.column("doc_id").take(source), batch.column("row_key").take(source), *(pa.array(v, pa.int64()) for v in rows.values())]
                names = ["doc_id", "row_key", *rows]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


class FreeRoom:
    """Tournament tree over bins' free room: the winner of a match is the larger."""

    def __init__(self, bins: int, capacity: int):
        self.tips = 1
        while self.tips < bins:
            self.tips *= 2
        self.room = [capacity] * (2 * self.tips)

    def first_with(self, size: int) -> int:
        node = 1
        while node < self.tips:
            node *= 2
            if self.room[node] < size:
                node += 1
        return node - self.tips

    def take(self, bin_: int, size: int) -> int:
        """Put ``size`` into the bin; the room that was free before."""
        node = bin_ + self.tips
        before = self.room[node]
        self.room[node] = before - size
        while node > 1:
            node //= 2
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        return before


def first_fit_decreasing(sizes, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each size; the order of equal sizes is kept."""
    sizes = np.asarray(sizes, np.int64)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = FreeRoom(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        bins[i] = b = tree.first_with(size)
        offsets[i] = capacity - tree.take(b, size)
    return bins, offsets


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["row_key", "start"], kind="stable").reset_index(drop=True)
    bins, offsets = first_fit_decreasing(rows["length"].to_numpy())
    rows["sequence_id"] = (rows["group"].to_numpy() << 32) | bins
    rows["offset"] = offsets
    return rows.drop(columns=["group", "row_key"])


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, seed: int = 17, special_as_text: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and its ids if asked for.

    The strings of special tokens are these tokens, as the library has it by
    default, or ordinary text with ``special_as_text``. A worker remembers up to
    twice ``remembered`` chunks from task to task, some 200 bytes each.
    """
    vocabulary = vocabulary or default_vocabulary()
    need = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_or_empty(text_col).alias("text"))
    kind = "doc_id long, row_key binary, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    pieces = materialize(need.mapInArrow(_piece_batches(vocabulary, keep_ids, special_as_text, remembered), kind), "pieces")
    rests = pieces.where(F.col("length") < SEQUENCE)
    groups = max(1, -(-rests.count() // GROUP_ROWS))
    grouped = rests.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row_key", "start"), F.lit(groups)))
    out = kind.replace("row_key binary, ", "") + ", sequence_id long, offset long"
    packed = grouped.groupBy("group").applyInPandas(_pack_group, out)
    full = pieces.where(F.col("length") == SEQUENCE).drop("row_key")
    return packed.unionByName(full.withColumns({"sequence_id": F.lit(FULL_FROM) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}))
