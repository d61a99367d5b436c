"""Media columns as interleaved document sequences.

A document is HTML whose media are referred to by digest, next to a store of
(digest, stored bytes). Parsing gives each document's ordered items: text
blocks and media references with their captions, each with its position. A
join on the digest resolves references to what the store holds, and the items
keep position and caption whatever order the join gives them in.

Payloads are stored losslessly as 8-bit grey PNG images of 64 samples a row;
``store_payloads`` pads them with zero bytes to whole rows. Features are
computed from the bytes read back from the store.

A digest that many documents share stands in each one's row (nothing is shuffled to
find that out), but its features are combined to one row before the join, and
both sides of the join are plain tables, so a hot digest can be split.

Defined results: null text = empty text = one row of zeros; an unresolved
reference keeps its item with null media columns; repeated rows and equal texts
each have their row, with equal values; pages of any depth and length are read;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, text_or_empty
from .html_tree import BLOCK, SPACE, Element, parse

ROW = 64
_PNG = b"\x89PNG\r\n\x1a\n"
_SKIP = frozenset("head script style noscript template".split())
_MEDIA = frozenset("img video audio embed object".split())


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8 bits a sample, ROW samples wide, unfiltered."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """Samples of an image that :func:`to_png` made; checks every chunk's sum."""
    if stored[:8] != _PNG:
        raise ValueError("no PNG")
    at, data, shape = 8, [], None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a chunk's check sum is wrong")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
            shape = height, width
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, variance and 16-bin histogram, from whole-number sums."""
    hist = np.bincount((samples >> 4).ravel(), minlength=16)
    total, squares, n = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum()), samples.size
    return f"{samples.shape[1]}x{samples.shape[0]} mean={total * 1000 // n} var={(squares * n - total * total) // (n * n)} hist={','.join(map(str, hist.tolist()))}"


# --- sequences -------------------------------------------------------------

SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string,n_bytes:bigint>>"


def _digest_of(e: Element) -> str | None:
    """The digest that a media element refers to; inline data give their own."""
    src = e.attrs.get("src") or e.attrs.get("data") or ""
    if src.startswith("sha256:"):
        return src[7:].lower()
    if src.startswith("data:") and "," in src:
        head, body = src.split(",", 1)
        try:
            return hashlib.sha256(base64.b64decode(body) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(body)).hexdigest()
        except ValueError:
            return None
    return e.attrs.get("data-sha256", "").lower() or None


def _whole_text(e: Element) -> str:
    found, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found.append(x)
        else:
            todo += reversed(x.items)
    return SPACE.sub(" ", "".join(found)).strip()


def interleave(source: str | None) -> list[dict]:
    """Ordered text and media items of a page. A figure's caption goes to its media, and is no text item."""
    items: list[dict] = []
    run: list[str] = []

    def add(kind: str, text=None, digest=None, caption=None, n_bytes=None):
        items.append({"position": len(items), "kind": kind, "text": text, "digest": digest, "caption": caption, "n_bytes": n_bytes})

    def flush():
        if text := SPACE.sub(" ", "".join(run)).strip():
            add("text", text)
        run.clear()

    todo: list = [("in", parse(source or ""), None)]
    while todo:
        kind, x, caption = todo.pop()
        if kind == "text":
            run.append(x)
        elif kind == "out":
            flush()
        elif x.tag in _SKIP or x.tag == "figcaption" and caption is not None:
            continue
        elif x.tag in _MEDIA:
            flush()
            size = x.attrs.get("data-bytes", "")
            add("media", None, _digest_of(x), caption or SPACE.sub(" ", x.attrs.get("alt", "")).strip() or None, int(size) if size.isdecimal() and len(size) < 19 else None)
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag == "figure":
                caption = next((_whole_text(y) for y in x.items if not isinstance(y, str) and y.tag == "figcaption"), None)
            if x.tag in BLOCK or not x.tag:
                flush()
                todo.append(("out", x, None))
            todo += [("text", y, None) if isinstance(y, str) else ("in", y, caption) for y in reversed(x.items)]
    return items


_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page id, row_key, items): each page's ordered items."""

    def run(batches):
        for batch in batches:
            items = pa.array([interleave(h) for h in batch.column("html").to_pylist()], _ITEM)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("row_key"), items], [id_col, "row_key", "items"])

    need = pages.select(F.col(id_col).cast("long").alias(id_col), row_key(id_col, html_col).alias("row_key"), F.col(html_col).cast("string").alias("html"))
    return need.mapInArrow(run, f"{id_col} long, row_key binary, items {SEQUENCE}")


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items, one a row, with the store's columns for their digest (which ``store`` has once)."""
    rest = [c for c in items.columns if c != "items"]
    return items.select(*rest, F.explode("items").alias("item")).select(*rest, "item.*").join(store, "digest", "left")


def regroup(resolved: DataFrame, by: list[str]) -> DataFrame:
    """One row a document again: its resolved items in order of position."""
    rest = [c for c in resolved.columns if c not in by and c != "position"]
    return resolved.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("position", *rest))).alias("items"))


# --- payload store -----------------------------------------------------------


def _store_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pages, digests, stored = [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                image = to_png(padded(text))
                digest = hashlib.sha256(image).hexdigest()
                caption = f"text of {len(text)} bytes"
                pages.append(f'<article><p>text</p><figure><img src="sha256:{digest}" data-bytes="{len(text)}"><figcaption>{caption}</figcaption></figure></article>')
                digests.append(digest)
                stored.append(image)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pages), pa.array(digests), pa.array(stored, pa.binary())], ["doc_id", "html", "digest", "media"])


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as stored media: (doc_id, html, digest, media), written to the shared folder.

    ``html`` is the interleaved document that refers to the medium.
    """
    need = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return materialize(need.mapInArrow(_store_batches, "doc_id long, html string, digest string, media binary"), "media-store")


def _read_back(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for stored in part.column("media").to_pylist():
                samples = from_png(stored)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("digest"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["digest", *names])


def store_features(store: DataFrame) -> DataFrame:
    """Features of each stored medium, read back: one row for a digest."""
    read = store.select("digest", "media").mapInArrow(_read_back, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    rest = [c for c in read.columns if c != "digest"]
    return materialize(read.groupBy("digest").agg(*[F.first(c).alias(c) for c in rest]), "media-features")
