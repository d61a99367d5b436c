"""SimHash near-duplicates by segment-popcount embedding and a grid range join.

A fingerprint is embedded by the number of ones in each of its 32 two-bit
segments, a point of {0,1,2}^32. The Manhattan distance of two such points
never exceeds the Hamming distance of the fingerprints, so a range join of the
points at that distance misses no link. The counts are kept in thermometer
code, two bits a segment, in which the Manhattan distance is the bit count of
an exclusive or.

The grid: the segments form six runs. With a distance of three or less at
least three of the six show no difference, so two points in range share the
cell of at least one of the 20 projections on three runs. Candidates of a cell
are held against the Manhattan bound, then verified exactly on the bits.

Only distinct fingerprints take part: a group of copies of any size is one
point, and rows get their component from their fingerprint.

Defined results: null text = empty text = fingerprint zero; rows with equal
fingerprints are linked; a component is named by its smallest non-null doc_id;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, materialize, row_key, slices, text_or_empty
from .components import connected_components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)
#: Segments of each run of the grid; two bits a segment.
_RUNS = (6, 6, 5, 5, 5, 5)


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words: of all of them."""
    found = _WORD.findall(text.translate(_LOWER))
    if not found:
        return np.empty(0, ">u8")
    line = b" ".join(found)
    ends = list(itertools.accumulate([len(w) + 1 for w in found]))
    starts = [0, *ends]
    ends = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a : b - 1], seed) for a, b in zip(starts, ends)]), ">u8")


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes lie one after another, ``counts[i]`` for document i.

    A bit is set if over half of the hashes have it. Eight counters share a
    64-bit lane, so sums are cut after at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    hashes = hashes.astype(np.uint64)
    ends = np.cumsum(counts)
    pieces = (counts[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.cumsum(pieces) - pieces
    cuts = (ends[full] - counts[full])[owner] + 255 * (np.arange(len(owner)) - first[owner])
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        won = ones * 2 > counts[full][:, None]
        for byte in range(8):
            out[full] |= won[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _fingerprint_batches(batches):
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        prints, hashes, counts, size = [], [], [], 0
        for i, text in enumerate(texts):
            h = shingle_hashes(text or b"")
            hashes.append(h)
            counts.append(len(h))
            size += len(h)
            if size > 1_000_000 or i == len(texts) - 1:
                prints.append(majority_bits(np.concatenate(hashes), np.array(counts, np.int64)))
                hashes, counts, size = [], [], 0
        bits = np.concatenate(prints).view(np.int64) if prints else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(bits)], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp): the 64 bits as a signed long."""
    need = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_or_empty(text_col).alias("text"))
    return need.mapInArrow(_fingerprint_batches, "doc_id long, row_key binary, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def thermometer(fp: Column) -> Column:
    """Ones of each two-bit segment: the low bit says at least one, the high bit two."""
    low = F.lit(_signed(0x5555555555555555))
    nxt = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(nxt).bitwiseAND(low)
    both = fp.bitwiseAND(nxt).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(sizes: tuple[int, ...] = _RUNS, distance: int = 3) -> list[int]:
    """The projections of the grid: of ``sizes`` runs, all but ``distance`` at least show no difference within that distance."""
    edge = [0, *itertools.accumulate(sizes)]
    runs = [sum(3 << (2 * s) for s in range(edge[i], edge[i + 1])) for i in range(len(sizes))]
    return [_signed(sum(x)) for x in itertools.combinations(runs, len(sizes) - distance)]


def near_links(points: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (u < v) of the distinct ``fp`` that differ in at most ``distance`` (3 at most) bits."""
    if distance > 3:
        raise ValueError("the grid of three equal runs of six holds for a distance of up to 3")
    at = points.select("fp", thermometer(F.col("fp")).alias("t"))
    cells = [F.struct(F.lit(i).alias("grid"), F.col("t").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks())]
    placed = at.select("fp", "t", F.explode(F.array(*cells)).alias("c")).select("fp", "t", "c.grid", "c.cell")
    a, b = placed.alias("a"), placed.alias("b")
    near = (F.bit_count(F.col("a.t").bitwiseXOR(F.col("b.t"))) <= distance) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    met = a.join(b, (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & near)
    return met.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """Per row: doc_id, row_key, fp, component_id."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = connected_components(near_links(points, distance))
    rooted = points.join(roots, points.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = materialize(rooted.join(named, "root").select("fp", "component_id"), "point-components")
    return rows.join(of_point, "fp").select("doc_id", "row_key", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; columns unchanged.

    Rows of a component that share its smallest doc_id all stay, and so do
    those with a null id where a component has no other.
    """
    rows, ident, text = by_position(docs, id_col, text_col)
    losers = near_duplicates(rows, ident, text).where("not (doc_id <=> component_id)").select(F.col("row_key").alias("_sv_key")).distinct()
    return rows.withColumn("_sv_key", row_key(ident, text)).join(materialize(losers, "near-losers"), "_sv_key", "left_anti").drop("_sv_key").toDF(*docs.columns)
