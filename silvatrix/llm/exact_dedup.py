"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every normalised text and records in a blocked Bloom filter
which slots are hit by two rows or more. Pass two probes that filter: a row
with a slot of its own cannot have a copy and passes straight through; only
the rest shuffle, grouped by the SHA-256 of the normalised text.

The filter grows with the rows, 16 slots for each, as a table of blocks of 4 KB.
Up to ``max_filter_bytes`` of blocks are broadcast to the rows. Beyond that a
hash and the place of its row (24 bytes) meet the blocks in a shuffle, and what
may be repeated comes back as bitmaps of places: a bit a row, a block of 4 KB for
32,768 rows of a file. Files are dealt by a hash into groups of some
``max_bitmap_bytes``, each scanned once with its bitmaps broadcast, so other
columns are in no shuffle. Only a group of over twice that size (a single file of
a billion rows, by the default) is joined as Spark sees fit. A place is a file of a stored table and the number of the row in
it, so a task that runs again finds the same.

:func:`keep_first_copies` brings the rows that go back to whole rows in the same
way, as bitmaps of places: texts are shuffled in that one case only, and the SHA-256 is made once.

Defined results: null text = empty text; of rows with equal text the smallest
doc_id stays, null ids last, and of repeated rows exactly one; an empty table
gives an empty result; extra columns, whatever their names, pass. Texts are
hashed whole, one at a time, whatever their length. Files are told apart by 64
bits of a hash of their paths (a million files share one with a chance of 3 in
100 million).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, materialize, row_key, text_or_empty

#: Bits of a block: what bitmap_construct_agg makes.
BLOCK_BITS = 32768
BLOCK_BYTES = BLOCK_BITS // 8
SLOTS_PER_ROW = 16
MAX_FILTER_BYTES = 8 << 20
MAX_BITMAP_BYTES = 64 << 20
PLACE = ["_sv_file", "_sv_row"]


def normalised(text_col: str = "text") -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")


def _filter_blocks(rows: int) -> int:
    """Blocks of the filter: a power of two, as many as the bits of a hash that the slots don't use can tell apart."""
    blocks = 1
    while blocks * BLOCK_BITS < rows * SLOTS_PER_ROW and blocks < 1 << 24:
        blocks *= 2
    return blocks


def _slots(blocks: int) -> dict[str, Column]:
    """Block and two positions in it, from separate bits of the row's hash."""
    h = F.col("h")
    return {
        "block": F.pmod(h, F.lit(blocks)).cast("long"),
        "bit1": F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(BLOCK_BITS - 1)),
        "bit2": F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(BLOCK_BITS - 1)),
    }


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(F.lit(1 << i)) > 0 for i in range(8)]), (bit % 8).cast("int"))


def repeated_slots(rows: DataFrame, blocks: int) -> DataFrame:
    """Pass one: (block, bitmap) of the slots that at least two rows hit."""
    hits = rows.select(*[c.alias(k) for k, c in _slots(blocks).items()]).select(
        "block", F.explode(F.array_distinct(F.array("bit1", "bit2"))).alias("bit")
    )
    twice = hits.groupBy("block", "bit").count().where("count > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _maybe(rows: DataFrame, blocks: int, bitmaps: DataFrame, sent: bool) -> DataFrame:
    """``rows`` with _sv_maybe: whether the filter, broadcast or not, says that their hash may be repeated."""
    at = bitmaps.select(F.col("block").alias("_sv_block"), F.col("bitmap").alias("_sv_bitmap"))
    probed = rows.withColumns({f"_sv_{k}": c for k, c in _slots(blocks).items()}).join(F.broadcast(at) if sent else at, "_sv_block", "left")
    both = _is_set(F.col("_sv_bitmap"), F.col("_sv_bit1")) & _is_set(F.col("_sv_bitmap"), F.col("_sv_bit2"))
    return probed.withColumn("_sv_maybe", F.coalesce(both, F.lit(False))).drop("_sv_block", "_sv_bit1", "_sv_bit2", "_sv_bitmap")


def _placed(stored: DataFrame) -> DataFrame:
    """A stored table with the place of each row."""
    return stored.select("*", F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def _marked(placed: DataFrame, places: DataFrame, max_bitmap_bytes: int) -> DataFrame:
    """``placed`` with _sv_maybe: whether a row's place is among ``places``, which alone are shuffled."""
    block, bit = F.floor(F.col("_sv_row") / BLOCK_BITS).alias("_sv_block"), (F.col("_sv_row") % BLOCK_BITS).alias("_sv_bit")
    bitmaps = materialize(places.select("_sv_file", block, bit).groupBy("_sv_file", "_sv_block").agg(F.bitmap_construct_agg("_sv_bit").alias("_sv_bitmap")), "exact-places")
    groups = max(1, -(-bitmaps.count() * BLOCK_BYTES // max(max_bitmap_bytes, BLOCK_BYTES)))
    group = F.pmod("_sv_file", F.lit(groups))
    sizes = dict(bitmaps.groupBy(group).count().collect())  # a row a group
    out = None
    for g in range(groups):
        part, marks = (t.where(group == g) for t in (placed, bitmaps))
        if sizes.get(g, 0) * BLOCK_BYTES <= 2 * max_bitmap_bytes:  # files of uneven sizes; a single one beyond that is joined as Spark sees fit
            marks = F.broadcast(marks)
        found = part.withColumns({"_sv_block": block, "_sv_bit": bit}).join(marks, ["_sv_file", "_sv_block"], "left")
        found = found.withColumn("_sv_maybe", F.coalesce(_is_set(F.col("_sv_bitmap"), F.col("_sv_bit")), F.lit(False))).drop("_sv_block", "_sv_bit", "_sv_bitmap")
        if groups > 1:  # one after the other, so that the driver holds the bitmaps of one group
            found = materialize(found, "exact-marked")
        out = found if out is None else out.unionByName(found)
    return out


def _hashes(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            *more,
            F.unhex(F.sha2(normalised(text_col), 256)).alias("sha"),
        ).select("*", F.monotonically_increasing_id().alias("rid"), F.xxhash64("sha").alias("h")),
        "exact-hashes",
    )


def _probed(rows: DataFrame, max_filter_bytes: int, max_bitmap_bytes: int) -> DataFrame:
    """Both passes over stored hashes: ``rows`` with _sv_maybe."""
    blocks = _filter_blocks(rows.count())
    bitmaps = materialize(repeated_slots(rows, blocks), "exact-filter")
    if blocks * BLOCK_BYTES <= max_filter_bytes:
        return _maybe(rows, blocks, bitmaps, True)
    placed = _placed(rows)
    places = _maybe(placed.select("h", *PLACE), blocks, bitmaps, False).where("_sv_maybe").select(PLACE)
    return _marked(placed, places, max_bitmap_bytes).drop(*PLACE)


def _judged(probed: DataFrame, *more: str) -> DataFrame:
    """What may be repeated, with keep_id, group_size, kept and text_sha256."""
    candidates = probed.where("_sv_maybe").select("doc_id", *more, "sha", "rid")
    # The group table is combined before its shuffle: a group of any size costs one row a task.
    groups = candidates.groupBy("sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"),
    )
    # As a table of its own, the group side lets the join split a hot group.
    return candidates.join(materialize(groups, "exact-groups"), "sha").select(
        "doc_id",
        *more,
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, max_bitmap_bytes: int = MAX_BITMAP_BYTES) -> DataFrame:
    """Per row: doc_id, row_key, keep_id, group_size, kept, text_sha256 (binary)."""
    probed = _probed(_hashes(docs, id_col, text_col, row_key(id_col, text_col).alias("row_key")), max_filter_bytes, max_bitmap_bytes)
    passed = probed.where("not _sv_maybe").select(
        "doc_id", "row_key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return passed.unionByName(_judged(probed, "row_key"))


def keep_first_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, max_bitmap_bytes: int = MAX_BITMAP_BYTES, stored: bool = False
) -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; columns unchanged.

    ``stored``: docs is a table of files as read, so its rows have places;
    anything else is stored first.
    """
    names = docs.columns
    by_place, id_col, text_col = by_position(docs, id_col, text_col)
    columns = by_place.columns
    try:
        placed = (_placed(docs) if stored else _placed(materialize(by_place, "exact-rows"))).toDF(*columns, *PLACE)
    except AnalysisException:  # no table of files after all
        placed = _placed(materialize(by_place, "exact-rows"))
    rows = _hashes(placed, id_col, text_col, *(F.col(c).alias(f"at{c}") for c in PLACE))
    losers = _judged(_probed(rows, max_filter_bytes, max_bitmap_bytes), *(f"at{c}" for c in PLACE)).where("not kept")
    marked = _marked(placed, losers.select(*(F.col(f"at{c}").alias(c) for c in PLACE)), max_bitmap_bytes)
    return marked.where("not _sv_maybe").select(columns).toDF(*names)
