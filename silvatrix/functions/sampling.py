"""Exact-count draws and folds by the rank of a hash, without a sort.

The k-th least of many hashes is found by counting: a pass groups rows by the
next 16 bits of their hash, which tells the prefix that the k-th one has and its
rank there. As soon as few rows share the prefix they are looked at one by one.
What comes back to the driver is bounded: 65,536 counts a target, or
``FEW`` hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes of one prefix that are fetched.
FEW = 4096
_BITS = 16
_SIGN = -(1 << 63)


def hash_of(seed: int, *key: Column) -> Column:
    """A hash that differs where a single number as key differs."""
    return F.xxhash64(F.lit(seed), *key)


def _unsigned(x: int) -> int:
    return x - _SIGN


def kth_least(df: DataFrame, targets: list[tuple[Column, int]]) -> list[int]:
    """For each (column of hashes, k) the k-th least hash, counted from 1; the least number possible for k = 0."""
    at = df.select(*[F.col(c) if isinstance(c, str) else c.alias(f"h{i}") for i, (c, _) in enumerate(targets)])
    found = {i: _SIGN for i, (_, k) in enumerate(targets) if k < 1}
    open_ = {i: (0, k, 0) for i, (_, k) in enumerate(targets) if k >= 1}  # prefix, rank in it, bits of it
    few: dict[int, tuple[int, int, int]] = {}
    while open_:
        bits = next(iter(open_.values()))[2]
        key = {i: F.col(f"h{i}").bitwiseXOR(F.lit(_SIGN)) for i in open_}
        digit = lambda i: F.shiftrightunsigned(key[i], 64 - bits - _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))  # noqa: B023, E731
        same = lambda i: F.lit(True) if not bits else F.shiftrightunsigned(key[i], 64 - bits) == open_[i][0]  # noqa: B023, E731
        cells = F.array(*[F.when(same(i), F.struct(F.lit(i).alias("i"), digit(i).cast("int").alias("d"))) for i in open_])
        counts: dict[int, list] = {}
        for r in at.select(F.explode(cells).alias("c")).where("c IS NOT NULL").groupBy("c.i", "c.d").count().collect():  # 2^16 counts a target
            counts.setdefault(r["i"], []).append((r["d"], r["count"]))
        for i, (prefix, k, _) in list(open_.items()):
            for d, n in sorted(counts.get(i, [])):
                if k <= n:
                    break
                k -= n
            else:
                raise ValueError("fewer rows than asked for")
            to = (prefix << _BITS | d, k, bits + _BITS)
            del open_[i]
            if to[2] == 64:
                found[i] = to[0] + _SIGN
            elif n <= FEW:
                few[i] = to
            else:
                open_[i] = to
    if few:
        match = [(F.shiftrightunsigned(F.col(f"h{i}").bitwiseXOR(F.lit(_SIGN)), 64 - b) == p) for i, (p, _, b) in few.items()]
        cells = F.array(*[F.when(m, F.struct(F.lit(i).alias("i"), F.col(f"h{i}").alias("h"))) for i, m in zip(few, match)])
        hashes: dict[int, list[int]] = {}
        for r in at.select(F.explode(cells).alias("c")).where("c IS NOT NULL").select("c.i", "c.h").collect():  # FEW a target
            hashes.setdefault(r["i"], []).append(r["h"])
        for i, (_, k, _) in few.items():
            found[i] = sorted(hashes[i])[k - 1]
    return [found[i] for i in range(len(targets))]


def drawn(df: DataFrame, count: int, seed: int, *key: Column) -> DataFrame:
    """``count`` rows of ``df``, those with the least hashes of their distinct keys."""
    h = hash_of(seed, *key)
    (bound,) = kth_least(df, [(h, count)])
    return df.where(F.lit(False)) if count < 1 else df.where(h <= bound)


def fold_of(keys: DataFrame, key: str, folds: int, seed: int, rows: int) -> Column:
    """The fold of a key: of ``rows`` distinct keys, each fold takes rows div folds by the rank of their hash, and the last the rest."""
    h = hash_of(seed, F.col(key))
    ranks = [(h, rows // folds * j) for j in range(1, folds)]
    fold = F.lit(0)
    for bound in kth_least(keys, ranks):
        fold = fold + F.when(h > bound, 1).otherwise(0)
    return fold
