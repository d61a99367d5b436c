"""Split search as relational plans: histogram, running sums, arg-max.

A histogram is ``GROUP BY node, feature, position`` over exploded features,
combined before its shuffle, so what moves is nodes x features x positions
rows and not the data. Candidates are running sums over positions; the best
split of each node is a row number over (gain, feature, threshold), which
settles ties the same way however rows were dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scoring import _iter_udf, matrix, number
from .dense import CODES


def cut_points(df: DataFrame, features: list[str], max_bin: int = 256) -> dict[str, list[float]]:
    """Upper bounds of bins: midpoints of distinct values if they are few, else equal widths.

    NaN takes no part. Distinct values are collected only of features that
    have at most ``max_bin``, after an approximate count says they are few.
    """
    cols = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    stats = df.agg(*[x for i, c in enumerate(cols.values()) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.approx_count_distinct(c, 0.02).alias(f"n{i}"))]).first()
    few = [i for i in range(len(features)) if stats[f"n{i}"] <= max_bin * 1.2]
    sets = df.agg(*[F.sort_array(F.collect_set(cols[features[i]])).alias(f"v{i}") for i in few]).first() if few else {}
    cuts = {}
    for i, f in enumerate(features):
        lo, hi = stats[f"lo{i}"], stats[f"hi{i}"]
        if lo is None or lo == hi:
            cuts[f] = []
        elif i in few and len(sets[f"v{i}"]) <= max_bin:
            v = sets[f"v{i}"]
            cuts[f] = [(a + b) / 2 for a, b in zip(v, v[1:])]
        else:
            cuts[f] = [lo + (hi - lo) * k / max_bin for k in range(1, max_bin)]
    return cuts


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of the first cut that the value does not exceed; the last bin for NaN."""
    if not cuts:
        return F.lit(0)
    ends = F.array(*[F.lit(c) for c in cuts])
    return F.size(F.filter(ends, lambda c: c < value))


def bin_array(features: list[str], cuts: dict[str, list[float]], categorical: tuple[int, ...] = ()) -> Column:
    """array<int>: :func:`bin_of` of all features at once, by binary search in Arrow batches; of categorical ones the code, if it can be split off."""
    ends = [np.array(cuts[f], float) for f in features]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = matrix([part[c] for c in part])
            bins = np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(ends)]).astype(np.int32)
            for i in categorical:
                v = x[:, i]
                bins[:, i] = np.where((v >= 0) & (v < CODES) & (v == np.floor(v)), v, CODES)
            yield pd.Series(list(bins))

    return _iter_udf(run, "array<int>")(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]))


def bin_sql(value: str, cuts: list[float]) -> str:
    """The same as SQL text: how many cuts lie below the value."""
    return f"len([c for c in [{', '.join(number(c) for c in cuts)}] if c < {value}])" if cuts else "0"


def histogram(df: DataFrame, node: str, features: dict[str, Column], grad: str = "grad", hess: str = "hess") -> DataFrame:
    """(node, feature, pos, g, h, n) over the positions of each feature."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), c.alias("pos")) for i, c in enumerate(features.values())])
    return df.select(F.col(node).alias("node"), F.col(grad).alias("g"), F.col(hess).alias("h"), F.explode(cells).alias("c")).groupBy("node", F.col("c.feature").alias("feature"), F.col("c.pos").alias("pos")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


def gain_of(gl: Column, hl: Column, g: Column, h: Column, lam: float) -> Column:
    gr, hr = g - gl, h - hl
    score = lambda a, b: a * a / (b + lam)
    return F.when((hl > 0) & (hr > 0), (score(gl, hl) + score(gr, hr) - score(g, h)) * 0.5).otherwise(0.0)


def candidates(hist: DataFrame, threshold: Column, lam: float, missing: Column | None = None) -> DataFrame:
    """Each position of a histogram as a split ``<= threshold``: gl, hl, g, h, gain.

    ``missing`` marks positions that hold missing values: they stay right.
    """
    by = Window.partitionBy("node", "feature")
    upto = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = hist.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "G": F.sum("g").over(by), "H": F.sum("h").over(by), "threshold": threshold})
    at = at.where(F.col("threshold").isNotNull() if missing is None else F.col("threshold").isNotNull() & ~missing)
    return at.withColumn("gain", gain_of(F.col("gl"), F.col("hl"), F.col("G"), F.col("H"), lam))


def next_midpoint() -> Column:
    """Threshold between a value and the next of its node and feature; none for the last and for NaN."""
    nxt = F.lead("pos").over(Window.partitionBy("node", "feature").orderBy("pos"))
    return F.when(nxt.isNotNull() & ~F.isnan(nxt), (F.col("pos") + nxt) / 2)


def one_against_rest(hist: DataFrame, lam: float, codes: int = CODES) -> DataFrame:
    """Categorical candidates: a code against all others, for codes from 0 below ``codes``."""
    by = Window.partitionBy("node", "feature")
    at = hist.withColumns({"gl": F.col("g"), "hl": F.col("h"), "G": F.sum("g").over(by), "H": F.sum("h").over(by), "threshold": F.col("pos").cast("double")})
    return at.where((F.col("pos") >= 0) & (F.col("pos") < codes)).withColumn("gain", gain_of(F.col("gl"), F.col("hl"), F.col("G"), F.col("H"), lam))


def keeps_order(direction: dict[int, int], lam: float) -> Column:
    """Whether the children's values follow the feature's monotone direction."""
    left = -F.col("gl") / (F.col("hl") + lam)
    right = -(F.col("G") - F.col("gl")) / (F.col("H") - F.col("hl") + lam)
    ok = F.lit(True)
    for feature, sign in direction.items():
        if sign:
            ok = ok & ((F.col("feature") != feature) | (left <= right if sign > 0 else left >= right))
    return ok


def best_splits(found: DataFrame, gamma: float = 0.0, monotone: dict[int, int] | None = None, lam: float = 0.0, after_best: bool = False) -> DataFrame:
    """The best candidate of each node: gain, then feature, then threshold.

    Monotone directions reject single candidates, or with ``after_best`` only a
    feature's best one.
    """
    if monotone and after_best:
        w = Window.partitionBy("node", "feature").orderBy(F.col("gain").desc(), "threshold")
        found = found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    if monotone:
        found = found.where(keeps_order(monotone, lam))
    w = Window.partitionBy("node").orderBy(F.col("gain").desc(), "feature", "threshold")
    return found.where(F.col("gain") > gamma).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
