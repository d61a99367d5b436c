"""Scoring: a model and feature columns to margins, values, tips or contributions.

Two strategies give the same numbers. A handful of small trees becomes one
nested CASE expression, which stays in generated code. More trees are walked
by numpy in Arrow batches, one level of a tree at a time for all rows of a
batch; nested CASE gets slower than that from about ten trees on and, for deep
forests, outgrows the limits of generated code. Scoring is a projection: no
shuffle, and partitions take the place of threads.

NULL features are taken as NaN, the one representation of a missing value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import transforms
from ..plans.model import ZERO, Forest, Linear, Tree

#: Tips up to which the CASE strategy is chosen.
CASE_TIPS = 64


def number(x: float) -> str:
    """A double literal that Spark and DuckDB read alike."""
    return f"CAST('{x!r}' AS DOUBLE)" if np.isfinite(x) else f"CAST('{'NaN' if x != x else 'Infinity' if x > 0 else '-Infinity'}' AS DOUBLE)"


# --- SQL text of trees ---------------------------------------------------------


def goes_left_sql(t: Tree, j: int, cols: list[str]) -> str:
    if t.feature[j] >= len(cols):
        return "FALSE"
    f = f"coalesce({cols[t.feature[j]]}, {number(float('nan'))})"
    left = str(bool(t.default_left[j])).upper()
    if t.categories[j] is not None:
        codes = ", ".join(str(c) for c in sorted(t.categories[j])) or "NULL"
        nan = left if t.missing_nan[j] else str(0 in t.categories[j]).upper()
        return f"(CASE WHEN isnan({f}) THEN {nan} WHEN {f} <= -1 OR {f} >= 2147483648 THEN FALSE ELSE coalesce(CAST(trunc_({f}) AS INT) IN ({codes}), FALSE) END)"
    value = f if t.missing_nan[j] else f"(CASE WHEN isnan({f}) THEN {number(0.0)} ELSE {f} END)"
    tests = []
    if t.missing_zero[j]:
        tests.append(f"({value} > {number(-ZERO)} AND {value} <= {number(ZERO)})")
    if t.missing_nan[j]:
        tests.append(f"isnan({value})")
    compare = f"{value} {'<' if t.strict else '<='} {number(float(t.threshold[j]))}"
    return f"(CASE WHEN {' OR '.join(tests)} THEN {left} ELSE {compare} END)" if tests else f"({compare})"


def tree_sql(t: Tree, cols: list[str], leaf) -> str:
    """A tree as nested CASE; ``leaf(i)`` is the text for leaf i."""

    def at(child: int) -> str:
        if child < 0:
            return leaf(~child)
        return f"(CASE WHEN {goes_left_sql(t, child, cols)} THEN {at(t.left[child])} ELSE {at(t.right[child])} END)"

    return at(0) if t.nodes else leaf(0)


def margin_sql(m: Forest, cols: list[str], output: int = 0, begin: int = 0, end: int | None = None) -> str:
    parts = []
    for i in m.between(begin, end):
        t = m.trees[i]
        if not m.vector_tips and m.class_of(i) != output:
            continue
        w = m.weight_of(i)
        parts.append(tree_sql(t, cols, lambda k, t=t, w=w: number(w * float(t.leaf_value[k][output if m.vector_tips else 0]))))
    total = " + ".join(parts) or number(0.0)
    return f"({number(m.base_of(output))} + ({total}) * {number(m.scale_of(begin, end))})"


def for_spark(sql: str) -> str:
    """Toward zero, as the codes of categories are read; a cast of a double to int does that in Spark."""
    return sql.replace("trunc_(", "(")


def for_duckdb(sql: str) -> str:
    return sql.replace("trunc_(", "trunc(")


# --- numpy walk ------------------------------------------------------------------


class _Compiled:
    """A tree as arrays."""

    def __init__(self, t: Tree):
        self.n = t.nodes
        arr = lambda v, k: np.array(v, k)
        self.feature, self.threshold = arr(t.feature, np.int32), arr(t.threshold, float)
        self.left, self.right = arr(t.left, np.int32), arr(t.right, np.int32)
        self.default, self.zero, self.nan = arr(t.default_left, bool), arr(t.missing_zero, bool), arr(t.missing_nan, bool)
        self.values = np.array(t.leaf_value, float).reshape(max(1, t.tips), -1)
        self.strict = t.strict
        self.plain = not (any(t.missing_zero) or any(c is not None for c in t.categories))
        self.all_nan = bool(self.nan.all()) if self.n else True
        self.cats = {j: np.array(sorted(c), np.int64) for j, c in enumerate(t.categories) if c is not None}

    def go_left(self, x: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        f = self.feature[node]
        known = f < x.shape[1]
        value = x.at(rows, f) if isinstance(x, SparseRows) else x[rows, np.where(known, f, 0)]
        isnan = np.isnan(value)
        uses_nan = self.nan[node]
        value = np.where(isnan & ~uses_nan, 0.0, value)
        with np.errstate(invalid="ignore"):
            left = value < self.threshold[node] if self.strict else value <= self.threshold[node]
        missing = isnan & uses_nan
        if not self.plain:
            missing |= self.zero[node] & (value > -ZERO) & (value <= ZERO)
        left = np.where(missing, self.default[node], left)
        for j, codes in self.cats.items():
            here = np.flatnonzero(node == j)
            if len(here):
                v = value[here]
                ok = (v > -1) & (v < 2147483648.0)
                code = np.where(ok, v, -1).astype(np.int64)
                left[here] = np.where(isnan[here] & uses_nan[here], self.default[j], np.isin(code, codes) & ok)
        return left & known

    def in_levels(self, kinds: list[tuple[bool, bool, bool]], width: int) -> tuple | None:
        """(columns, thresholds, leaf of each end, depth) of the tree as a whole one, for :class:`_Missing`; None where it is no plain or no low tree."""
        if not self.n or self.cats or not np.isfinite(self.threshold).all():
            return None
        depth, row = 0, [(0, 0)]
        while any(c >= 0 for c, _ in row):
            depth += 1
            row = [(child, p) for c, p in row if c >= 0 for child, p in ((int(self.left[c]), 0), (int(self.right[c]), 0))]
            if depth > LEVELS:
                return None
        column, threshold, ends = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2**depth, np.int32)
        todo = [(0, 0, 0)]
        while todo:
            c, place, level = todo.pop()
            if c < 0:  # all ends below are this leaf
                span = 2 ** (depth - level)
                first = (place + 1) * span - 2**depth
                ends[first : first + span] = ~c
                continue
            f = int(self.feature[c])
            kind = kinds.index((bool(self.zero[c]), bool(self.nan[c]), bool(self.default[c])))
            column[place] = kind * width + f if f < width else len(kinds) * width
            threshold[place] = np.nextafter(self.threshold[c], -np.inf) if self.strict else self.threshold[c]
            todo += [(int(self.left[c]), 2 * place + 1, level + 1), (int(self.right[c]), 2 * place + 2, level + 1)]
        return column, threshold, ends, depth

    def tips(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        at = np.zeros(len(x), np.int32)
        if not self.n:
            return at
        rows = np.arange(len(x))
        while len(rows):
            node = at[rows]
            at[rows] = np.where(self.go_left(x, rows, node), self.left[node], self.right[node])
            rows = rows[at[rows] >= 0]
        return ~at


class SparseRows:
    """Rows as (offsets, feature numbers, values): cells that aren't there are NaN, and a feature that a row has twice counts as given last.

    A cell is found by binary search over (row, feature), so rows of any width
    take the room of the cells they have.
    """

    def __init__(self, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray, width: int):
        self.shape = (len(offsets) - 1, width)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = (indices >= 0) & (indices < width)
        key = row[inside] * np.int64(width) + indices[inside]
        order = np.argsort(key, kind="stable")
        self.key, self.values = key[order], values[inside][order]

    def __len__(self) -> int:
        return self.shape[0]

    def at(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        wanted = rows * np.int64(self.shape[1]) + features
        k = np.searchsorted(self.key, wanted, "right") - 1
        if not len(self.key):
            return np.full(len(wanted), np.nan)
        return np.where((k >= 0) & (self.key[k] == wanted) & (features < self.shape[1]), self.values[k], np.nan)


#: Levels up to which a tree is walked as a whole one.
LEVELS = 8
#: Rows that are walked at a time, so that their features stay in the cache.
WALK_ROWS = 4096


class _Missing:
    """A batch with missing values, for each kind of node, as what sends them to its side: an infinity, or zero.

    A level of a whole tree is then two gathers and a comparison for each row.
    """

    def __init__(self, x: np.ndarray, kinds: list[tuple[bool, bool, bool]]):
        parts = []
        for zero, nan, left in kinds:
            side = -np.inf if left else np.inf
            v = np.where(np.isnan(x), side if nan else 0.0, x)
            parts.append(np.where((v > -ZERO) & (v <= ZERO), side, v) if zero else v)
        wide = np.column_stack([*parts, np.full(len(x), np.inf)])
        self.flat, self.rows = wide.ravel(), np.arange(len(x)) * wide.shape[1]

    def ends(self, column: np.ndarray, threshold: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(self.rows), np.int64)
        for _ in range(depth):
            right = self.flat.take(self.rows + column.take(at)) > threshold.take(at)
            at = 2 * at + 1 + right
        return at - (2**depth - 1)


def forest_tips(m: Forest, x: np.ndarray, trees: list[int]) -> list[np.ndarray]:
    return [_Compiled(m.trees[i]).tips(x) for i in trees]


def forest_margins(m: Forest, x: np.ndarray, begin: int = 0, end: int | None = None, compiled: dict | None = None) -> np.ndarray:
    """(rows, outputs) margins. ``compiled`` keeps trees as arrays from batch to batch."""
    compiled = {} if compiled is None else compiled
    plan = ("plan", begin, end)
    if plan not in compiled:
        used = m.between(begin, end)
        compiled |= {i: _Compiled(m.trees[i]) for i in used if i not in compiled}
        compiled[plan] = used, [m.class_of(i) for i in used], m.scale_of(begin, end), m.vector_tips
    used, classes, scale, vector = compiled[plan]
    parts = [x]
    if isinstance(x, np.ndarray) and len(used) > 1:
        parts = [x[i : i + WALK_ROWS] for i in range(0, max(1, len(x)), WALK_ROWS)]
    total = np.concatenate([_walked(m, part, used, classes, vector, compiled) for part in parts])
    return total * scale + np.array([m.base_of(k) for k in range(m.n_outputs)])


def _walked(m: Forest, x, used: list[int], classes: list[int], vector: bool, compiled: dict) -> np.ndarray:
    total = np.zeros((len(x), m.n_outputs))
    low, missing = {}, None
    if isinstance(x, np.ndarray) and len(used) > 1:
        key = ("levels", x.shape[1])
        if key not in compiled:
            kinds = sorted({(bool(z), bool(n), bool(d)) for i in used for z, n, d in zip(compiled[i].zero, compiled[i].nan, compiled[i].default)})
            compiled[key] = kinds, {i: t for i in used if (t := compiled[i].in_levels(kinds, x.shape[1])) is not None}
        kinds, low = compiled[key]
        missing = _Missing(x, kinds) if low else None
    for i, k in zip(used, classes):
        c = compiled[i]
        if i in low:
            column, threshold, ends, depth = low[i]
            tips = ends.take(missing.ends(column, threshold, depth))
        else:
            tips = c.tips(x)
        if vector:
            total += c.values[tips] * m.weight_of(i)
        else:
            total[:, k] += (c.values[:, 0] * m.weight_of(i)).take(tips)
    return total


def matrix(columns) -> np.ndarray:
    return np.column_stack([pd.to_numeric(c).to_numpy(float, na_value=np.nan) for c in columns])


def _margins_column(m: Forest, cols: list[str], begin: int, end: int | None) -> Column:
    """array<double> of margins by the numpy walk."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        compiled: dict = {}
        for part in parts:
            x = matrix([part[c] for c in part])
            yield pd.Series(list(forest_margins(m, x, begin, end, compiled)))

    return _iter_udf(walk, "array<double>")(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]))


def _iter_udf(function, kind: str):
    function.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return F.pandas_udf(function, kind)


def margins(m: Forest | Linear, cols: list[str], begin: int = 0, end: int | None = None, strategy: str = "auto") -> Column:
    """array<double>: one margin an output."""
    if isinstance(m, Linear):
        return F.array(*[linear_margin(m, cols, k) for k in range(m.n_outputs)])
    if strategy == "auto":
        strategy = "case" if sum(m.trees[i].tips for i in m.between(begin, end)) <= CASE_TIPS else "walk"
    if strategy == "case":
        return F.array(*[F.expr(for_spark(margin_sql(m, cols, k, begin, end))) for k in range(m.n_outputs)])
    return _margins_column(m, cols, begin, end)


def sparse_margins(df: DataFrame, m: Forest | Linear, indices: str = "indices", values: str = "values", to: str = "margins") -> DataFrame:
    """``df`` with array<double> of margins of rows given as arrays of feature numbers and values.

    What a row lacks is missing for trees and 0 for a linear model; rows are
    walked as they are and never widened. Arrays that are null have no cells.
    """
    weights = np.array(m.weights, float).reshape(m.n_features, m.n_outputs) if isinstance(m, Linear) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict = {}
        for b in batches:
            at, v = b.column("_sparse_i"), b.column("_sparse_v")
            sizes = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
            offsets = np.r_[0, np.cumsum(sizes)]
            i = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            if weights is None:
                out = forest_margins(m, SparseRows(offsets, i, x, m.n_features), compiled=compiled)
            else:
                row, ok = np.repeat(np.arange(len(sizes)), sizes), (i >= 0) & (i < len(weights)) & ~np.isnan(x)
                out = np.zeros((len(sizes), m.n_outputs))
                np.add.at(out, row[ok], x[ok, None] * weights[i[ok]])
                out += np.array(m.bias) + np.array(m.base if len(m.base) > 1 else m.base[0])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], lists], [*names, to])

    names = df.columns
    kept = df.withColumns({"_sparse_i": F.when(F.col(values).isNotNull(), F.col(indices)).cast("array<int>"), "_sparse_v": F.when(F.col(indices).isNotNull(), F.col(values)).cast("array<double>")})
    return kept.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))]))


def linear_margin(m: Linear, cols: list[str], output: int = 0) -> Column:
    """base + bias + sum of x * w; absent values add nothing."""
    total = F.lit(float((m.base[output] if len(m.base) > 1 else m.base[0]) + m.bias[output]))
    for c, w in zip(cols, m.weights):
        x = F.col(c).cast("double")
        total = total + F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x) * F.lit(float(w[output]))
    return total


def leaf_indices(m: Forest, cols: list[str], begin: int = 0, end: int | None = None, strategy: str = "auto") -> Column:
    """array<int>: leaf numbers, all iterations of the first output first, then of the next."""
    trees = sorted(m.between(begin, end), key=lambda i: (m.class_of(i), i))
    if strategy == "case" or strategy == "auto" and sum(m.trees[i].tips for i in trees) <= CASE_TIPS:
        return F.array(*[F.expr(for_spark(tree_sql(m.trees[i], cols, str))).cast("int") for i in trees])

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = matrix([part[c] for c in part])
            yield pd.Series(list(np.column_stack(forest_tips(m, x, trees)).astype(np.int32)))

    return _iter_udf(walk, "array<int>")(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]))


def predict(df: DataFrame, model: Forest | Linear, features: list[str], output: str = "value", to: str = "prediction", begin: int = 0, end: int | None = None, transform: str | None = None, strategy: str = "auto") -> DataFrame:
    """``df`` with a column of predictions.

    ``output`` is value, margin, leaf, contrib, approx_contrib or interaction;
    ``begin``/``end`` bound the iterations. A model of one output gives a
    double for value and margin, one of several an array.
    """
    if output == "leaf":
        return df.withColumn(to, leaf_indices(model, features, begin, end, strategy))
    if output in ("contrib", "approx_contrib", "interaction"):
        from .explain import explain_column

        return df.withColumn(to, explain_column(model, features, output))
    if output not in ("value", "margin"):
        raise ValueError(f"no such output: {output}")
    if len(features) < model.n_features:
        raise ValueError(f"the model has {model.n_features} features, not {len(features)}")
    m = margins(model, features, begin, end, strategy)
    if output == "value":
        # In two steps: functions over arrays take no Python function inside.
        return df.withColumn("_margins", m).withColumn(to, transforms.apply(transform or model.transform, F.col("_margins"), model.n_outputs)).drop("_margins")
    return df.withColumn(to, m if model.n_outputs > 1 else F.get(m, F.lit(0)))


def walk_profile(df: DataFrame, m: Forest, features: list[str]) -> DataFrame:
    """Per tree: rows, total and largest number of steps from root to leaf."""
    depth = []
    for t in m.trees:
        steps = {}
        todo = [(0, 0)] if t.nodes else [(~0, 0)]
        while todo:
            c, d = todo.pop()
            if c < 0:
                steps[~c] = d
            else:
                todo += [(t.left[c], d + 1), (t.right[c], d + 1)]
        depth.append(steps)
    lookup = [F.array(*[F.lit(s.get(i, 0)) for i in range(max(1, t.tips))]) for s, t in zip(depth, m.trees)]
    order = sorted(range(len(m.trees)), key=lambda i: (m.class_of(i), i))
    at = predict(df, m, features, "leaf", "_leaf")
    steps = F.array(*[F.struct(F.lit(i).alias("tree_id"), F.get(lookup[i], F.get(F.col("_leaf"), F.lit(k))).alias("steps")) for k, i in enumerate(order)])
    return at.select(F.explode(steps).alias("s")).groupBy("s.tree_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("s.steps").cast("long").alias("total_steps"), F.max("s.steps").alias("max_steps"))
