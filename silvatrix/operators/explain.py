"""Explanations of forests: Shapley values, interactions, path shares, importance, dumps.

Shapley values follow the paths of a tree: what a feature is worth when it is
not known is the share of training weight that goes each way. Every leaf is
worked through by itself for all rows of an Arrow batch at once. With the path's
different features j, the share z_j that would reach the leaf without knowing
j, and whether the row satisfies j's tests (o_j), the leaf adds

    value * (o_i - z_i) * sum over S of |S|! (m-|S|-1)! / m! * prod_S o * prod_rest z

to feature i; the sums over S by size are the coefficients of the product of
(z_j + o_j t). Rows are independent, so there is no shuffle.

Values are relative to the row of all zeros: what the paths leave of
margin(x) - margin(0) goes to the feature of a tree's root. Tree weights and
averaging scale all of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Forest, Linear, Tree
from .scoring import _Compiled, _iter_udf, forest_margins, matrix


def expected_value(m: Forest) -> list[float]:
    """Margins of the row of all zeros."""
    return forest_margins(m, np.zeros((1, m.n_features)))[0].tolist()


def _shares(t: Tree, cover: str) -> list[tuple[float, float]]:
    """For each node the share of its weight that goes left and right.

    ``sums``: by the children's hessian sums. ``unit``: an inner node weighs its
    own hessian sum and a leaf weighs one, as models without statistics of
    their tips have it; shares then need not add up to one.
    """
    if cover == "sums":
        both = [(t.child_cover(a), t.child_cover(b)) for a, b in zip(t.left, t.right)]
        return [(a / (a + b), b / (a + b)) if a + b else (0.5, 0.5) for a, b in both]

    def weight(c: int) -> float:
        if c < 0:
            return 1.0
        return t.cover[c] if t.cover[c] > 0 else weight(t.left[c]) + weight(t.right[c])

    return [(weight(a) / weight(j), weight(b) / weight(j)) for j, (a, b) in enumerate(zip(t.left, t.right))]


class _Tips:
    """A tree's tips as (value, [(feature, share, [(node, goes left)])])."""

    def __init__(self, t: Tree, cover: str = "sums"):
        shares = _shares(t, cover)
        self.walk = _Compiled(t)
        self.root = t.feature[0] if t.nodes else -1
        self.paths = []
        todo = [(0, [])] if t.nodes else []
        while todo:
            node, path = todo.pop()
            left, right = shares[node]
            for child, share, is_left in ((t.left[node], left, True), (t.right[node], right, False)):
                step = [*path, (t.feature[node], share, node, is_left)]
                if child >= 0:
                    todo.append((child, step))
                    continue
                by: dict[int, list] = {}
                for f, z, n, go in step:
                    entry = by.setdefault(f, [1.0, []])
                    entry[0] *= z
                    entry[1].append((n, go))
                self.paths.append((np.array(t.leaf_value[~child]), [(f, z, tests) for f, (z, tests) in by.items()]))

    def decisions(self, x: np.ndarray) -> list[np.ndarray]:
        rows = np.arange(len(x))
        return [self.walk.go_left(x, rows, np.full(len(x), n)) for n in range(self.walk.n)]


@lru_cache(maxsize=64)
def _weights(m: int, less: int) -> np.ndarray:
    """By size s of S: s! (m-less-s)! / (m-less+1)!"""
    n = m - less
    return np.array([factorial(s) * factorial(n - s) / factorial(n + 1) for s in range(n + 1)])


def _product(o: list[np.ndarray], z: list[float], rows: int) -> np.ndarray:
    """Coefficients of the product of (z + o t), one row each."""
    poly = np.zeros((rows, len(o) + 1))
    poly[:, 0] = 1.0
    for k, (a, b) in enumerate(zip(o, z)):
        poly[:, 1 : k + 2] = poly[:, 1 : k + 2] * b + poly[:, : k + 1] * a[:, None]
        poly[:, 0] *= b
    return poly


def _tree_shapley(tips: _Tips, x: np.ndarray, phi: np.ndarray, inter: np.ndarray | None = None) -> None:
    """Add a tree's values to phi (rows, outputs, features), and pairs to inter (rows, outputs, f, f)."""
    left = tips.decisions(x)
    n = len(x)
    for value, parts in tips.paths:
        o = [np.logical_and.reduce([left[k] if go else ~left[k] for k, go in tests]).astype(float) for _, _, tests in parts]
        z = [p[1] for p in parts]
        m = len(parts)
        for i, (f, zi, _) in enumerate(parts):
            rest = [k for k in range(m) if k != i]
            s = _product([o[k] for k in rest], [z[k] for k in rest], n) @ _weights(m, 1)
            phi[:, :, f] += ((o[i] - zi) * s)[:, None] * value
            if inter is None:
                continue
            for j in range(i):
                rest = [k for k in range(m) if k not in (i, j)]
                s = _product([o[k] for k in rest], [z[k] for k in rest], n) @ _weights(m, 2) / 2
                add = ((o[i] - zi) * (o[j] - z[j]) * s)[:, None] * value
                g = parts[j][0]
                inter[:, :, f, g] += add
                inter[:, :, g, f] += add


def shapley(m: Forest, x: np.ndarray, interactions: bool = False, compiled: list[_Tips] | None = None, cover: str = "sums"):
    """(rows, outputs, features) values, or with ``interactions`` (rows, outputs, features, features)."""
    compiled = compiled or [_Tips(t, cover) for t in m.trees]
    phi = np.zeros((len(x), m.n_outputs, m.n_features))
    pairs = np.zeros((len(x), m.n_outputs, m.n_features, m.n_features)) if interactions else None
    zero = np.zeros((1, m.n_features))
    scale = m.scale_of()
    for i, tips in enumerate(compiled):
        dims = tips.walk.values.shape[1]
        one = np.zeros((len(x), dims, m.n_features))
        two = np.zeros((len(x), dims, m.n_features, m.n_features)) if interactions else None
        if tips.root >= 0:
            _tree_shapley(tips, x, one, two)
            got = tips.walk.values[tips.walk.tips(x)] - tips.walk.values[tips.walk.tips(zero)]
            if tips.root < m.n_features:
                one[:, :, tips.root] += got - one.sum(2)
        where = slice(None) if m.vector_tips else slice(m.class_of(i), m.class_of(i) + 1)
        w = m.weight_of(i) * scale
        phi[:, where] += one * w
        if interactions:
            pairs[:, where] += two * w
    if not interactions:
        return phi
    k = np.arange(m.n_features)
    pairs[:, :, k, k] = 0
    pairs[:, :, k, k] = phi - pairs.sum(3)
    return pairs


def path_shares(m: Forest, x: np.ndarray) -> np.ndarray:
    """(rows, outputs, features): each leaf's value shared evenly over the nodes of its path."""
    phi = np.zeros((len(x), m.n_outputs, m.n_features))
    scale = m.scale_of()
    for i, t in enumerate(m.trees):
        c = _Compiled(t)
        if not t.nodes:
            continue
        at = c.tips(x)
        counts = np.zeros((t.tips, m.n_features))
        todo = [(0, [])]
        while todo:
            node, path = todo.pop()
            path = [*path, t.feature[node]]
            for child in (t.left[node], t.right[node]):
                if child >= 0:
                    todo.append((child, path))
                else:
                    for f in path:
                        if f < m.n_features:
                            counts[~child, f] += 1 / len(path)
        add = c.values[at][:, :, None] * counts[at][:, None, :] * m.weight_of(i) * scale
        if m.vector_tips:
            phi += add
        else:
            phi[:, m.class_of(i)] += add[:, 0]
    return phi


def explain_column(m: Forest | Linear, features: list[str], output: str, cover: str = "sums") -> Column:
    """contrib and approx_contrib: [feature..., bias]; interaction: [feature][feature].

    A model of several outputs gives an array of these, one for each.
    """
    if isinstance(m, Linear):
        if output == "interaction":
            raise ValueError("a linear model has no interactions")
        parts = [[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * w[k] for c, w in zip(features, m.weights)] for k in range(m.n_outputs)]
        rows = [F.array(*p, F.lit(float(m.bias[k] + (m.base[k] if len(m.base) > 1 else m.base[0])))) for k, p in enumerate(parts)]
        return rows[0] if m.n_outputs == 1 else F.array(*rows)
    bias = np.array(expected_value(m))
    depth = 2 if output == "interaction" else 1
    kind = "double"
    for _ in range(depth + (m.n_outputs > 1)):
        kind = f"array<{kind}>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        compiled = [_Tips(t, cover) for t in m.trees] if output != "approx_contrib" else None
        for part in parts:
            x = matrix([part[c] for c in part])
            if output == "interaction":
                out = shapley(m, x, True, compiled)
            else:
                phi = shapley(m, x, False, compiled) if output == "contrib" else path_shares(m, x)
                out = np.concatenate([phi, np.broadcast_to(bias[None, :, None], (len(x), m.n_outputs, 1))], axis=2)
            out = out[:, 0] if m.n_outputs == 1 else out
            yield pd.Series(out.tolist())

    return _iter_udf(run, kind)(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]))


IMPORTANCE = ("weight", "gain", "total_gain", "cover", "total_cover")


def importance(nodes: DataFrame, kind: str = "weight") -> DataFrame:
    """(feature, score) from a node table. Total kinds are shares; without statistics splits count."""
    if kind not in IMPORTANCE:
        raise ValueError(f"no such importance: {kind}")
    inner = nodes.where("not is_leaf")
    if kind == "weight":
        return inner.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("score"))
    c = "split_gain" if kind.endswith("gain") else "sum_hess"
    some = inner.agg(F.max(F.abs(F.coalesce(c, F.lit(0.0))) > 0).alias("_some"))
    scores = inner.join(F.broadcast(some)).groupBy("feature").agg(F.sum(F.when(F.col("_some"), F.col(c)).otherwise(1.0)).alias("score"))  # one row of statistics
    if kind.startswith("total_"):
        total = scores.agg(F.sum("score").alias("_t"))
        scores = scores.join(F.broadcast(total)).select("feature", F.when(F.col("_t") > 0, F.col("score") / F.col("_t")).otherwise(F.col("score")).alias("score"))
    return scores


def metadata(nodes: DataFrame) -> DataFrame:
    """One row: trees, iterations, inner nodes, tips, features used."""
    return nodes.agg(
        F.countDistinct("tree_id").alias("n_trees"),
        F.countDistinct("iteration").alias("n_iterations"),
        F.sum(F.when(F.col("is_leaf"), 0).otherwise(1)).alias("n_nodes"),
        F.sum(F.when(F.col("is_leaf"), 1).otherwise(0)).alias("n_tips"),
        (F.max("feature") + 1).alias("n_features"),
    )


def _name(m: Forest, f: int) -> str:
    return m.feature_names[f] if f < len(m.feature_names) else f"f{f}"


def _test(m: Forest, t: Tree, j: int) -> str:
    if t.categories[j] is not None:
        return f"{_name(m, t.feature[j])}=={'|'.join(map(str, sorted(t.categories[j])))}"
    return f"{_name(m, t.feature[j])}{'<' if t.strict else '<='}{t.threshold[j]:g}"


def dump_text(m: Forest) -> str:
    """Trees as indented text; tips are numbered after the inner nodes."""
    out = []
    for i, t in enumerate(m.trees):
        out.append(f"booster[{i}]:")
        ident = lambda c, t=t: c if c >= 0 else t.nodes + ~c
        todo = [(0 if t.nodes else ~0, 0)]
        while todo:
            c, d = todo.pop()
            if c < 0:
                out.append("\t" * d + f"{ident(c)}:leaf={','.join(f'{v:g}' for v in t.leaf_value[~c])}")
                continue
            out.append("\t" * d + f"{c}:[{_test(m, t, c)}] yes={ident(t.left[c])},no={ident(t.right[c])},missing={ident(t.left[c] if t.default_left[c] else t.right[c])}")
            todo += [(t.right[c], d + 1), (t.left[c], d + 1)]
    return "\n".join(out) + "\n"


def dump_json(m: Forest) -> str:
    def node(t: Tree, c: int, d: int) -> dict:
        if c < 0:
            v = t.leaf_value[~c]
            return {"nodeid": t.nodes + ~c, "leaf": v[0] if len(v) == 1 else v}
        ident = lambda k: k if k >= 0 else t.nodes + ~k
        split = sorted(t.categories[c]) if t.categories[c] is not None else t.threshold[c]
        return {"nodeid": c, "depth": d, "split": _name(m, t.feature[c]), "split_condition": split, "yes": ident(t.left[c]), "no": ident(t.right[c]), "missing": ident(t.left[c] if t.default_left[c] else t.right[c]), "gain": t.gain[c], "cover": t.cover[c], "children": [node(t, t.left[c], d + 1), node(t, t.right[c], d + 1)]}

    return json.dumps([node(t, 0 if t.nodes else ~0, 0) for t in m.trees])


def dump_dot(m: Forest, tree: int = 0) -> str:
    t = m.trees[tree]
    lines = ["digraph {", "  graph [rankdir=TB]"]
    todo = [0 if t.nodes else ~0]
    ident = lambda c: c if c >= 0 else t.nodes + ~c
    while todo:
        c = todo.pop()
        if c < 0:
            lines.append(f'  {ident(c)} [label="leaf={",".join(f"{v:g}" for v in t.leaf_value[~c])}" shape=box]')
            continue
        lines.append(f'  {c} [label="{_test(m, t, c)}"]')
        for child, says in ((t.left[c], "yes"), (t.right[c], "no")):
            missing = ", missing" if (says == "yes") == bool(t.default_left[c]) else ""
            lines.append(f'  {c} -> {ident(child)} [label="{says}{missing}"]')
        todo += [t.right[c], t.left[c]]
    return "\n".join([*lines, "}"]) + "\n"
