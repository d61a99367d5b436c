"""Models as values on the driver and as node tables.

A forest is small next to the data it scores, so it is a plain value that is
shipped to the workers; :meth:`Forest.node_rows` gives the same model as rows,
one for each node and leaf, for everything that is an aggregation over nodes.
Tips are numbered after the inner nodes of their tree, in one id space.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

NODE_SCHEMA = (
    "tree_id int, class_id int, iteration int, node_id int, is_leaf boolean, feature int, threshold double, default_left boolean, missing_zero boolean, missing_nan boolean, "
    "categories array<int>, left_id int, right_id int, leaf_value array<double>, split_gain double, sum_hess double, tree_weight double"
)
#: |x| up to this counts as zero where zero means missing.
ZERO = 1e-35


@dataclass
class Tree:
    """Parallel lists over inner nodes; children are node numbers, or ~leaf for leaf ``leaf``."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    missing_zero: list[bool] = field(default_factory=list)
    missing_nan: list[bool] = field(default_factory=list)
    #: Codes that go left, for a categorical node; None for a numeric one.
    categories: list[frozenset[int] | None] = field(default_factory=list)
    leaf_value: list[list[float]] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    leaf_cover: list[float] = field(default_factory=list)
    strict: bool = False  # split by < instead of <=

    def add(self, feature: int, threshold: float, left: int, right: int, default_left=False, missing_zero=False, missing_nan=True, categories=None, gain=0.0, cover=0.0) -> int:
        for name, v in (("feature", feature), ("threshold", threshold), ("left", left), ("right", right), ("default_left", default_left), ("missing_zero", missing_zero), ("missing_nan", missing_nan), ("categories", None if categories is None else frozenset(categories)), ("gain", gain), ("cover", cover)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    @property
    def nodes(self) -> int:
        return len(self.feature)

    @property
    def tips(self) -> int:
        return len(self.leaf_value)

    def depth(self) -> int:
        deepest, todo = 0, [(0, 0)] if self.nodes else []
        while todo:
            node, d = todo.pop()
            deepest = max(deepest, d + 1)
            todo += [(c, d + 1) for c in (self.left[node], self.right[node]) if c >= 0]
        return deepest

    def child_cover(self, child: int) -> float:
        """Hessian sum below a child; the number of its tips where the model has no sums."""
        if any(self.cover) or any(self.leaf_cover):
            return self.cover[child] if child >= 0 else self.leaf_cover[~child]
        return 1.0 if child < 0 else self.child_cover(self.left[child]) + self.child_cover(self.right[child])


@dataclass
class Forest:
    trees: list[Tree]
    n_features: int
    n_outputs: int = 1
    #: Output that each tree adds to; None: tree i adds to i % n_outputs (or to all, for vector tips).
    tree_class: list[int] | None = None
    tree_weight: list[float] | None = None
    #: Trees before each iteration; None: n_outputs trees an iteration.
    iteration_begin: list[int] | None = None
    base: list[float] = field(default_factory=lambda: [0.0])
    average: bool = False
    transform: str = "raw"
    objective: str = ""
    feature_names: list[str] = field(default_factory=list)
    name: str = "forest"

    @property
    def vector_tips(self) -> bool:
        return any(len(v) > 1 for t in self.trees for v in t.leaf_value)

    def class_of(self, i: int) -> int:
        if self.tree_class:
            return self.tree_class[i]
        return 0 if self.n_outputs == 1 or self.vector_tips else i % self.n_outputs

    def weight_of(self, i: int) -> float:
        return self.tree_weight[i] if self.tree_weight else 1.0

    def base_of(self, k: int) -> float:
        return self.base[k] if len(self.base) > 1 else self.base[0]

    def iteration_of(self) -> list[int]:
        """The iteration of each tree."""
        if self.iteration_begin:
            return [int(np.searchsorted(self.iteration_begin, i, "right")) - 1 for i in range(len(self.trees))]
        per = 1 if self.vector_tips else self.n_outputs
        return [i // per for i in range(len(self.trees))]

    @property
    def n_iterations(self) -> int:
        return max(self.iteration_of(), default=-1) + 1

    @property
    def n_tips(self) -> int:
        return sum(t.tips for t in self.trees)

    def between(self, begin: int = 0, end: int | None = None) -> list[int]:
        """Trees of iterations from ``begin`` up to ``end``; nothing or too much means the last."""
        n = self.n_iterations
        end = n if not end or end < 0 or end > n else end
        return [i for i, it in enumerate(self.iteration_of()) if begin <= it < end]

    def scale_of(self, begin: int = 0, end: int | None = None) -> float:
        """What the trees' sum is multiplied by."""
        used = {self.iteration_of()[i] for i in self.between(begin, end)}
        return 1.0 / len(used) if self.average and used else 1.0

    def node_rows(self) -> list[tuple]:
        rows = []
        for i, (t, it) in enumerate(zip(self.trees, self.iteration_of())):
            k, w = self.class_of(i), self.weight_of(i)
            ident = lambda c, n=t.nodes: c if c >= 0 else n + ~c
            for j in range(t.nodes):
                cats = None if t.categories[j] is None else sorted(t.categories[j])
                rows.append((i, k, it, j, False, t.feature[j], float(t.threshold[j]), t.default_left[j], t.missing_zero[j], t.missing_nan[j], cats, ident(t.left[j]), ident(t.right[j]), None, float(t.gain[j]), float(t.cover[j]), w))
            for j, v in enumerate(t.leaf_value):
                rows.append((i, k, it, t.nodes + j, True, None, None, None, None, None, None, None, None, [float(x) for x in v], None, float(t.leaf_cover[j]) if t.leaf_cover else 0.0, w))
        return rows

    def node_table(self, spark):
        return spark.createDataFrame(self.node_rows(), NODE_SCHEMA)


@dataclass
class Linear:
    """weights[feature][output] and a bias for each output."""

    weights: list[list[float]]
    bias: list[float]
    base: list[float] = field(default_factory=lambda: [0.0])
    transform: str = "raw"
    objective: str = ""
    feature_names: list[str] = field(default_factory=list)
    name: str = "linear"

    @property
    def n_outputs(self) -> int:
        return len(self.bias)

    @property
    def n_features(self) -> int:
        return len(self.weights)


def tiny_forest() -> Forest:
    """Three small trees that use every kind of node: a fixture for queries and tests."""
    a = Tree()
    a.add(0, 3.5, 1, 2, missing_nan=True, default_left=True, gain=12.0, cover=100.0)
    a.add(1, 60.0, ~0, ~1, gain=5.0, cover=60.0)
    a.add(2, 15.0, ~2, ~3, missing_zero=True, default_left=True, gain=4.0, cover=40.0)
    a.leaf_value, a.leaf_cover = [[0.4], [-0.2], [0.1], [-0.6]], [25.0, 35.0, 18.0, 22.0]
    b = Tree()
    b.add(3, 0.0, 1, ~0, categories=[1, 4, 9, 16, 25, 36], missing_nan=False, gain=7.0, cover=100.0)
    b.add(1, 120.0, ~1, ~2, gain=3.0, cover=30.0)
    b.leaf_value, b.leaf_cover = [[0.05], [0.3], [-0.15]], [70.0, 12.0, 18.0]
    c = Tree()
    c.add(2, 20.0, ~0, 1, default_left=False, gain=2.5, cover=100.0)
    c.add(3, 0.0, ~1, ~2, categories=[7], gain=1.5, cover=55.0)
    c.leaf_value, c.leaf_cover = [[-0.1], [0.25], [0.02]], [45.0, 5.0, 50.0]
    return Forest([a, b, c], 4, base=[0.1], transform="logistic", tree_weight=[1.0, 0.5, 1.0], feature_names=["lines", "quantity", "discount", "tax"], name="tiny")


def three_class_forest() -> Forest:
    """Two iterations of a tree for each of three classes."""
    trees = []
    for i in range(6):
        t = Tree()
        t.add(i % 4, [2.5, 80.0, 12.0, 10.0][i % 4], ~0, 1, gain=1.0 + i, cover=10.0)
        t.add((i + 1) % 4, [3.5, 110.0, 18.0, 16.0][(i + 1) % 4], ~1, ~2, gain=0.5 + i, cover=6.0)
        t.leaf_value, t.leaf_cover = [[0.1 * (i + 1)], [-0.05 * i], [0.2 - 0.1 * i]], [4.0, 3.0, 3.0]
        trees.append(t)
    return Forest(trees, 4, n_outputs=3, base=[0.1, 0.2, 0.3], transform="softmax", name="three classes")


def wide_forest(width: int = 100_000, trees: int = 40, depth: int = 3) -> Forest:
    """Whole trees of ``depth`` levels, each node over one feature of a very wide table, by a rule."""
    out, inner = [], 2**depth - 1
    for k in range(trees):
        t = Tree()
        for j in range(inner):
            number = inner * k + j
            left, right = (c if c < inner else ~(c - inner) for c in (2 * j + 1, 2 * j + 2))
            t.add((2503 * number + 17) % width, 5.0 + number % 40, left, right, default_left=number % 3 == 0, missing_nan=number % 5 > 0, gain=1.0, cover=1.0)
        t.leaf_value, t.leaf_cover = [[round(0.01 * ((inner + 1) * k + i) - 1, 6)] for i in range(inner + 1)], [1.0] * (inner + 1)
        out.append(t)
    return Forest(out, width, base=[0.5], name="wide")
