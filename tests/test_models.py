"""Trees, scoring, explanations and model files against plain Python."""

import itertools
import json
import math
import pickle
import struct
import sys
import types

import numpy as np
import pytest

from silvatrix.operators import explain, quantize, scoring
from silvatrix.plans.model import Forest, Linear, Tree, three_class_forest, tiny_forest
from silvatrix.sources import models


def walk(t, x):
    """Leaf of one row, the plain way."""
    at = 0 if t.nodes else ~0
    while at >= 0:
        v = x[t.feature[at]] if t.feature[at] < len(x) else None
        if v is None:
            left = False
        elif t.categories[at] is not None:
            left = t.default_left[at] if math.isnan(v) and t.missing_nan[at] else (int(v) if not math.isnan(v) else 0) in t.categories[at] and not v <= -1
        else:
            if math.isnan(v) and not t.missing_nan[at]:
                v = 0.0
            missing = t.missing_nan[at] and math.isnan(v) or t.missing_zero[at] and -1e-35 < v <= 1e-35
            left = t.default_left[at] if missing else v <= t.threshold[at]
        at = t.left[at] if left else t.right[at]
    return ~at


def rows(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(1, 7, n), rng.integers(10, 200, n), rng.integers(0, 40, n), rng.integers(-2, 40, n)]).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[rng.random(x.shape) < 0.1] = 0
    return x


@pytest.mark.parametrize("m", [tiny_forest(), three_class_forest()])
def test_both_strategies_walk_as_plain_python(spark, m):
    x = rows()
    want = [[walk(t, r) for t in m.trees] for r in x]
    got = np.column_stack(scoring.forest_tips(m, x, list(range(len(m.trees)))))
    assert got.tolist() == want
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    margins = scoring.forest_margins(m, x)
    for strategy in ("case", "walk"):
        out = scoring.predict(df, m, cols, "margin", "m", strategy=strategy).orderBy("i").collect()
        assert np.allclose([r["m"] for r in out], margins[:, 0] if m.n_outputs == 1 else margins)
        tips = scoring.predict(df, m, cols, "leaf", "l", strategy=strategy).orderBy("i").collect()
        order = sorted(range(len(m.trees)), key=lambda i: (m.class_of(i), i))
        assert [r["l"] for r in tips] == [[w[i] for i in order] for w in want]


def test_null_scores_as_nan(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "i int, a double").selectExpr("i", "a", "a AS b", "a AS c", "a AS d")
    out = [r["m"] for r in scoring.predict(df, tiny_forest(), ["a", "b", "c", "d"], "margin", "m").collect()]
    assert out[0] == out[1]


def test_too_few_features_raise(spark):
    with pytest.raises(ValueError):
        scoring.predict(spark.range(1).selectExpr("0.0 AS a"), tiny_forest(), ["a"])


def test_iterations_begin_is_honoured():  # Q8
    m = tiny_forest()
    x = rows(20)
    whole, first, rest = (scoring.forest_margins(m, x, a, b) - 0.1 for a, b in ((0, 3), (0, 1), (1, 3)))
    assert np.allclose(whole, first + rest)


def shapley_by_subsets(m, x, cover):
    """The definition, over all subsets of features."""
    n = m.n_features

    def value(t, known, at=0):
        if at < 0:
            return t.leaf_value[~at][0]
        f = t.feature[at]
        a, b = t.left[at], t.right[at]
        if f in known:
            c = scoring._Compiled(t)
            return value(t, known, a if c.go_left(x[None], np.array([0]), np.array([at]))[0] else b)
        za, zb = explain._shares(t, cover)[at]
        return za * value(t, known, a) + zb * value(t, known, b)

    phi = np.zeros(n)
    for i, t in enumerate(m.trees):
        one = np.zeros(n)
        for f in range(n):
            rest = [g for g in range(n) if g != f]
            for k in range(n):
                for s in itertools.combinations(rest, k):
                    w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                    one[f] += w * (value(t, {*s, f}) - value(t, set(s)))
        got = t.leaf_value[walk(t, x)][0] - t.leaf_value[walk(t, np.zeros(n))][0]
        one[t.feature[0]] += got - one.sum()
        phi += one * m.weight_of(i)
    return phi


@pytest.mark.parametrize("cover", ["unit", "sums"])
def test_shapley_is_the_sum_over_subsets(cover):
    m, x = tiny_forest(), rows(12, 3)
    got = explain.shapley(m, x, cover=cover)[:, 0]
    for r, phi in zip(x, got):
        assert np.allclose(phi, shapley_by_subsets(m, r, cover))
    assert np.allclose(got.sum(1), scoring.forest_margins(m, x)[:, 0] - explain.expected_value(m)[0])


def test_interactions_sum_to_values_and_are_symmetric():
    m, x = three_class_forest(), rows(12, 4)
    pairs, phi = explain.shapley(m, x, True), explain.shapley(m, x)
    assert np.allclose(pairs.sum(3), phi)
    assert np.allclose(pairs, pairs.swapaxes(2, 3))


def test_averaged_and_weighted_models_stay_additive():  # Q21
    m = tiny_forest()
    m.average = True
    x = rows(10, 5)
    assert np.allclose(explain.shapley(m, x).sum((1, 2)) + explain.expected_value(m)[0], scoring.forest_margins(m, x)[:, 0])


def test_importance_falls_back_to_counts(spark):
    t = Tree()
    t.add(1, 0.5, ~0, ~1)
    t.leaf_value = [[1.0], [2.0]]
    nodes = Forest([t], 2).node_table(spark)
    assert explain.importance(nodes, "gain").collect() == [(1, 1.0)]


def test_dumps():
    m = tiny_forest()
    text = explain.dump_text(m)
    assert text.startswith("booster[0]:\n0:[lines<=3.5] yes=1,no=2,missing=1\n") and text.count("leaf=") == m.n_tips
    assert len(json.loads(explain.dump_json(m))) == 3
    assert explain.dump_dot(m).count("->") == 6


def test_quantized_thresholds_stay_within_half_a_step(spark):
    m = three_class_forest()
    q = quantize.quantize(spark, m)
    for a, b in zip(m.trees, q.trees):
        assert all(abs(x - y) <= 80 / 127 for x, y in zip(a.threshold, b.threshold))


@pytest.mark.parametrize("m", [tiny_forest(), three_class_forest(), Linear([[0.5], [1.0]], [0.1])])
def test_native_file_round_trip(tmp_path, m):  # Q1: categories stay
    models.save(m, str(tmp_path / "m.json"))
    back = models.load(str(tmp_path / "m.json"))
    if isinstance(m, Forest):
        assert np.array_equal(scoring.forest_margins(back, rows()), scoring.forest_margins(m, rows()))
    else:
        assert back == m


def test_xgboost_round_trip_inverts_the_link():  # Q22
    m = three_class_forest()
    m.objective = "multi:softprob"
    back = models.xgboost_dict(models.to_xgboost(m))
    x = rows()
    assert np.allclose(scoring.forest_margins(back, x), scoring.forest_margins(m, x), atol=1e-5)
    b = tiny_forest()
    b.objective = "binary:logistic"
    for t in b.trees:
        t.missing_zero, t.missing_nan = [False] * t.nodes, [True] * t.nodes
    back = models.xgboost_dict(models.to_xgboost(b))
    assert np.allclose(scoring.forest_margins(back, x), scoring.forest_margins(b, x), atol=1e-5)


def test_categories_of_xgboost_go_right_unless_told():
    doc = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [0, 10, 20], "default_left": [1, 0, 0], "split_type": [1, 0, 0], "categories": [3], "categories_nodes": [0], "categories_segments": [0], "categories_sizes": [1]}
    right, left = models._xgb_tree(doc, False, False), models._xgb_tree(doc, False, True)
    x = np.array([[3.0], [1.0], [np.nan]])
    value = lambda t: [t.leaf_value[walk(t, r)][0] for r in x]
    assert value(right) == [20, 10, 10] and value(left) == [10, 20, 10]


def test_ubjson():
    doc = b"{U\x01a[$d#U\x02" + struct.pack(">ff", 1.5, -2.0) + b"U\x01bSU\x02hiU\x01c[i\x01TZ]U\x01dL" + struct.pack(">q", 7) + b"}"
    assert models.decode_ubjson(doc) == {"a": [1.5, -2.0], "b": "hi", "c": [1, True, None], "d": 7}
    with pytest.raises(models.FormatError):
        models.decode_ubjson(doc[:9])


def test_legacy_binary():
    head = struct.pack("<fIiii29i", 0.5, 2, 0, 0, 0, *[0] * 29)
    name = lambda s: struct.pack("<Q", len(s)) + s
    gb = struct.pack("<iiiiqii32i", 1, 1, 2, 0, 0, 1, 0, *[0] * 32)
    tree = struct.pack("<6i31i", 1, 3, 0, 1, 2, 0, *[0] * 31)
    nodes = b"".join(struct.pack("<iiiIf", *n) for n in ((-1, 1, 2, 1 | 1 << 31, 0.5), (0, -1, -1, 0, 1.0), (0, -1, -1, 0, -1.0)))
    stats = b"".join(struct.pack("<fffi", 1, 2, 0, 0) for _ in range(3))
    data = head + name(b"reg:squarederror") + name(b"gbtree") + gb + tree + nodes + stats + struct.pack("<i", 0)
    for d in (data, b"binf" + data):
        m = models.xgboost_binary(d)
        assert scoring.forest_margins(m, np.array([[0, 0.4], [0, 0.6], [0, np.nan]]))[:, 0].tolist() == [1.5, -0.5, 1.5]


LGB = """tree
version=v3
num_class=1
num_tree_per_iteration=1
max_feature_idx=1
objective=binary sigmoid:1
feature_names=a b

Tree=0
num_cat=1
split_feature=0 1
split_gain=5 3
threshold=1.5 0
decision_type=10 1
left_child=1 -2
right_child=-1 -3
leaf_value=0.1 0.2 0.3
leaf_count=5 3 2
internal_count=10 5
cat_boundaries=0 2
cat_threshold=2 1

end of trees
"""


def test_lightgbm_text():
    m = models.lightgbm_text(LGB)
    x = np.array([[1.0, 1.0], [1.0, 32.0], [1.0, 0.0], [2.0, 1.0], [np.nan, 1.0]])
    assert scoring.forest_margins(m, x)[:, 0].tolist() == [0.2, 0.2, 0.3, 0.1, 0.2] and m.transform == "logistic"


def test_lightgbm_json():
    leaf = lambda v: {"leaf_value": v, "leaf_count": 1}
    node = {"split_feature": 0, "split_gain": 1, "threshold": "1||5", "decision_type": "==", "default_left": False, "missing_type": "None", "internal_count": 2, "left_child": leaf(1.0), "right_child": leaf(2.0)}
    d = {"name": "tree", "version": "v2", "num_tree_per_iteration": 1, "max_feature_idx": 0, "feature_names": ["a"], "tree_info": [{"tree_structure": node}]}
    assert scoring.forest_margins(models.lightgbm_json(d), np.array([[5.0], [2.0]]))[:, 0].tolist() == [1.0, 2.0]


def test_pickles_read_no_other_classes():
    class Evil:
        def __reduce__(self):
            return (print, ("run",))

    with pytest.raises(models.FormatError):
        models.sklearn_pickle(pickle.dumps(Evil(), 0))


def test_sklearn_pickle():
    mods = {n: types.ModuleType(n) for n in ("sklearn", "sklearn.ensemble", "sklearn.ensemble.gradient_boosting", "sklearn.tree", "sklearn.tree._tree")}

    def cls(module, name):
        c = type(name, (), {"__module__": module})
        setattr(mods[module], name, c)
        return c

    gbc, log_odds = cls("sklearn.ensemble.gradient_boosting", "GradientBoostingClassifier"), cls("sklearn.ensemble.gradient_boosting", "LogOddsEstimator")
    dtr = cls("sklearn.tree._tree", "DecisionTreeRegressor")

    class Tree_:
        def __reduce__(self):
            nodes = np.array([(1, 2, 0, 0.5, 4), (-1, -1, -2, -2.0, 3), (-1, -1, -2, -2.0, 1)], dtype=[("left_child", "<i8"), ("right_child", "<i8"), ("feature", "<i8"), ("threshold", "<f8"), ("n_node_samples", "<i8")])
            return (mods["sklearn.tree._tree"].Tree, (2, np.array([1]), 1), {"nodes": nodes, "values": np.array([[[0.0]], [[1.0]], [[-1.0]]])})

    class Tree(Tree_):
        __module__, __qualname__ = "sklearn.tree._tree", "Tree"

    mods["sklearn.tree._tree"].Tree = Tree
    old = {n: sys.modules.get(n) for n in mods}
    sys.modules.update(mods)
    try:
        e, g, p = dtr(), gbc(), log_odds()
        e.tree_, p.prior = Tree(), 0.25
        g.estimators_, g.learning_rate, g.init_ = np.array([[e]], object), 0.1, p
        data = pickle.dumps(g, 2)
    finally:
        for n, m in old.items():
            sys.modules.pop(n) if m is None else sys.modules.__setitem__(n, m)
    m = models.sklearn_pickle(data)
    assert np.allclose(scoring.forest_margins(m, np.array([[0.0, 0], [1.0, 0]]))[:, 0], [0.35, 0.15])


def test_detection(tmp_path):
    (tmp_path / "a.txt").write_text("1,2,3\n")
    with pytest.raises(models.FormatError):
        models.load(str(tmp_path / "a.txt"))
    assert models.detect("m.txt", LGB.encode()) == "lightgbm_text"
    assert models.detect("m.json", b'{"learner": {}}') == "xgboost_json"
    assert models.detect("m.ubj", b"{") == "xgboost_ubjson"
