"""Dense histograms against numpy: sums in trees, subtraction, nodes, bins of a node's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvatrix.functions import sampling
from silvatrix.operators import scoring
from silvatrix.plans import boosting, dense
from silvatrix.plans.boosting import Columns, Params

from test_training import grow_plain

F_, B, N = 20, 7, 600


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    return rng.integers(0, B, (N, F_)), rng.integers(-8, 9, (N, 2)) / 8.0, rng.integers(1, 9, (N, 2)) / 8.0


@pytest.fixture(scope="module")
def work(spark, rows):
    x, g, h = rows
    at = [[0, 0 if i % 3 else -1] for i in range(N)]
    data = [(a.tolist(), b.tolist(), c.tolist(), n) for a, b, c, n in zip(x, g, h, at)]
    return spark.createDataFrame(data, "_x array<int>, _g array<double>, _h array<double>, _at array<long>").repartition(9).persist()


SEARCH = dense.Search((B - 1,) * F_, (frozenset(range(F_)),) * 2, lam=1.0)


def plain_cells(x, g, h, keep):
    out = {}
    for i in np.flatnonzero(keep):
        for f in range(F_):
            a = out.setdefault((f, int(x[i, f])), [0.0, 0.0, 0])
            a[0] += g[i]
            a[1] += h[i]
            a[2] += 1
    return {k: tuple(v) for k, v in out.items()}


def cells_of(found, tree, node):
    got = dense.as_rows(found, SEARCH).where((F.col("tree") == tree) & (F.col("node") == node)).collect()
    return {(r["feature"], r["pos"]): (r["g"], r["h"], r["n"]) for r in got}


@pytest.mark.parametrize("fan", [64, 2])
def test_sums_of_two_trees(work, rows, monkeypatch, fan):
    """Two outputs, one tree without every third row; partial sums are added at once, or two at a time."""
    monkeypatch.setattr(dense, "FAN", fan)
    x, g, h = rows
    found = dense.level_histograms(work, dense.tasks(work), [(0, 0), (1, 0)], [], SEARCH, 2, [0, 1], None)
    assert cells_of(found, 0, 0) == plain_cells(x, g[:, 0], h[:, 0], np.ones(N, bool))
    assert cells_of(found, 1, 0) == plain_cells(x, g[:, 1], h[:, 1], np.arange(N) % 3 > 0)


def test_sibling_by_subtraction_and_chunks(work, rows, monkeypatch):
    monkeypatch.setattr(dense, "CELLS", F_ * B)  # a node a job
    x, g, h = rows
    before = dense.level_histograms(work, dense.tasks(work), [(0, 0), (1, 0)], [], SEARCH, 2, [0, 1], None).persist()
    level = dense.Level.of([{0: (4, 2.0, False)}, {0: (7, 3.0, True)}])
    found = dense.level_histograms(work, dense.tasks(work), [(0, 1), (1, 2)], [level], SEARCH, 2, [0, 1], before).persist()
    inside = np.arange(N) % 3 > 0
    for tree, node, keep in ((0, 1, x[:, 4] <= 2), (0, 2, x[:, 4] > 2), (1, 1, inside & (x[:, 7] == 3)), (1, 2, inside & (x[:, 7] != 3))):
        assert cells_of(found, tree, node) == plain_cells(x, g[:, tree], h[:, tree], keep)
    best = {(r["tree"], r["node"], r["block"]): r["gain"] for r in found.collect() if r["feature"] is not None}
    for tree, node, keep in ((0, 1, x[:, 4] <= 2), (0, 2, x[:, 4] > 2)):
        gains = []
        for f in range(F_):
            for p in range(B - 1):
                left, right = keep & (x[:, f] <= p), keep & (x[:, f] > p)
                s = lambda k: g[k, tree].sum() ** 2 / (h[k, tree].sum() + 1)
                gains.append(0.5 * (s(left) + s(right) - s(keep)) if left.any() and right.any() else 0.0)
        assert max(v for k, v in best.items() if k[:2] == (tree, node)) == pytest.approx(max(gains))


def test_what_shuffles_does_not_grow_with_the_rows(work):
    """A row a task, node and block: the same for the data three times over."""
    once = dense.partial_sums(work, [(0, 0)], [], SEARCH, 2, [0, 1])
    more = dense.partial_sums(work.withColumn("_x", F.explode(F.array_repeat("_x", 3))), [(0, 0)], [], SEARCH, 2, [0, 1])
    assert once.count() == more.count() == 9 * 2
    assert once.agg(F.sum(F.octet_length("g"))).first() == more.agg(F.sum(F.octet_length("g"))).first()


def training_data(spark, n=900):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, (n, 3)).astype(float)
    y = np.sin(x[:, 0]) + x[:, 1] * (x[:, 2] > 11) / 9 + rng.normal(0, 0.1, n)
    rows = [(i, *map(float, a), float(b), float(i % 5)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "row_id int, a double, b double, c double, label double, cls double").repartition(6).persist()


def test_twelve_levels(spark):
    """Deep trees equal plain boosting; nodes are stored three times on the way."""
    x, y, data = training_data(spark)
    model, _ = boosting.train(data, Params(rounds=1, max_depth=12, lam=1.0, method="hist", eval_every=5), Columns(["a", "b", "c"]))
    want = y.mean() + 0.3 * grow_plain(x, y.mean() - y, np.ones(len(y)), 12, 1.0)
    # Thresholds are midpoints of all values and not of a node's own, which parts a node's rows in the same way.
    assert model.trees[0].depth() > 8
    assert np.allclose(scoring.forest_margins(model, x)[:, 0], want, atol=1e-6)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_the_classes(spark):
    _, _, data = training_data(spark)
    found = []
    for k in (2, 5):
        c = Columns(["a", "b", "c"], "cls")
        p = Params("multi:softprob", max_depth=3, lam=1.0, num_class=k)
        current = data.withColumn("cls", F.col("cls") % k).withColumns({"margin": F.array(*[F.lit(0.0)] * k), "_x": F.array(*[F.col(f).cast("int") for f in c.features])})
        work = boosting.round_table(current, p, c, None, k).persist()
        work.count()
        r = boosting.Round("hist", k, list(range(k)), [[0, 1, 2]] * k, [[i + 0.5 for i in range(39)]] * 3)
        found.append(jobs_of(spark, f"classes-{k}", lambda: boosting.grow_round(work, p, r, 3, 0.3)))  # noqa: B023
    assert found[0] == found[1]


def test_classes_together_equal_each_alone(spark):
    _, _, data = training_data(spark)
    c = Columns(["a", "b", "c"], "cls")
    for method in ("hist", "exact"):
        m, _ = boosting.train(data, Params("multi:softprob", rounds=1, max_depth=3, lam=1.0, num_class=5, method=method, parallel_trees=2, colsample=0.7), c)
        assert len(m.trees) == 10
        work = data.withColumns({"margin": F.array(*[F.lit(-np.log(5))] * 5), "_x": boosting.values_array(c.features)})
        for i in (0, 7):
            p = Params("multi:softprob", max_depth=3, lam=1.0, num_class=5)
            allowed = boosting.sample_columns(3, 0.7, 101 * m.tree_class[i] + i % 2)
            one = boosting.grow_round(boosting.round_table(work, p, c), p, boosting.Round("exact", 5, [m.tree_class[i]], [allowed]), 3, 0.3)[0]
            assert one.feature == m.trees[i].feature and np.allclose(np.array(one.leaf_value), np.array(m.trees[i].leaf_value))


def test_bins_of_a_nodes_own(spark):
    """With room for all values of a node they are its midpoints, as the exact search has them; else equal widths of its bounds."""
    _, _, data = training_data(spark)
    c = Columns(["a", "b", "c"])
    a, _ = boosting.train(data, Params(rounds=1, max_depth=3, lam=1.0, method="hist", per_node_bins=True, max_bin=64), c)
    b, _ = boosting.train(data, Params(rounds=1, max_depth=3, lam=1.0, method="exact"), c)
    assert a.trees[0].threshold == b.trees[0].threshold and np.allclose(a.trees[0].leaf_value, b.trees[0].leaf_value)
    few, _ = boosting.train(data, Params(rounds=1, max_depth=2, lam=1.0, method="hist", per_node_bins=True, max_bin=4), c)
    t = few.trees[0]
    lo, hi = 0.0, 39.0
    assert t.threshold[0] in [lo + (hi - lo) * k / 4 for k in (1, 2, 3)]
    child = t.left[0]
    if child >= 0 and t.feature[child] == t.feature[0]:
        assert t.threshold[child] not in [lo + (hi - lo) * k / 4 for k in (1, 2, 3)]


@pytest.mark.parametrize("few", [4096, 0])
def test_kth_least(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    df = spark.range(3000).select("id", sampling.hash_of(7, F.col("id")).alias("a"), sampling.hash_of(8, F.col("id")).alias("b"))
    plain = {k: sorted(r[k] for r in df.select(k).collect()) for k in ("a", "b")}
    got = sampling.kth_least(df, [(F.col("a"), 1), (F.col("a"), 1700), (F.col("b"), 3000), (F.col("b"), 0)])
    assert got[:3] == [plain["a"][0], plain["a"][1699], plain["b"][2999]] and got[3] < plain["b"][0]
    assert sampling.drawn(df, 123, 7, F.col("id")).count() == 123 and sampling.drawn(df, 0, 7, F.col("id")).count() == 0


def test_draws_and_folds_are_exact(spark):
    _, _, data = training_data(spark)
    p = Params(subsample=0.37, seed=4)
    drawn = [data.where(d).count() for d in boosting.draws(data, p, Columns(["a"]), [1, 2, 3])]
    assert drawn == [int(900 * 0.37)] * 3
    fold = sampling.fold_of(data, "row_id", 7, 3, 900)
    sizes = sorted(r["count"] for r in data.groupBy(fold.alias("f")).count().collect())
    assert sizes == [128] * 6 + [132]
