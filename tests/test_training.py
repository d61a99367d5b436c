"""Training against plain numpy, and its invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvatrix.functions import objectives
from silvatrix.operators import scoring
from silvatrix.plans import boosting, state
from silvatrix.plans.boosting import Columns, Params

C = Columns(["a", "b"])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 240), rng.integers(0, 7, 240)
    y = (a * 0.5 - (b > 3) * 2 + rng.normal(0, 0.3, 240)).round(3)
    rows = [(i, float(p), float(q), float(v), float(v > 1), float(i % 3), i % 12) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "row_id int, a double, b double, label double, pos double, cls double, qid int").persist()


def grow_plain(x, g, h, depth, lam):
    """Leaf values by row, splitting on all midpoints."""
    out = np.full(len(g), -g.sum() / (h.sum() + lam))
    if not depth or len(g) < 2:
        return out
    best = (1e-12, 0, 0.0)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[1:] + v[:-1]) / 2:
            m = x[:, f] <= t
            s = lambda k: g[k].sum() ** 2 / (h[k].sum() + lam)
            gain = 0.5 * (s(m) + s(~m) - g.sum() ** 2 / (h.sum() + lam))
            if gain > best[0] + 1e-9:
                best = (gain, f, t)
    if best[0] <= 1e-12:
        return out
    m = x[:, best[1]] <= best[2]
    out[m] = grow_plain(x[m], g[m], h[m], depth - 1, lam)
    out[~m] = grow_plain(x[~m], g[~m], h[~m], depth - 1, lam)
    return out


def test_exact_training_is_plain_boosting(data):
    model, history = boosting.train(data, Params(rounds=2, max_depth=2, lam=1.0, method="exact"), C)
    p = data.orderBy("row_id").toPandas()
    x, y = p[["a", "b"]].to_numpy(), p["label"].to_numpy()
    m = np.full(len(y), y.mean())
    for _ in range(2):
        m = m + 0.3 * grow_plain(x, m - y, np.ones(len(y)), 2, 1.0)
    assert np.allclose(scoring.forest_margins(model, x)[:, 0], m, atol=1e-6)
    assert history.train[-1] == pytest.approx(np.sqrt(np.mean((m - y) ** 2)))


def test_histogram_equals_exact_on_few_values(data):
    a, _ = boosting.train(data, Params(rounds=1, max_depth=3, lam=1.0, method="exact"), C)
    b, _ = boosting.train(data, Params(rounds=1, max_depth=3, lam=1.0, method="hist"), C)
    assert a.trees[0].threshold == b.trees[0].threshold and np.allclose(a.trees[0].leaf_value, b.trees[0].leaf_value)


def test_training_stores_gain_and_cover(data):  # Q2
    m, _ = boosting.train(data, Params(rounds=1, max_depth=2, method="exact"), C)
    assert all(g > 0 for g in m.trees[0].gain) and m.trees[0].cover[0] == pytest.approx(240)


def test_max_tips_and_depth(data):
    m, _ = boosting.train(data, Params(rounds=1, max_depth=4, max_tips=3, method="exact"), C)
    assert m.trees[0].tips == 3


def test_monotone(data):
    m, _ = boosting.train(data, Params(rounds=2, max_depth=3, method="exact", monotone={0: -1}), C)
    x = np.array([[v, 2.0] for v in np.arange(0, 9, 0.5)])
    assert (np.diff(scoring.forest_margins(m, x)[:, 0]) <= 1e-12).all()


def test_multiclass_and_classifier(data):
    c = Columns(["a", "b"], "cls")
    m, h = boosting.train(data, Params("multi:softprob", rounds=1, max_depth=2, num_class=3, method="exact"), c)
    assert len(m.trees) == 3 and m.transform == "softmax"
    p = scoring.predict(data, m, C.features, to="p").select(F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("s")).distinct().collect()
    assert all(r["s"] == pytest.approx(1) for r in p)


def test_ranking_improves(data):
    c = Columns(["a", "b"], "pos", group="qid")
    _, h = boosting.train(data, Params("rank:pairwise", rounds=2, max_depth=2, method="exact", rank=objectives.RankConfig("topk", 4)), c)
    assert h.train[-1] > 0.8


def test_survival_runs(data):
    timed = data.withColumn("t", F.when(F.col("row_id") % 3 == 0, -(F.col("a") + 1)).otherwise(F.col("a") + 1))
    boosting.train(timed, Params("survival:cox", rounds=1, max_depth=2, method="exact", metric="mae"), Columns(["a", "b"], "t"))
    both = timed.withColumns({"lo": F.abs("t"), "hi": F.when(F.col("t") < 0, float("inf")).otherwise(F.col("t"))})
    m, _ = boosting.train(both, Params("survival:aft", rounds=1, max_depth=2, method="exact", metric="mae"), Columns(["a", "b"], "t", lower="lo", upper="hi"))  # Q18: stays aft
    assert m.transform == "exponential"


def test_dart_forest_linear_and_sampling(data):
    d, _ = boosting.train(data, Params(rounds=3, max_depth=1, booster="dart", drop_rate=0.9, method="exact"), C)
    assert 0.0 in d.tree_weight
    r, _ = boosting.train(data, Params(rounds=1, max_depth=2, parallel_trees=2, subsample=0.7, colsample=0.5, method="exact"), C)
    assert r.average and len(r.trees) == 2 and {*r.trees[0].feature} <= {0, 1}
    w, h = boosting.train(data, Params(rounds=3, booster="gblinear"), C)
    assert h.train[-1] < h.train[0]


def test_early_stopping_callbacks_and_schedule(data):
    seen = []
    p = Params(rounds=6, max_depth=1, method="exact", early_stopping=1, eta_schedule=boosting.step_decay(0.3, 1, 0.0))
    _, h = boosting.train(data, p, C, callbacks=[lambda r, m, x: seen.append(r)])
    assert seen == list(range(len(h.train))) and len(seen) < 6


def test_checkpoint_and_resume_equal_one_run(data, tmp_path):  # Q17
    path = str(tmp_path / "c.json")
    p = Params(rounds=1, max_depth=2, method="exact")
    boosting.train(data, p, C, checkpoint_path=path)
    model, r, _ = state.load_checkpoint(path)
    more, _ = boosting.train(data, p, C, resume=model)
    whole, _ = boosting.train(data, Params(rounds=2, max_depth=2, method="exact"), C)
    x = np.array([[i, j] for i in range(9) for j in range(7)], float)
    assert r == 0 and np.allclose(scoring.forest_margins(more, x), scoring.forest_margins(whole, x))


def test_cross_validation_keeps_groups(data):  # Q19
    out = boosting.cross_validate(data, Params(rounds=1, max_depth=1, method="exact"), Columns(["a", "b"], group="qid"), 2, "rmse")
    assert len(out["values"]) == 2 and out["std"] == pytest.approx(np.std(out["values"]))


def test_categorical_split(data):
    m, _ = boosting.train(data.withColumn("label", (F.col("b") == 3).cast("double")), Params(rounds=1, max_depth=1, method="exact", categorical=(1,)), C)
    assert m.trees[0].categories[0] == frozenset([3])
