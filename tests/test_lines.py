"""Line order, sinks that align, files in any store, objectives of groups, hot ties, backfill."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvatrix.functions import metrics, objectives
from silvatrix.functions.storage import read_file, write_file
from silvatrix.operators import recsys, scoring
from silvatrix.plans import boosting
from silvatrix.plans.model import Linear, tiny_forest, wide_forest
from silvatrix.sources import models, tables


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path, small_splits):
    (tmp_path / "t").mkdir()
    lines = [f"line {i} {'x' * (i % 37)}" for i in range(300)]
    (tmp_path / "t" / "a.txt").write_text("\n".join(lines[:170]) + "\n")
    (tmp_path / "t" / "b.txt").write_text("\n".join(lines[170:]))
    at = tables.numbered_lines(spark, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 5
    assert [(r["n"], r["value"]) for r in at.orderBy("n").collect()] == list(enumerate(lines))
    even = tables.numbered_lines(spark, str(tmp_path / "t"), F.expr("split(value, ' ')[1] % 2 = 0"))
    assert [(r["n"], r["value"]) for r in even.orderBy("n").collect()] == list(enumerate(lines[::2]))


def test_row_limit_and_blank_line(spark, tmp_path, small_splits):
    path = tmp_path / "a.svm"
    path.write_text("# c\n" + "\n".join(f"{i} 0:{i} 3:1" for i in range(100)) + "\n\n" + "\n".join(f"{i} 0:{i}" for i in range(100, 140)) + "\n")
    labels = lambda **kw: sorted(int(r["label"]) for r in tables.read_libsvm(spark, str(path), **kw).collect())
    assert labels() == list(range(140)) and labels(limit=37) == list(range(37)) and labels(limit=120) == list(range(120))
    assert labels(until_blank=True) == list(range(100)) and labels(until_blank=True, limit=55) == list(range(55)) and labels(until_blank=True, limit=555) == list(range(100))
    csv = tmp_path / "a.csv"
    csv.write_text("x,label\n" + "\n".join(f"{i},{i * 2}" for i in range(90)))
    got = tables.read_table(spark, str(csv), "csv", header=True, label="label", limit=33)
    assert sorted(map(tuple, got.collect())) == [(float(i), float(2 * i)) for i in range(33)]


def test_dense_columns_are_checked(spark, tmp_path):
    (tmp_path / "d.svm").write_text("1 0:2 1:3\n0 0:5 1:7\n")
    assert sorted(map(tuple, tables.read_dense_libsvm(spark, str(tmp_path / "d.svm")).collect())) == [(0.0, 5.0, 7.0), (1.0, 2.0, 3.0)]
    for bad in ("1 0:2 1:3\n0 0:5\n", "1 0:2 2:3\n", "1 1:2 0:3\n"):
        (tmp_path / "b.svm").write_text(bad)
        with pytest.raises(Exception, match="columns 0 to"):
            tables.read_dense_libsvm(spark, str(tmp_path / "b.svm")).collect()


def test_ranking_file_and_manifest_align(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(tables, "stored", lambda df, of=tables.stored: (of(df), spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))[0])
    rows = [(q, f"u{q}", f"i{k}", "t", float((q * 7 + k * 13) % 5), float(k % 2), k / 10) for q in range(30) for k in range(6)]
    df = spark.createDataFrame(rows, "qid int, User string, Item string, Tag string, recall_score double, label double, f0 double").repartition(5)
    assert tables.write_ranking_and_manifest(df, str(tmp_path / "r"), str(tmp_path / "m"), ["f0"]) == 180
    parts = lambda d: [f for f in sorted((tmp_path / d).glob("part-*")) if f.stat().st_size]
    ranks, names = parts("r"), parts("m")
    assert len(ranks) == len(names) > 1
    zipped = []
    for a, b in zip(ranks, names):
        lines, told = a.read_text().splitlines(), b.read_text().splitlines()
        assert len(lines) == len(told)
        zipped += [(x.split("\t"), json.loads(y)) for x, y in zip(lines, told)]
    of = {(r[1], r[2]): r for r in rows}
    for (q, label, f0), who in zipped:
        r = of[who["User"], who["Item"]]
        assert (int(q), float(label), float(f0), who["recall_score"]) == (r[0], r[5], r[6], r[4])
    order = [(int(x[0]), -y["recall_score"], y["Item"]) for x, y in zipped]
    assert order == sorted(order)


def test_models_and_reports_in_any_store(spark, tmp_path):
    at = f"file://{tmp_path}/model.json"
    models.save(tiny_forest(), at)
    assert models.load(at).transform == "logistic" and models.load(at, auto=False).transform == "raw"
    write_file(at + ".x", b"\x00\xff")
    assert read_file(at + ".x") == b"\x00\xff"
    tables.write_report(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == {"n": 1, "s": "a"}


def test_objective_of_a_model_and_training_from_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,label\n" + "\n".join(f"{i % 7},{i % 5},{int(i % 7 > 3)}" for i in range(80)))
    model, _ = boosting.train_file(spark, str(tmp_path / "t.csv"), boosting.Params("binary:logistic", rounds=1, max_depth=1, method="exact", lam=1.0))
    assert models.objective_of(model) == "binary:logistic" and model.trees[0].threshold == [3.5]
    more, _ = boosting.train_file(spark, str(tmp_path / "t.csv"), boosting.Params("", rounds=1, max_depth=1, method="exact", lam=1.0), resume=model)
    assert len(more.trees) == 2
    fresh, _ = boosting.train_file(spark, str(tmp_path / "t.csv"), boosting.Params("", rounds=1, max_depth=1, method="exact", lam=1.0), like=model)
    assert len(fresh.trees) == 1 and fresh.trees[0].threshold == [3.5] and fresh.objective == "binary:logistic"
    assert models.objective_of(Linear([[1.0]], [0.0], transform="exponential")) == "count:poisson"


def test_a_custom_objective_of_groups_equals_the_built_in_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 9 if i else None, float(rng.integers(0, 4)), float(rng.normal()), float(rng.integers(0, 3))) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id int, qid int, label double, margin double, w double")

    def listwise(y, p, w):
        if len(y) < 2:
            return np.zeros(len(y)), np.zeros(len(y))
        soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        s, t = soft(p), soft(y)
        return (s - t) * w, np.maximum(s * (1 - s) * w, 1e-16)

    objectives.register_grouped("mine:listwise", listwise, max_rows=20)
    got = objectives.grouped(df, "mine:listwise", "label", "margin", "qid", "row_id", "w").orderBy("row_id").collect()
    want = objectives.listwise(df, w="w").orderBy("row_id").collect()
    assert np.allclose([(r["grad"], r["hess"]) for r in got], [(r["grad"], r["hess"]) for r in want])
    objectives.register_grouped("mine:listwise", listwise, max_rows=5)
    with pytest.raises(ValueError, match="takes 5 at most"):
        objectives.grouped(df, "mine:listwise", "label", "margin", "qid", "row_id")
    objectives.register_grouped("mine:listwise", listwise)
    model, _ = boosting.train(df.where("qid IS NOT NULL").withColumn("a", F.col("label") + F.col("row_id") % 3), boosting.Params("mine:listwise", rounds=1, max_depth=2, lam=1.0, method="exact", metric="ndcg"), boosting.Columns(["a"], group="qid"))
    assert model.trees[0].nodes


def test_single_pair(spark):
    df = spark.createDataFrame([(0, 0, 2.0, 0.3), (1, 0, 1.0, 0.8)], "row_id int, qid int, label double, margin double")
    want = objectives.pair_gradients(df, "pairwise", objectives.RankConfig("full")).orderBy("row_id").first()
    g, h = objectives.pair_gradient(F.lit(0.3), F.lit(0.8))
    got = spark.range(1).select(g.alias("g"), h.alias("h")).first()
    assert (got["g"], got["h"]) == pytest.approx((want["grad"], want["hess"]))


def plain_cox(rows):
    """(grad, hess) by row of (id, time with sign, margin)."""
    order = sorted(rows, key=lambda r: (abs(r[1]), r[0]))
    out, r, s = {}, 0.0, 0.0
    for i, y, m in order:
        risk = sum(np.exp(x[2]) for x in rows if abs(x[1]) >= abs(y))
        if y > 0:
            r, s = r + 1 / risk, s + 1 / risk**2
        e = np.exp(m)
        out[i] = (e * r - (y > 0), max(e * r - e * e * s, 1e-16))
    return out


def test_hot_ties_are_dealt_out(spark):
    """Half of all rows at one time: right results, and no range with over twice the median of rows."""
    rng = np.random.default_rng(2)
    rows = [(i, float(3 if i % 2 else rng.integers(1, 40)) * (1 if i % 3 else -1), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id int, label double, margin double")
    want = plain_cox(rows)
    for r in objectives.cox(df).collect():
        assert (r["grad"], r["hess"]) == pytest.approx(want[r["row_id"]], abs=1e-8)
    from silvatrix.functions.windows import in_blocks

    sizes = sorted(r["count"] for r in in_blocks(df.withColumn("t", F.abs("label")), F.col("t"), F.col("row_id")).groupBy("_block").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("name", ["ndcg", "map", "ndcg@7", "map@7"])
def test_metrics_of_one_group_equal_those_with_a_group(spark, name):
    df = spark.createDataFrame([(i, float(i * 7 % 4), float(i * 13 % 5), 1) for i in range(90)], "id int, y double, p double, q int")
    one = metrics.evaluate(df, name, "y", "p", None, "id").first()["value"]
    assert one == pytest.approx(metrics.evaluate(df, name, "y", "p", "q", "id").first()["value"])


def test_sparse_rows_equal_dense_ones(spark):
    rng = np.random.default_rng(3)
    m = wide_forest(50, 9)
    dense = np.where(rng.random((60, 50)) < 0.3, rng.integers(0, 60, (60, 50)).astype(float), np.nan)
    rows = [(i, [int(j) for j in rng.permutation(np.flatnonzero(~np.isnan(r)))], None) for i, r in enumerate(dense)]
    rows = [(i, idx, [float(dense[i, j]) for j in idx], "x") for i, idx, _ in rows] + [(60, None, [1.0], "x"), (61, [], [], "x"), (62, [77, 3, 3], [1.0, 2.0, 50.0], "x")]
    df = spark.createDataFrame(rows, "id int, indices array<int>, values array<double>, margins_of string").repartition(3)
    got = {r["id"]: r["margins"] for r in scoring.sparse_margins(df, m).collect()}
    extra = np.full((3, 50), np.nan)
    extra[2, 3] = 50.0
    want = scoring.forest_margins(m, np.vstack([dense, extra]))
    assert all(np.allclose(got[i], want[i]) for i in range(63))
    lin = Linear([[float(j), -1.0] for j in range(50)], [0.5, 0.0], [1.0])
    got = {r["id"]: r["margins"] for r in scoring.sparse_margins(df, lin).collect()}
    assert np.allclose(got[0], [1.5 + np.nansum(dense[0] * np.arange(50)), 1.0 - np.nansum(dense[0])])


def test_backfill_is_for_users_who_lack_items(spark):
    """Users with enough items of their tags meet no popular one."""
    items = spark.createDataFrame([(f"i{k:02d}", f"t{k % 3}" if k < 24 else "none", float(k), 1.0) for k in range(30)], "Item string, Tag string, feat_pop double, feat_quality double")
    seen = spark.createDataFrame([(u, f"i{u % 3:02d}", 1.0, f"t{u % 3}") for u in range(9)] + [(9, "i00", 1.0, "t0"), (9, "i01", 2.0, "t1"), (10, "i29", 1.0, "gone")], "User int, Item string, Score double, Tag string")
    got = recsys.recall(seen, items, 10)
    assert recsys.validate_recall(got, 10).count() == 0
    by_user = {}
    for r in got.orderBy("User", "position").collect():
        by_user.setdefault(r["User"], []).append(r["Item"])
    own = {t: [f"i{k:02d}" for k in range(23, -1, -1) if k % 3 == t] for t in range(3)}
    popular = [f"i{k:02d}" for k in range(29, -1, -1)]
    for u in range(9):
        mine = own[u % 3][:10]
        assert by_user[u] == mine + [i for i in popular if i not in mine][: 10 - len(mine)]
    assert by_user[9] == (own[1] + own[0])[:10] and by_user[10] == popular[:10]


def test_whole_trees_walk_as_single_ones(spark):
    """Missing values of every kind, infinities, uneven trees, strict ones, features that aren't there: as the walk by nodes has it."""
    from silvatrix.plans.model import Forest, Tree

    rng = np.random.default_rng(9)
    trees = []
    for k in range(60):
        t = Tree(strict=k % 7 == 0)

        def build(level, t=t):
            if level == 6 or level and rng.random() < 0.3:
                t.leaf_value.append([float(rng.normal())])
                return ~(t.tips - 1)
            n = t.add(int(rng.integers(0, 6)), float(rng.choice([0.0, 1.0, 2.5, -1.0])), 0, 0, bool(rng.random() < 0.5), bool(rng.random() < 0.3), bool(rng.random() < 0.7))
            t.left[n] = build(level + 1)
            t.right[n] = build(level + 1)
            return n

        build(0)
        trees.append(t)
    x = rng.choice([0.0, 1.0, 2.5, -1.0, 1e-36, np.nan, np.inf, -np.inf, 7.0], (5000, 5))
    m = Forest(trees, 6, 2, base=[0.1, 0.2])
    want = np.tile([0.1, 0.2], (5000, 1))
    for i, t in enumerate(trees):
        want[:, i % 2] += np.array(t.leaf_value)[scoring._Compiled(t).tips(x), 0]
    assert np.allclose(scoring.forest_margins(m, x), want)
