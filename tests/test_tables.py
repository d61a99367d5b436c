"""Sniffing, readers and writers."""

import math

import pytest

from silvatrix.operators import recsys
from silvatrix.sources import tables
from silvatrix.streaming import scoring as streaming


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("a.txt", "1 0:2 3:4\n0 1:1\n", {"format": "libsvm"}),
        ("a.tsv", "1\t0\t2\n1\t1\t3\n2\t0\t4\n", {"format": "ranking", "sep": "\t"}),
        ("a.csv", "a,target,b\n1,2,3\n", {"format": "csv", "sep": ",", "header": True, "label": 1}),
        ("a.csv", "1.5,2,3\n4,5,6\n", {"format": "csv", "sep": ",", "header": False, "label": 2}),
        ("a.csv", "2,1,3\n1,5,6\n", {"format": "csv", "sep": ",", "header": False, "label": 2}),
    ],
)
def test_sniff(name, text, want):
    assert tables.sniff(name, text.splitlines()) == want


def test_readers(spark, tmp_path):
    (tmp_path / "a.svm").write_text("1 1:2.5 3:4\n\n0 2:1\n")
    got = sorted(map(tuple, tables.read_table(spark, str(tmp_path / "a.svm")).collect()))
    assert got == [(0.0, 0.0, 1.0, 0.0), (1.0, 2.5, 0.0, 4.0)]
    sparse = tables.read_libsvm(spark, str(tmp_path / "a.svm"), base=0, absent=float("nan")).where("label = 0").first()
    assert math.isnan(sparse["f0"]) and sparse["f2"] == 1
    (tmp_path / "a.csv").write_text("x,label\n1,2\n,4\n")
    rows = sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "a.csv"), header=True, label="label", default=7.0).collect()))
    assert rows == [(1.0, 2.0), (7.0, 4.0)]
    (tmp_path / "r.tsv").write_text("# c\n1\t0\t2\n2\t1\t3\n1\t2\t4\n")
    assert tables.read_ranking(spark, str(tmp_path / "r.tsv")).groupBy("qid").count().orderBy("qid").collect() == [(1, 2), (2, 1)]  # Q12
    (tmp_path / "bad.csv").write_text("1,2\n3,x\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(0.1 + 0.2, float("nan")), (1e-300, -5.0)], "f0 double, f1 double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(r["f0"] for r in tables.read_csv(spark, str(tmp_path / "c")).collect()) == [1e-300, 0.1 + 0.2]
    deals = spark.createDataFrame([("u", "i", "t", 0.1 + 0.2, 1)], tables.RECSYS["deal"])
    tables.write_recsys(deals, str(tmp_path / "d"), "deal")
    assert tables.read_recsys(spark, str(tmp_path / "d"), "deal").collect() == deals.collect()


def test_deal_greedy_equivalence(spark):
    """Windows pick what a greedy pass over each user's candidates picks."""
    import random

    rng = random.Random(5)
    rows = [(u, i, rng.choice("ab"), round(rng.random(), 1)) for u in range(30) for i in range(rng.randint(1, 12))]
    decks, log = recsys.deal(spark.createDataFrame(rows, "User int, Item int, Tag string, Score double"), spark.createDataFrame([(0, 0)], "User int, Item int"), 4, 2)
    got = {(r["User"], r["rank"]): r["Item"] for r in decks.collect()}
    logs = {r["User"]: r for r in log.collect()}
    for u in range(30):
        cands = sorted([r for r in rows if r[0] == u and (r[0], r[1]) != (0, 0)], key=lambda r: (-r[3], r[1]))
        deck, tags, dropped = [], {}, 0
        for r in cands:
            if tags.get(r[2], 0) >= 2:
                dropped += 1
                continue
            deck.append(r[1])
            tags[r[2]] = tags.get(r[2], 0) + 1
            if len(deck) == 4:
                break
        rest = [r[1] for r in cands if r[1] not in deck]
        over = len(deck) < 4 and bool(rest)
        deck += rest[:1] if over else []
        assert [got.get((u, k + 1)) for k in range(len(deck))] == deck and (u, len(deck) + 1) not in got
        assert (logs[u]["dropped_tag"], logs[u]["overflow"], logs[u]["after_tag_filter"]) == (dropped, over, len(deck))


def test_stream_scores_as_batch(spark, tmp_path):
    from silvatrix.operators.scoring import predict
    from silvatrix.plans.model import tiny_forest

    df = spark.createDataFrame([(1.0, 50.0, 3.0, 4.0), (5.0, 90.0, 0.0, 7.0)], "a double, b double, c double, d double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.score_stream(stream, tiny_forest(), ["a", "b", "c", "d"]).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(r["prediction"] for r in predict(df, tiny_forest(), ["a", "b", "c", "d"]).collect())
    assert sorted(r["prediction"] for r in spark.table("scored").collect()) == want
    with pytest.raises(ValueError):
        streaming.score_stream(df, tiny_forest(), ["a", "b", "c", "d"])
