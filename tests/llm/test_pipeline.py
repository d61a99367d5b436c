"""The pipeline's stages against plain versions of each, on one small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from silvatrix.llm import quality  # noqa: E402
from test_dedup import components_plain, exact_plain  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(200):
        t = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        good = i % 5 > 0
        if not good:
            t = [w.upper() + "!!" for w in t]
        docs.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, int(good), 0))
    docs += [(300 + i, docs[i * 3 + 1][1], "en", "s", 0) for i in range(20)]  # copies
    passage = " ".join(rng.choice(words) for _ in range(90))
    docs += [(400 + i, " ".join(rng.choice(words) for _ in range(60)) + " " + passage, "en", "s", 0) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
        kept.append(sorted((r["doc_id"], r["text"]) for r in now.collect()) if "text" in now.columns else None)
    all_rows = [(d[0], d[1]) for d in docs]
    rejected = {r["doc_id"] for r in quality.score(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).where("predicted = 0").collect()}
    first = [x for x in sorted(all_rows) if x[0] not in rejected]
    assert kept[0] == first and {i for i in range(0, 200, 5)} <= rejected and len(rejected) < 80
    exact = {x[0] for x in exact_plain(first) if x[3]}
    assert [i for i, _ in kept[1]] == sorted(exact)
    assert [i for i, _ in kept[2]] == sorted({x[2] for x in components_plain(kept[1])})
    assert [i for i, _ in kept[3]] == [i for i, _ in kept[2]]
    cut = dict(kept[3])
    assert all(len(cut[400 + i]) < len(dict(kept[2])[400 + i]) - len(passage) + 60 for i in range(3) if 400 + i in cut)
    assert now.where("start = 0").count() == len(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_no_passage_of_over_50_words_stays_in_two_documents(spark, make_docs):
    """Passages of short and long words, planted in texts that are otherwise their own; other texts are unchanged."""
    rng = random.Random(12)
    word = lambda a, b: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(a, b)))
    text = lambda n, a=2, b=9: " ".join(word(a, b) for _ in range(n))
    passages = [text(51, 3, 3), text(52), text(70), text(60, 4, 14)]
    phrase = text(30)
    rows = [(i, f"{text(40)} {passages[i % 4]} {text(40)}") for i in range(16)]
    rows += [(50 + i, f"{text(60)} {phrase} {text(20)}") for i in range(4)] + [(90, None), (91, "")]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, make_docs(rows), "").collect()}
    seen = {}
    for i, t in out.items():
        w = (t or "").split()
        for k in range(len(w) - 50):
            seen.setdefault(" ".join(w[k : k + 51]), set()).add(i)
    assert not [s for s, ids in seen.items() if len(ids) > 1]
    assert all(out[i] == t for i, t in rows if i >= 50)
    assert all(out[i].split() == t.split()[:40] + t.split()[-40:] for i, t in rows if i < 16)


def test_empty_and_null_laden_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, None, None, None, None), (1, "", "", "", 0), (2, "a b", None, None, None), (2, "a b", None, None, None), (None, "a b", None, None, None)])):
        d = tmp_path / name
        spark.createDataFrame(rows, kind).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        got = sorted((r["doc_id"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, str(d)).collect())
        assert got == ([] if not rows else [(1, 0, 1), (2, 0, 3)])
