"""Toxicity and quality: held-out accuracy, gradients, and odd input."""

import random
import zlib

import numpy as np
import pytest

from silvatrix.llm import quality, toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 260))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vilest", "vilely", "scumbag", "loathe"]))
        if not good:
            a = len(text) // 3
            text[a:] = [w.upper() + "!!" for w in text[a:]]
        docs.append((i, " ".join(text)))
        if i % 10:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    odd = [(10**6, None), (10**6 + 1, ""), (None, "null id"), (10**6 + 2, "x " * 60000), (5, docs[5][1])]
    d = spark.createDataFrame([(i, t, "toxic", 0.5) for i, t in docs + odd], "doc_id long, text string, toxic string, score double")
    return d, spark.createDataFrame([*labels, (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def check(rows, truth, at, least):
    held = [(r["predicted"], truth[r["doc_id"]][at]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) >= least
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity(tables):
    docs, labels, truth = tables
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count()
    check(rows, truth, 1, 0.95)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1


def test_quality(tables):
    docs, labels, truth = tables
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count()
    check(rows, truth, 0, 0.95)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_without_labels(tables):
    docs, labels, _ = tables
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.score(docs.limit(5), none).collect()} == {0}
    assert {r["predicted"] for r in quality.score(docs.limit(5), none).collect()} == {1}
    assert toxicity.score(docs.limit(0), labels).count() == 0 and quality.score(docs.limit(0), labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(1)
    m = quality.AttentionModel(5, 7)
    sizes = np.array([3, 0, 2, 1, 0, 0, 4, 1, 0])
    x, begins, y = quality.Bag(rng.normal(size=(9, 5)), rng.integers(0, 7, sizes.sum()), sizes), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(m.score(x, begins)) + (1 - y) * np.log(1 - m.score(x, begins)))
    grads = m.gradients(x, begins, y)
    for name, p in m.p.items():
        for k in np.ndindex(p.shape):
            old = p[k]
            p[k] = old + 1e-6
            up = loss()
            p[k] = old - 1e-6
            down = loss()
            p[k] = old
            assert (up - down) / 2e-6 == pytest.approx(grads[name][k], abs=1e-6)


def values_of(rows, positive, drawn, size=1024):
    count = lambda which: np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(which)]), minlength=size)
    return toxicity.evidence(count(positive), count(drawn), positive.sum(), drawn.sum())


def marked_rows(n=400):
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(200, 20, replace=False)).astype(np.int32) for _ in range(n)]
    positive = rng.random(n) < 0.2
    for i in np.flatnonzero(positive):
        rows[i] = np.append(rows[i], np.int32(777))
    return rows, positive


def test_unlabelled_draw_holds_the_positives():
    """Rows that bear a mark of their own are told apart, though the draw holds them too."""
    rows, positive = marked_rows()
    drawn = np.ones(len(rows), bool)
    w, b = toxicity.nnpu_fit(rows, positive, drawn, values_of(rows, positive, drawn), positive.mean())
    score = np.array([w[r].sum() + b for r in rows])
    assert score[positive].min() > score[~positive].max() - 1e-9


def nnpu_plain(rows, positive, drawn, value, prior, epochs, rate=0.05, decay=1e-5, batch=1024, seed=5):
    """The estimator row by row, with the slope of the risk by its definition."""
    rng = np.random.default_rng(seed)
    w, m, v, step = np.append(np.ones(len(value)), -3.0), np.zeros(len(value) + 1), np.zeros(len(value) + 1), 0
    pos, unl = np.flatnonzero(positive), np.flatnonzero(drawn)
    for _ in range(epochs):
        n = max(1, len(unl) // batch)
        for ps, us in zip(np.array_split(rng.permutation(pos), n), np.array_split(rng.permutation(unl), n)):
            z = lambda i: sum(w[f] * value[f] for f in rows[i]) + w[-1]
            calling_clean = lambda i: np.log1p(np.exp(z(i)))
            below = np.mean([calling_clean(i) for i in us]) - prior * np.mean([calling_clean(i) for i in ps]) < 0
            grad = np.zeros_like(w)
            for group, weight in ((ps, -prior / len(ps)), (us, 1 / len(us))):
                for i in group:
                    s = 1 / (1 + np.exp(-z(i)))
                    g = weight * s * (-1 if below else 1)
                    if group is ps and not below:
                        g += prior * (s - 1) / len(ps)
                    for f in rows[i]:
                        grad[f] += g * value[f]
                    grad[-1] += g
            grad[:-1] += decay * (w[:-1] - 1)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1] * value, w[-1]


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_against_a_plain_version(prior):
    """With a prior above the share of positives the estimate falls below nothing, and steps go against it."""
    rows, positive = marked_rows(120)
    drawn = np.arange(120) % 3 > 0
    value = values_of(rows, positive, drawn)
    got = toxicity.nnpu_fit(rows, positive, drawn, value, prior, epochs=15, batch=40)
    want = nnpu_plain(rows, positive, drawn, value, prior, 15, batch=40)
    assert np.allclose(got[0], want[0], atol=1e-6) and got[1] == pytest.approx(want[1], abs=1e-6)


def test_unlabelled_draw_is_of_all_documents(spark, monkeypatch):
    """Documents far beyond the bounds, most without a label: the draw takes them at one rate, and toxic texts keep their scores."""
    docs, labels = corpus(3000, seed=3)
    labels = [x for x in labels if x[0] % 7 < 4]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    given = {}
    fit = toxicity.nnpu_fit
    monkeypatch.setattr(toxicity, "nnpu_fit", lambda rows, positive, drawn, value, prior, **k: given.update(positive=positive, drawn=drawn, prior=prior) or fit(rows, positive, drawn, value, prior, **k))
    w, b = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_positives=300, max_unlabelled=800)
    words = toxicity.HashedWords(toxicity.BITS, toxicity._parts)
    truth = {i: t for i, _, t in labels}
    score = {i: toxicity.sigmoid(w[list(words(toxicity.WORD.findall(t)))].sum() + b) for i, t in docs if i in truth}
    assert np.mean([score[i] >= toxicity.THRESHOLD for i in score if truth[i]]) > 0.8
    assert np.mean([score[i] >= toxicity.THRESHOLD for i in score if not truth[i]]) < 0.05
    assert 650 < given["drawn"].sum() < 950 and 200 < given["positive"].sum() < 400
    assert (given["positive"] & given["drawn"]).sum() < 0.6 * given["positive"].sum()  # drawn apart


def test_forward_pass_against_a_plain_version():
    """Bags of passages, by hand: features, encoder, gate, softmax, weighted sum, score."""
    texts = ["one two three " * 80, "", "Short! text | 12", "a b a b " * 300]
    size = len(quality.FEATURES)
    m = quality.AttentionModel(size, quality.WORD_SLOTS)
    rng = np.random.default_rng(6)
    m.mean, m.scale = rng.normal(size=size) * 0.1, rng.random(size) + 0.5
    got = quality._scores(m, texts)
    sig = lambda x: 1 / (1 + np.exp(-x))
    for text, score in zip(texts, got):
        words = text.split()
        hs, es = [], []
        for i in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
            part = words[i : i + quality.PASSAGE_WORDS]
            embedded = sum((m.p["E"][zlib.crc32(w.lower().encode()) % quality.WORD_SLOTS] for w in part), np.zeros(quality.EMBEDDING))
            surface = np.clip((np.array(quality.passage_features(part)) - m.mean) / m.scale, -8, 8)
            h = np.tanh(np.concatenate([surface, embedded / max(1, len(part)) ** 0.5]) @ m.p["W"] + m.p["b"])
            hs.append(h)
            es.append(np.exp((np.tanh(h @ m.p["V"]) * sig(h @ m.p["U"])) @ m.p["w"]))
        z = sum(e * h for e, h in zip(es, hs)) / sum(es)
        assert score == pytest.approx(sig(z @ m.p["c"] + m.p["c0"][0]), abs=1e-5)
    long = quality.bag("w " * (quality.PASSAGE_WORDS * 3000 + 1))
    assert list(long.sizes) == [quality.PASSAGE_WORDS] * 3000 + [1] and len(long.words) == long.sizes.sum()
    assert np.allclose(m.score(long, np.array([0])), m.score(quality.Bag(long.surface[-1001:], long.words[-1000 * quality.PASSAGE_WORDS - 1 :], long.sizes[-1001:]), np.array([0])), atol=1e-3)


def worded(n=1600, seed=4):
    """Good and bad texts look alike on the surface; some passages of bad ones use words of another list."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common, telling = [word() for _ in range(3000)], [word() for _ in range(40)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(common) for _ in range(rng.randint(100, 400))]
        good = rng.random() < 0.7
        if not good:
            at = rng.randrange(len(text) - 60)
            for k in rng.sample(range(at, at + 60), 12):
                text[k] = rng.choice(telling)
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_by_words_alone(spark):
    docs, labels = worded()
    d = spark.createDataFrame(docs, "key long, body string, text string")
    rows = quality.score(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), id_col="key", text_col="body").collect()
    check(rows, {i: (q, t) for i, q, t in labels}, 0, 0.9)
    bad = [r["predicted"] for r in rows if r["held_out"] and not labels[r["doc_id"]][1]]
    assert np.mean(bad) < 0.3


def test_quality_sample_is_bounded_in_rows_and_passages(spark):
    docs, labels = worded(600)
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = {tuple(quality.bag(t).words) for _, t, _ in docs}
    for most in ({"max_rows": 100, "max_passages": 10**6}, {"max_rows": 10**6, "max_passages": 300}):
        got = quality.training_sample(d, known, 5, 0, **most).collect()
        assert 60 < len(got) < 150 and all(tuple(r["words"]) in whole for r in got)  # rows are taken whole
