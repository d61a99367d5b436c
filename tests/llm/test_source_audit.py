"""Divergence of sources against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from silvatrix.llm import source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, term string, value long, c string"


def plain(rows, min_docs, k):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        here = [x for x in docs if x[0] == lang]
        df, total, of = Counter(), Counter(), {}
        for _, s, w in here:
            df.update(set(w))
            total.update(w)
            of.setdefault(s, Counter()).update(w)
        kept = sorted(t for t in df if df[t] >= min_docs)
        v = len(kept)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}
        q, p = shares(total), {s: shares(c) for s, c in of.items()}
        for s in of:
            rows_ = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in of if o != s)
            out += [(lang, s, "pair", o, -f, i + 1) for i, (f, o) in enumerate(rows_)]
            rows_ = sorted((q[t] - p[s][t], t) for t in kept if of[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -f, i + 1) for i, (f, t) in enumerate(rows_[:k])]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["the", "Of", "naïve", "Été", "été", "日本", "x", "z y"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "fr", None, "few"]) if i else "few"
        own = rng.randrange(8)
        text = " ".join(rng.choice(words[own:]) + rng.choice(["", "1", ",", "\x00"]) for _ in range(rng.randrange(25)))
        rows.append((text, lang if lang != "few" or i < 5 else "en", rng.choice([None, f"s{own}", f"s{own}", "hot"])))
    return rows + [(None, "en", "empty"), ("", "xx", "alone"), (None, None, None), ("same " * 9, "en", "s1"), ("same " * 9, "en", "s1"), ("long " * 30000, "fr", "s2"), ("only here", "en", "rare")]


@pytest.mark.parametrize("sizes", [(512, 64), (4, 3)])
def test_audit(spark, monkeypatch, sizes):
    """In one tile of sources and terms, and in many."""
    monkeypatch.setattr(source_audit.pair_sums, "__defaults__", sizes)
    monkeypatch.setattr(source_audit, "SEARCH_ROWS", 40)
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, "x", i, "y") for i, r in enumerate(rows)], DOCS)
    got = source_audit.audit(docs, min_docs=9, k=5)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain(rows, 9, 5)


def test_best_first_stops():
    """Buckets below the k-th best are not opened; results equal those of all."""
    rng = np.random.default_rng(4)
    c = rng.integers(1, 200, 3000)
    of_lang = c * rng.integers(2, 30, 3000)
    terms = [f"t{i:04d}" for i in range(3000)]
    n, lang_n = int(c.sum()), int(of_lang.sum())
    best = source_audit.BestTerms(10)
    for at in range(0, 3000, 500):
        best.add(terms[at : at + 500], c[at : at + 500], of_lang[at : at + 500], n, 3000, lang_n)
    f = source_audit.share(c, n, 3000) - source_audit.share(of_lang, lang_n, 3000)
    want = sorted(zip((-f).tolist(), terms))[:10]
    assert [(-int(x), t) for x, t in zip(best.f, best.terms)] == want
    assert best.opened < 0.3 * sum(len(np.unique(c[at : at + 500])) for at in range(0, 3000, 500))


def test_shares_are_exact():
    rng = random.Random(0)
    for _ in range(200):
        n, v = rng.randrange(1, 10**15), rng.randrange(1, 10**7)
        c = rng.randrange(0, n)
        assert int(source_audit.share(np.array([c]), n, v)[0]) == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_small_hold_and_empty_table(spark):
    texts = source_audit._texts(spark.createDataFrame([(1, "a b a", "en", "s", None, None, None)] * 3, DOCS), "text", "lang", "source")
    got = source_audit.partial_counts(texts, held=1).groupBy("term").sum("c", "d").collect()
    assert sorted(map(tuple, got)) == [("a", 6, 3), ("b", 3, 3)]
    assert source_audit.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    from silvatrix.llm import queries

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(duckdb.sql(source_audit.SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op12_source_audit(spark, d).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == want and {r[2] for r in got} == {"pair", "term"}
